"""Operator 11: hosts, paths and rules against plain code, trees against plain walks and held-out URLs."""

import numpy as np

from regionflow.llm import queries, url_filter

SF = "/root/testdata/sf0.01"


def plain(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host, after = rest[: min(ends, default=len(rest))], rest[min(ends, default=len(rest)) :]
    path = after[: min((after.find(c) for c in "?#" if c in after), default=len(after))]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.name), default=None)


URLS = [
    None, "", "no scheme", "://", "http://", "http://com", "http://com/", "http://COM/x", "https://Example.COM/en/1", "https://www.example.com/en/1?q=1#f",
    "https://m.www.example.com/en/", "https://xexample.com/en/", "https://example.com/en", "http://example.com?/en/", "http://example.com#/en/", "http://a.net/es/2",
    "http://net/fr/", "http://a.net/de/2", "http://a.org/en/?a=http://b.com/", "http://a.com\n/en/", "ftp://É.com/É", "http://a://b.com/", "http://a.com/" + "y" * 100_000,
    "http://a.com/%41?&&==", "http://a.net/es", "HTTP://A.NET/ES/",
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(k, u, "own") for k, u in enumerate(URLS + URLS)], "page_id long, url string, verdict string")
    got = url_filter.judge_urls(df, queries.URL_RULES).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        host, path, rule = plain(URLS[r["page_id"] % len(URLS)])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule.name if rule else None)
        assert r["verdict"] == (rule.verdict if rule else "block" if r["score"] >= 0.5 else "allow") and 0 <= r["score"] <= 1
    assert len({(r["page_id"] % len(URLS), r["verdict"], r["score"]) for r in got}) == len(URLS)
    assert url_filter.judge_urls(df.limit(0), queries.URL_RULES).count() == 0


def test_query_on_all_pages(spark):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.QUERIES["op11_url_filter"](spark, SF).collect()
    assert {r["page_id"] for r in got} == set(urls) and len(got) == len(urls)
    for r in got:
        host, path, rule = plain(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule.name if rule else None)
        assert r["verdict"] == (rule.verdict if rule else "block" if r["score"] >= 0.5 else "allow")


def test_labels_of_one_kind_or_none(spark):
    df = spark.createDataFrame([(f"http://h{k}.com/", 1) for k in range(9)], "url string, blocked int")
    assert url_filter.learn(df).score(["x", "http://y.org/"]).tolist() == [1.0, 1.0]
    assert url_filter.learn(df.limit(0)).score(["x"]).tolist() == [0.0]


def test_held_out_urls(spark):
    """Marks that only the shape of a URL tells: many parameters, digits and a few bad endings."""
    rng = np.random.default_rng(4)
    made = []
    for k in range(3000):
        bad = int(rng.random() < 0.4)
        digits = "".join(rng.choice(list("0123456789"), 9 if bad else 2))
        query = "&".join(f"p{j}={j}" for j in range(rng.integers(2, 6) if bad else rng.integers(0, 3)))
        host = f"{'x' if bad else 'site'}{digits}.{rng.choice(['zip', 'top', 'com'] if bad else ['com', 'org', 'edu'])}"
        made.append((f"http://{host}/a/{k}?{query}", bad))
    judge = url_filter.learn(spark.createDataFrame(made[:2000], "url string, blocked int"))
    score = judge.score([u for u, _ in made[2000:]])
    assert np.mean((score >= 0.5) == np.array([b for _, b in made[2000:]])) > 0.95


def test_trees_equal_plain_walks():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(400, 6)), 1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = url_filter.train(x, y, trees=12)
    got = model.score(x)
    for row, p in zip(x, got):
        logit = model.start
        for feature, above, leaf in zip(model.feature, model.above, model.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > above[node] else 1)
            logit += leaf[node - len(feature)]
        assert np.isclose(p, 1 / (1 + np.exp(-logit)))
    assert np.mean((got >= 0.5) == y) > 0.95


def test_entropy_and_statistics():
    texts = ["", "aaaa", "abab", "abcd", "é"]
    assert np.allclose(url_filter.entropy(texts), [0, 0, 1, 2, 1])
    places = url_filter.lexical(["http://a.b.co.uk/x/y.html", "nothing"])[1]
    assert places.shape == (2, len(url_filter.SUFFIXES)) and (places // url_filter.BUCKETS == np.arange(len(url_filter.SUFFIXES))).all()


def test_suffixes_count_every_labelled_url(spark):
    rows = [(f"http://h{k}.net/{k % 3}/z", k % 2) for k in range(200)]
    found = url_filter.suffix_statistics(spark.createDataFrame(rows, "url string, blocked int").repartition(3))
    size = url_filter.BUCKETS
    for k in range(len(url_filter.SUFFIXES)):
        assert found.total[k * size : (k + 1) * size].sum() == 200 and found.blocked[k * size : (k + 1) * size].sum() == 100
    places = url_filter.lexical(["http://q.net/1/"])[1][0]
    assert found.total[places[0]] == 200 and found.total[places[2]] == sum(k % 3 == 1 for k in range(200))
