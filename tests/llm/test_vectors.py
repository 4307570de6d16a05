"""Operators 2 and 6 against brute force."""

import math

import numpy as np
import pytest

from regionflow.llm import near_vectors, top_k

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def clusters(seed, groups=12, dim=24):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = rng.normal(size=dim)
        for _ in range(int(rng.integers(1, 90 if g == 0 else 12))):
            v = centre + rng.normal(size=dim) * rng.choice([0.03, 0.12, 0.16, 0.2])
            rows.append((v.astype(np.float32).tolist(), int(g % 3)))
    return rows


def odd():
    return [
        (None, 1), ([], 1), ([0.0] * 24, 1), ([float("nan")] * 24, 1), ([float("inf")] + [1.0] * 23, 1), ([None] + [1.0] * 23, 1), ([1.0] * 24, None),
        ([1.0] * 24, 5), ([1.0] * 24, 5), ([1e-30] * 24, 5), ([3e38] * 24, 5), ([2.0], 5), ([3.0], 5), ([-3.0], 5), ([1.0, 2.0], 5),
    ]


def brute(rows):
    good = {}
    for k, (v, label) in enumerate(rows):
        if v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            x /= np.abs(x).max()
            good[k] = x / np.linalg.norm(x)
    links = {k: set() for k in range(len(rows))}
    for a in good:
        for b in good:
            if a < b and rows[a][1] == rows[b][1] and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.98:
                links[a].add(b)
                links[b].add(a)
    out = {}
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            todo += (new := links[todo.pop()] - seen)
            seen |= new
        out[k] = (len(links[k]), min(seen), k == min(seen))
    return out


@pytest.mark.parametrize("seed,tile,short", [(1, 512, 32), (2, 16, 4)])
def test_near_vectors_equal_brute_force(spark, monkeypatch, seed, tile, short):
    monkeypatch.setattr(near_vectors, "TILE", tile)
    monkeypatch.setattr(near_vectors, "SHORT", short)
    rows = clusters(seed) + odd()
    df = spark.createDataFrame([(k, v, label, "x") for k, (v, label) in enumerate(rows)], SCHEMA).repartition(4)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near_vectors(df).collect()}
    assert got == brute(rows)


def test_near_vectors_of_repeated_rows_and_of_nothing(spark):
    rows = [(1, [1.0, 0.0], 1, ""), (1, [1.0, 0.0], 1, ""), (2, [0.0, 1.0], 1, ""), (None, [1.0, 0.0], 1, "")]
    got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(-1, 0, None, True), (1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]
    assert near_vectors.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_unlike_vectors_of_one_id_and_labels_of_text(spark):
    rows = [(1, [1.0, 0.0], "a", ""), (1, [0.0, 1.0], "a", ""), (2, [1.0, 0.001], "a", ""), (3, [1.0, 0.0], "b", ""), (4, [1.0, 0.0], None, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string, n_links string")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near_vectors(df).collect())
    assert got == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]


def test_a_third_of_equal_vectors(spark):
    """Hot classes and hot components are looked up, not dealt out by their key."""
    rng = np.random.default_rng(3)
    rows = [(k, [1.0, 2.0, 3.0, 4.0], 1, "") for k in range(900)] + [(900 + k, [0.0] * 4, 1, "") for k in range(600)]
    rows += [(1500 + k, rng.normal(size=4).tolist(), 1, "") for k in range(60)]
    got = {r["vec_id"]: r for r in near_vectors.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    expected = brute([(v, label) for _, v, label, _ in rows[899:]])
    for k in range(1500, 1560):
        assert (got[k]["n_links"] == 0) == (expected[k - 899][0] == 0)
    assert all(got[k]["n_links"] >= 899 and got[k]["component_id"] == 0 for k in range(900))
    assert all((got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True) for k in range(900, 1500))


def test_only_shared_filters_fetch_vectors(spark):
    passed = spark.createDataFrame([(1, 0, 2, 5), (1, 0, 2, 7), (1, 0, 2, 9), (2, 0, 2, 7), (3, 1, 2, 5), (4, 0, 2, 9), (2, 0, 2, 9)], "id long, label long, dim long, filter long")
    got = {r["id"]: [tuple(f) for f in r["filters"]] for r in near_vectors.shared_filters(passed).collect()}
    assert got == {1: [(7, 2), (9, 3)], 2: [(7, 2), (9, 3)], 4: [(9, 3)]}


def test_caps_are_decoded_whole():
    code = near_vectors.CapCode(10, 20, 1)
    rng = np.random.default_rng(0)
    unit = rng.normal(size=(50, 10))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    turned = unit @ code.rotation
    all_scores = (turned[:, :5] @ code.books[0].T)[:, :, None] + (turned[:, 5:] @ code.books[1].T)[:, None, :]
    expected = {(r, i * 20 + j) for r, i, j in zip(*np.nonzero(all_scores >= code.height))}
    assert set(zip(*(x.tolist() for x in code.decode(unit)))) == expected


@pytest.mark.parametrize("dim,words", [(64, 32), (64, 250), (64, 1000), (64, 4096), (16, 1000), (8, 1000)])
def test_planted_pairs_share_a_filter(spark, dim, words):
    n, rng = 10_000, np.random.default_rng(words)
    first, other = rng.normal(size=(2, n, dim))
    first /= np.linalg.norm(first, axis=1, keepdims=True)
    other -= (other * first).sum(axis=1, keepdims=True) * first
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    both = np.concatenate([first, 0.98 * first + np.sqrt(1 - 0.98**2) * other])
    df = spark.createDataFrame([(k, 0, dim, v) for k, v in enumerate(both.tolist())], "id long, label long, dim long, v array<double>").repartition(8)
    table = near_vectors.decode(df, words).select("id", "filter").toArrow()
    ident, passed = table.column("id").to_numpy(), table.column("filter").to_numpy()
    assert np.bincount(ident).min() >= near_vectors.CODES * near_vectors.PASSED
    key = (ident % n) << 32 | passed
    pairs = np.intersect1d(key[ident < n], key[ident >= n])
    assert len(np.unique(pairs >> 32)) == n


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e30])
def test_top_k_equals_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(top_k, "SHARD_ROWS", 37)
    monkeypatch.setattr(top_k, "QUERY_ROWS", 3)
    rng = np.random.default_rng(5)
    vectors = [(rng.integers(-3, 4, 6) / 256 * scale).astype(np.float32).tolist() for _ in range(300)]
    vectors += [None, [float("nan")] * 6, [None] + [1.0] * 5, [1.0, 2.0]]
    df = spark.createDataFrame([(k, v, 0, "") for k, v in enumerate(vectors)], SCHEMA).repartition(5)
    got = [tuple(r) for r in top_k.search(df.filter("vec_id % 50 = 0"), df, k=5).collect()]
    whole = {k: [math.floor(256 * float(x)) for x in v] for k, v in enumerate(vectors) if v and all(x is not None and math.isfinite(x) for x in v)}
    expected = []
    for q in (k for k in whole if k % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v)), k) for k, v in whole.items() if k != q and len(v) == len(whole[q]))
        # Scores beyond the long range are set to its end, after ranking.
        expected += [(q, n + 1, k, max(-(2**63), min(2**63 - 1, -s))) for n, (s, k) in enumerate(scored[:5])]
    if scale < 1e20:
        assert sorted(got) == sorted(expected)
    else:
        assert sorted((a, b, d) for a, b, _, d in got) == sorted((a, b, d) for a, b, _, d in expected)


def test_top_k_of_few_and_of_none(spark):
    two = spark.createDataFrame([(0, [1.0], 0, ""), (1, [2.0], 0, "")], SCHEMA)
    assert [tuple(r) for r in top_k.search(two.filter("vec_id = 0"), two).collect()] == [(0, 1, 1, 256 * 512)]
    assert top_k.search(two.filter("vec_id = 9"), two).count() == 0
