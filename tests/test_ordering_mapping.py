"""Positions and mapping against brute force, with one hot key in both."""

import random

from pyspark.sql import functions as F

from regionflow.operators import batching, mapping, merge
from regionflow.operators.ordering import number_sorted, radix_levels, with_position


def test_positions_with_a_hot_document(spark):
    rnd = random.Random(2)
    rows = [(0 if rnd.random() < 0.4 else rnd.randint(1, 20), p, "" if rnd.random() < 0.4 else "t")
            for p in rnd.sample(range(3_000_000), 2000)]
    df = spark.createDataFrame(rows, "doc_id int, global_idx bigint, text string")
    got = with_position(df, ["doc_id"], radix_levels("global_idx", "b"), [F.col("global_idx")], "n")
    cut = batching.text_cut_batches(df, 4).join(got, ["doc_id", "global_idx", "text"]).collect()
    docs = {}
    for d, p, t in sorted(rows):
        docs.setdefault(d, []).append((p, t))
    want = {}
    for d, r in docs.items():
        k = 0
        for i, (p, t) in enumerate(r):
            want[d, p] = (i, k // 4, k % 4)
            k += t != ""
    assert {(r.doc_id, r.global_idx): (r.n, r.batch_idx, r.text_idx) for r in cut} == want


def test_number_sorted(spark):
    words = [f"p{(i * 7919) % 1000:04d}" for i in range(1000)]
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(5)
    got = {r.w: r.i for r in number_sorted(df, [F.col("w")], "i").collect()}
    assert got == {w: i for i, w in enumerate(sorted(words))}


def brute(line, cells, tol=15):
    batch, x, y, w, h = line
    mine = [c for c in cells if batch is None or c[0] is None or c[0] == batch]
    cx, cy = x + w / 2, y + h / 2
    for px, py in ((cx, cy), (x, y)):
        for c in mine:
            if c[2] - tol <= px <= c[4] + tol and c[3] - tol <= py <= c[5] + tol:
                return c[1]
    best, hit = 0, None
    for c in mine:
        o = max(0, min(x + w, c[4]) - max(x, c[2])) * max(0, min(y + h, c[5]) - max(y, c[3]))
        if o > best:
            best, hit = o, c[1]
    return hit


def test_spatial_rules(spark):
    rnd = random.Random(9)
    cells = []
    for i in range(120):
        x, y = rnd.randint(-50, 4000), rnd.randint(-50, 900)
        cells.append((None if i % 17 == 0 else i // 40, i, x, y, x + rnd.randint(10, 300), y + rnd.randint(10, 200)))
    lines = []
    for i in range(600):
        big = rnd.random()
        lines.append((
            None if rnd.random() < 0.2 else (1 if rnd.random() < 0.6 else rnd.randint(0, 3)),
            float(rnd.randint(-200, 4200)), float(rnd.randint(-200, 1100)),
            float(rnd.choice((0, 30, 200, 900)) if big < 0.95 else 40000), float(rnd.choice((0, 20, 150, 700))),
        ))
    ldf = spark.createDataFrame(
        [(0, i, *ln) for i, ln in enumerate(lines)],
        "doc_id bigint, line_no bigint, batch_idx bigint, x double, y double, width double, height double",
    )
    cdf = spark.createDataFrame(
        [(0, *c, c[0] or 0, c[1], c[2], c[3], 0, 0) for c in cells],
        "doc_id bigint, batch_idx bigint, cell_idx bigint, gx1 bigint, gy1 bigint, gx2 bigint, gy2 bigint, "
        "page_idx bigint, bubble_idx bigint, bx1 bigint, by1 bigint, pad_l bigint, pad_t bigint",
    )
    got = {r.line_no: r.cell_idx for r in mapping.spatial_matches(ldf, cdf).collect()}
    want = {i: brute(ln, cells) for i, ln in enumerate(lines)}
    assert got == {i: c for i, c in want.items() if c is not None}

    points = ldf.selectExpr("doc_id", "line_no", "x + width / 2 AS cx", "y + height / 2 AS cy")
    near = {r.line_no: (r.cell_idx, round(r.distance, 6)) for r in mapping.nearest_cells(points, cdf).collect()}
    for i, (_, x, y, w, h) in enumerate(lines):
        cx, cy = x + w / 2, y + h / 2
        d, c = min((max(c[2] - cx, 0, cx - c[4]) ** 2 + max(c[3] - cy, 0, cy - c[5]) ** 2, c[1]) for c in cells)
        assert near[i] == (c, round(d ** 0.5, 6))


def test_chars_move_with_their_line(spark):
    cells = spark.sql(
        "SELECT 0L doc_id, 0L batch_idx, 0L cell_idx, 0L page_idx, 3L bubble_idx, 30L gx1, 30L gy1, 130L gx2, 90L gy2,"
        " 500L bx1, 600L by1, 5L pad_l, 5L pad_t"
    )
    lines = spark.sql(
        "SELECT 0L doc_id, 0L line_no, 0L batch_idx, 'カ' text, 40.5D x, 50D y, 20D width, 10D height,"
        " CAST(NULL AS BIGINT) cell_idx, array(struct('カ' AS char, array(40D, 50D, 45.9D, 60D) AS bbox),"
        " struct('x' AS char, array(1D) AS bbox)) AS chars"
    )
    (row,) = mapping.map_lines(lines, cells).collect()
    assert (row.outcome, row.bbox, row.bubble_idx) == ("matched_bbox", [505, 615, 525, 625], 3)
    assert [(c.char, c.bbox) for c in row.chars] == [("カ", [505, 615, 510, 625])]


def test_merge_rule(spark):
    texts = spark.createDataFrame(
        [(1, 0, 1, 0, 1, "い", 0, 0, 10, 10), (1, 0, 1, 0, 0, " あ ", 0, 0, 10, 10),
         (1, 0, 1, 1, 0, "ア", 0, 0, 10, 10), (1, 0, 1, 1, 1, "イ", 0, 0, 9, 9),
         (1, 0, 1, 2, 0, "LV:100 HP:2000 ポチ", 0, 0, 1, 1)],
        "doc_id int, page_idx int, level int, bubble_idx int, line_no int, text string, x1 int, y1 int, x2 int, y2 int",
    )
    regions = spark.createDataFrame(
        [(1, 0, 1, b, 0, 0, s, s) for b, s in ((0, 100), (1, 10), (2, 10))],
        "doc_id int, page_idx int, level int, bubble_idx int, x1 int, y1 int, x2 int, y2 int",
    )
    got = {r.bubble_idx: r.merged for r in merge.merge_regions(texts, regions).collect()}
    assert got == {0: "あ\nい", 1: "アイ"}


def test_lines_without_batch_meet_few_cells_however_many_batches(spark):
    """Each batch lays its cells over the same picture; a point still meets a few of them."""
    rnd = random.Random(6)
    kept, pairs = {}, {}
    for batches in (20, 200):
        cells = []
        for k in range(batches * 50):
            x, y = rnd.randint(0, 800), rnd.randint(0, 1100)
            cells.append((0, k // 50, k, 0, k, x, y, x + rnd.randint(40, 160), y + rnd.randint(40, 160), 0, 0, 0, 0))
        cdf = spark.createDataFrame(cells, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in ("batch_idx", "cell_idx", "page_idx", "bubble_idx", "gx1", "gy1", "gx2", "gy2", "bx1", "by1", "pad_l", "pad_t")))
        points = mapping._point_cells(cdf, 15)
        kept[batches] = points.count()
        ldf = spark.createDataFrame([(0, k, None, float(rnd.randint(0, 900)), float(rnd.randint(0, 1200)), 20.0, 10.0) for k in range(400)], "doc_id bigint, line_no bigint, batch_idx bigint, x double, y double, width double, height double")
        at = ldf.selectExpr("doc_id", "named_struct('lv', 0, 'ty', floor((y + 5) / 32), 'tx', floor((x + 10) / 32)) AS p")
        pairs[batches] = at.join(points, ["doc_id", "p"]).count()
    assert kept[200] < 2 * kept[20] and pairs[200] < 2 * pairs[20]


def test_nearest_cell_of_short_documents_goes_through_one_list(spark):
    """Long documents go by tiles, short ones by a list; results are the same and no short one meets a window."""
    rnd = random.Random(11)
    cells, points, k = [], [], 0
    for doc, n in ((0, 1), (1, 5), (2, 40), (3, 200), (4, 0)):
        for _ in range(n):
            x, y = rnd.randint(0, 60) * 20, rnd.randint(0, 60) * 20
            cells.append((doc, k % 3, k, 0, k, x, y, x + rnd.choice((20, 60)), y + 40, 0, 0, 0, 0))
            k += 1
        points += [(doc, i, float(rnd.randint(-100, 1400)), float(rnd.randint(-100, 1400))) for i in range(60)]
    points.append(points[0])
    cdf = spark.createDataFrame(cells, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in ("batch_idx", "cell_idx", "page_idx", "bubble_idx", "gx1", "gy1", "gx2", "gy2", "bx1", "by1", "pad_l", "pad_t")))
    pdf = spark.createDataFrame(points, "doc_id bigint, line_no bigint, cx double, cy double")
    want = {}
    for doc, i, cx, cy in points:
        ranked = sorted((max(c[5] - cx, 0, cx - c[7]) ** 2 + max(c[6] - cy, 0, cy - c[8]) ** 2, c[2]) for c in cells if c[0] == doc)
        if ranked:
            want[doc, i] = (round(ranked[0][0] ** 0.5, 6), ranked[0][1])
    for few in (0, 40, 1000):
        near = mapping.nearest_cells(pdf, cdf, few=few)
        rows = near.collect()
        assert len(rows) == len(want) and {(r.doc_id, r.line_no): (round(r.distance, 6), r.cell_idx) for r in rows} == want
        assert ("Window" in near._jdf.queryExecution().optimizedPlan().toString()) == (few < 200)
