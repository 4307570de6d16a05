"""Packing: what every packing of random documents must hold."""

import random
from collections import defaultdict

from regionflow.operators import layout


def rows_of(placed, size):
    """(group, row) -> its items in place order; every item exactly once."""
    rows = defaultdict(list)
    for (doc, seq), (*group, row, place) in placed.items():
        rows[(doc, *group, row)].append((place, seq))
    for at, items in rows.items():
        items.sort()
        assert [p for p, _ in items] == list(range(len(items))), at
    assert sum(map(len, rows.values())) == size
    return {at: [seq for _, seq in items] for at, items in rows.items()}


def check_fit(rows, sizes, width, pad, extra=0):
    """No row of several items is too wide, and none was closed while its next item would still fit."""
    following = defaultdict(list)
    for at, items in sorted(rows.items()):
        following[at[:-1]].append((at, items))
    for group, listed in following.items():
        assert [at[-1] for at, _ in listed] == list(range(len(listed))), group
        for k, (at, items) in enumerate(listed):
            used = pad + sum(sizes[at[0], s][0] + pad for s in items)
            assert len(items) == 1 or used + extra <= width, at
            yield at, items, used, listed[k + 1][1] if k + 1 < len(listed) else None


def make(spark, sizes, seed, w=(5, 200), h=(5, 150)):
    rnd = random.Random(seed)
    rows = [
        (d, s, rnd.randint(*w), rnd.randint(*h))
        for d, n in enumerate(sizes) for s in range(n)
    ]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, seq bigint, w bigint, h bigint")
    docs = {}
    for d, s, ww, hh in sorted(rows):
        docs.setdefault(d, []).append((s, ww, hh))
    return df, docs


def test_shelf_rows_across_blocks(spark):
    df, docs = make(spark, [1, 3, 40, 400, 1500], 7, w=(0, 200))
    sizes = {(d, s): (w, h) for d, items in docs.items() for s, w, h in items}
    for extra, separators in ((0, False), (6, True)):
        results = []
        for block, super_block in ((32, 4), (4096, 1024)):
            got = layout.shelf_rows(df, 600, 30, separators, block=block, super_block=super_block).collect()
            results.append({(r.doc_id, r.seq): (r.row_idx, r.row_ord) for r in got})
        assert results[0] == results[1]
        rows = rows_of(results[0], len(sizes))
        for at, items, used, after in check_fit(rows, sizes, 600, 30, extra):
            if after:
                assert items + after == list(range(items[0], after[-1] + 1)), at
                assert used + sizes[at[0], after[0]][0] + 30 + extra > 600, at


def test_height_batches_skip_and_strict(spark):
    df, docs = make(spark, [1, 5, 60, 300], 11)
    sizes = {(d, s): (w, h) for d, items in docs.items() for s, w, h in items}
    for strict in (False, True):
        got = {
            (r.doc_id, r.seq): (r.batch_idx, r.row_idx, r.row_ord)
            for r in layout.height_batches(df, 600, 30, 500, strict).collect()
        }
        rows = rows_of(got, len(sizes))
        heights, order = defaultdict(lambda: 30), defaultdict(list)
        for at, items, _, _ in check_fit(rows, sizes, 600, 30):
            heights[at[:2]] += max(sizes[at[0], s][1] for s in items) + 30
            order[at[:2]] += items
        for at, items in order.items():
            assert items == sorted(items), at
            assert heights[at] <= 500 or len({r for *g, r in rows if tuple(g) == at}) == 1, at
        for doc in docs:
            numbers = sorted(b for d, b in order if d == doc)
            assert numbers == list(range(len(numbers)))
            if strict:
                # In order across batches, each closed only by a row that no longer fits.
                assert [s for b in numbers for s in order[doc, b]] == list(range(len(docs[doc])))
                for b in numbers[1:]:
                    tall = max(sizes[doc, s][1] for s in rows[doc, b, 0]) + 30
                    assert heights[doc, b - 1] + tall > 500


def test_oversized_row_is_taken_first(spark):
    df = spark.createDataFrame(
        [(1, 0, 900, 900), (1, 1, 10, 10)], "doc_id bigint, seq bigint, w bigint, h bigint"
    )
    got = layout.height_batches(df, 600, 30, 500).orderBy("seq").collect()
    assert [(r.batch_idx, r.row_idx) for r in got] == [(0, 0), (1, 0)]


def test_grid_coordinates(spark):
    df = spark.createDataFrame(
        [(1, 0, 0, 0, 100, 50), (1, 0, 0, 1, 80, 31), (1, 0, 1, 0, 60, 20)],
        "doc_id bigint, batch_idx bigint, row_idx bigint, row_ord bigint, w bigint, h bigint",
    )
    got = layout.grid_coordinates(df, 30, True).orderBy("cell_idx").collect()
    assert [(r.cell_idx, r.gx1, r.gy1) for r in got] == [(0, 30, 30), (1, 166, 39), (2, 30, 116)]
    facts = layout.grid_facts(df).first()
    assert (facts.n_rows, facts.max_cols, facts.total_cells) == (2, 2, 3)
