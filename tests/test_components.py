import random
import time

import numpy as np

from regionflow.operators import components as K
from tests.pictures import mask_blocks


def flood(points):
    left, found = set(points), []
    while left:
        stack, area = [left.pop()], []
        while stack:
            y, x = stack.pop()
            area.append((y, x))
            for n in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if n in left:
                    left.remove(n)
                    stack.append(n)
        ys, xs = [p[0] for p in area], [p[1] for p in area]
        found.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(area)))
    return sorted(found)


def test_components_across_tiles(spark):
    rnd = random.Random(3)
    pages = {
        0: {(y, x) for y in range(150) for x in range(140) if rnd.random() < 0.6},
        # A snake through many tiles.
        1: {(y, x) for y in range(0, 200, 2) for x in range(130)}
        | {(y, 129 if y % 4 == 1 else 0) for y in range(1, 199, 2)},
        # Corners that touch only across, and a ring around a tile's corner.
        2: {(63, 63), (64, 64), (10, 63), (11, 64)} | {(y, x) for y in range(60, 69) for x in range(120, 137) if y in (60, 68) or x in (120, 136)},
        3: set(),
    }
    masks = {}
    for p, points in pages.items():
        masks[0, p] = np.zeros((310, 200), np.uint8)
        for y, x in points:
            masks[0, p][y, x] = 255
    masks[0, 0][300, 5] = 100
    df = mask_blocks(spark, masks)
    got = {p: [] for p in pages}
    for r in K.components(df).collect():
        got[r.page_idx].append((r.x1, r.y1, r.x2, r.y2, r.pixels))
    assert {p: sorted(v) for p, v in got.items()} == {p: flood(v) for p, v in pages.items()}
    assert K.components(df, min_size=30).filter("page_idx = 1").count() == 1


def test_runs_of_a_tile_equal_flooding():
    rng = np.random.default_rng(1)
    for share in (0.1, 0.5, 0.6, 0.9):
        text = rng.random((37, 64)) < share
        row, start, end = K.rows_of(text)
        root = K.label_runs(row, start, end)
        found = []
        for r in np.unique(root):
            mine = root == r
            found.append((start[mine].min(), row[mine].min(), end[mine].max(), row[mine].max() + 1, (end - start)[mine].sum()))
            assert r == np.flatnonzero(mine)[0]
        assert sorted(map(tuple, np.array(found).tolist())) == flood(list(zip(*map(np.ndarray.tolist, np.nonzero(text)))))


def test_only_runs_leave_a_tile(spark):
    """A full tile is one area and four border runs, whatever its pixels."""
    df = mask_blocks(spark, {(0, 0): np.full((128, 128), 255, np.uint8)})
    assert K.label_tiles(df).count() == 4 * 5
    start = time.time()
    K.label_runs(*K.rows_of(np.indices((2000, 2000)).sum(axis=0) % 2 == 0))
    assert time.time() - start < 10
