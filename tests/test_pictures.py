"""Mask blocks and clearing against plain whole-page code."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionflow.operators import blocks as B
from regionflow.operators import masks as M
from tests.pictures import mask_blocks, picture_blocks, whole


def test_packed_masks():
    rng = np.random.default_rng(0)
    shapes = [(1, 1), (1, 4), (2, 3), (5, 1), (64, 64), (130, 70)]
    for h, w in shapes:
        for mask in (np.zeros((h, w), np.uint8), np.full((h, w), 7, np.uint8), rng.integers(0, 256, (h, w)).astype(np.uint8), np.repeat(rng.integers(0, 3, (h, 1)), w, 1).astype(np.uint8)):
            body = M.pack(mask)
            assert (M.unpack(body, h, w) == mask).all() and len(body) <= h * w
    assert len(M.pack(np.zeros((64, 64)))) == 5


def test_grid_masks_on_pages(spark):
    rng = np.random.default_rng(2)
    grids = {(1, b): np.where(rng.random((150, 170)) < 0.4, rng.integers(1, 256, (150, 170)), 0).astype(np.uint8) for b in range(2)}
    cells, expected = [], {(1, p): np.zeros((260, 330), np.uint8) for p in range(3)}
    for k in range(40):
        gx, gy, bx, by = (int(v) for v in (rng.integers(0, 100), rng.integers(0, 80), rng.integers(0, 150), rng.integers(0, 120)))
        gw, gh = int(rng.integers(1, 70)), int(rng.integers(1, 70))
        w, h = (gw, gh) if k % 3 == 0 else (int(rng.integers(1, 160)), int(rng.integers(1, 130)))
        page = int(rng.integers(3))
        cells.append((1, k % 2, page, gx, gy, gx + gw, gy + gh, bx, by, bx + w, by + h))
        ys = gy + np.floor((np.arange(h) + 0.5) * gh / h).astype(int)
        xs = gx + np.floor((np.arange(w) + 0.5) * gw / w).astype(int)
        spot = expected[1, page][by : by + h, bx : bx + w]
        np.maximum(spot, grids[1, k % 2][np.ix_(ys, xs)], out=spot)
    names = "doc_id, batch_idx, page_idx, gx1, gy1, gx2, gy2, bx1, by1, bx2, by2".split(", ")
    df = spark.createDataFrame(cells, ", ".join(f"{c} bigint" for c in names))
    got = M.grid_mask_to_pages(mask_blocks(spark, grids).withColumnRenamed("page_idx", "batch_idx"), df).collect()
    assert len({(r.doc_id, r.page_idx, r.ty, r.tx) for r in got}) == len(got)
    made = whole(got, {k: v.shape for k, v in expected.items()}, lambda r: M.unpack(r.m, r.h, r.w))
    assert all((made[k] == expected[k]).all() for k in expected)


@pytest.mark.parametrize("top", [1.0, 1.5, 300.0])
def test_model_masks_are_scaled_by_their_page(spark, top):
    values = np.linspace(0, top, 128 * 70).reshape(128, 70)
    rows = [(0, 0, ty, tx, *t.shape, t.size, np.ascontiguousarray(t).tobytes()) for ty in range(2) for tx in range(2) for t in [values[ty * 64 : ty * 64 + 64, tx * 64 : tx * 64 + 64]]]
    got = M.normalise_mask(spark.createDataFrame(rows, M.MASK_BLOCK)).collect()
    made = whole(got, {(0, 0): values.shape}, lambda r: M.unpack(r.m, r.h, r.w))[0, 0]
    assert (made == (values * 255 if top <= 1 else np.clip(values, 0, 255)).astype(np.uint8)).all()


def edges(region):
    return np.concatenate([region[0], region[-1], region[1:-1, 0], region[1:-1, -1]])


def white_edges(region):
    return min(region[0].min(), region[-1].min(), region[:, 0].min(), region[:, -1].min()) >= 240


def median_fill(region):
    return np.median(edges(region), axis=0).astype(np.uint8) if region.shape[0] > 2 and region.shape[1] > 2 else None


def under_mask(picture, mask, box):
    x1, y1, x2, y2 = box
    region, text = picture[y1:y2, x1:x2], mask[y1:y2, x1:x2] > 5
    if text.any():
        colour = np.median(region[~text], axis=0).astype(np.uint8) if (~text).any() else 255
        wide = text
        for _ in range(2):
            pad = np.pad(wide, 1)
            wide = pad[1:-1, 1:-1] | pad[:-2, 1:-1] | pad[2:, 1:-1] | pad[1:-1, :-2] | pad[1:-1, 2:]
        region[wide] = colour


def cleared(picture, mask, regions, has_mask):
    """Every region's boxes in order, on the page as it is by then."""
    height, width = mask.shape
    for _, box, translated, lines in regions:
        if not translated or translated.startswith("["):
            continue
        area = sum((x2 - x1) * (y2 - y1) for (x1, y1, x2, y2), _ in lines)
        small = lines and area < (box[2] - box[0]) * (box[3] - box[1]) * 0.7
        by_char = small and any(chars for _, chars in lines)
        if not by_char and has_mask and not small:
            under_mask(picture, mask, box)
            continue
        for line, chars in lines:
            def cut(b):
                x1, y1, x2, y2 = b
                return max(0, min(x1, width - 1)), max(0, min(y1, height - 1)), max(0, min(x2, width)), max(0, min(y2, height))
            x1, y1, x2, y2 = cut(line)
            if x2 <= x1 or y2 <= y1:
                continue
            white = white_edges(picture[y1:y2, x1:x2])
            if by_char and chars:
                for c1, d1, c2, d2 in map(cut, chars):
                    if c2 > c1 and d2 > d1:
                        fill = median_fill(picture[d1:d2, c1:c2])
                        picture[d1:d2, c1:c2] = 255 if white or fill is None else fill
            elif white:
                picture[y1:y2, x1:x2] = 255
            elif has_mask and not by_char:
                under_mask(picture, mask, (x1, y1, x2, y2))
            elif (fill := median_fill(picture[y1:y2, x1:x2])) is not None:
                picture[y1:y2, x1:x2] = fill


@pytest.mark.parametrize("has_mask", [True, False])
def test_clearing_by_all_rules(spark, has_mask):
    """Characters lie over each other and lines too, so colours depend on what was filled before."""
    rng = np.random.default_rng(9)
    pages, planned, expected = {}, [], {}
    for page in range(4):
        picture = rng.choice([[250, 251, 252], [90, 120, 30], [200, 10, 60]], (200, 150), p=[0.5, 0.3, 0.2]).astype(np.uint8)
        picture[:, 75:] = np.where(rng.random((200, 75, 1)) < 0.97, 255, picture[:, 75:])
        mask = np.where(rng.random((200, 150)) < 0.08, 200, 0).astype(np.uint8)
        regions = []
        for k in range(12):
            x, y = 5 + 72 * (k % 2), 2 + 33 * (k // 2)
            box = (x, y, x + int(rng.integers(20, 70)), y + int(rng.integers(10, 32)))
            lines = []
            for n in range(int(rng.integers(0, 4))):
                a, b = int(rng.integers(box[0] - 3, box[2])), int(rng.integers(box[1], box[3]))
                line = (a, b, min(a + int(rng.integers(1, 25)), box[2]), min(b + int(rng.integers(1, 14)), box[3]))
                many = int(rng.integers(0, 4)) if k % 3 else 0
                chars = [(line[0] + c * 4 - 1, line[1], line[0] + c * 4 + 5, line[3]) for c in range(many)]
                lines.append((line, chars))
            if k == 5:
                lines = [(box, [])]
            regions.append((k, box, ["done", "done", "[NO TEXT]"][int(rng.integers(3)) if k > 3 else 0], lines))
        pages[0, page] = np.concatenate([picture, mask[:, :, None]], axis=2)
        planned += [(page, *r) for r in regions]
        after = picture.copy()
        cleared(after, mask, regions, has_mask)
        expected[0, page] = after
    texts = [(0, page, k, n, *line, [list(c) for c in chars]) for page, k, _, _, lines in planned for n, (line, chars) in enumerate(lines)]
    rows = [(0, page, k, *box, 150, 200, said) for page, k, box, said, _ in planned]
    key = "doc_id bigint, page_idx bigint, region_id bigint, "
    box = "x1 bigint, y1 bigint, x2 bigint, y2 bigint, "
    df = B.clear_text(
        picture_blocks(spark, pages), spark.createDataFrame(rows, key + box + "width bigint, height bigint, translated string"),
        spark.createDataFrame(texts, key + "line_no bigint, " + box + "chars array<array<bigint>>"), has_mask,
    )
    got = whole(df.collect(), {k: v.shape for k, v in pages.items()}, lambda r: B.picture(r.px, r.h, r.w))
    for k, after in expected.items():
        assert (got[k][:, :, :3] == after).all() and (got[k][:, :, 3] == pages[k][:, :, 3]).all()
        assert (after != pages[k][:, :, :3]).any()


def test_facts_are_asked_by_name(spark):
    rng = np.random.default_rng(4)
    blocks = picture_blocks(spark, {(0, 0): rng.integers(0, 256, (90, 130, 4)).astype(np.uint8)})
    regions = spark.createDataFrame([(0, 0, 1, -5, 3, 100, 80, 130, 90), (0, 0, 2, 200, 3, 210, 9, 130, 90)], "doc_id bigint, page_idx bigint, region_id bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint, width bigint, height bigint")
    every = {r.region_id: r for r in B.judged(B.region_facts(blocks, regions)).collect()}
    for kind in B.FACTS:
        some = B.judged(B.region_facts(blocks, regions, kind))
        assert set(some.columns) < set(B.judged(B.region_facts(blocks, regions)).columns)
        for r in some.collect():
            assert all(r[c] == every[r.region_id][c] for c in some.columns)
    assert every[1].n == 100 * 77 and every[2].n is None
    assert B.region_facts(blocks.filter(F.lit(False)), regions).filter("n IS NULL").count() == 2
