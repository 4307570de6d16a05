"""Tile blocks from arrays, for tests."""

import numpy as np

from regionflow.operators import blocks as B
from regionflow.operators import masks as M


def tiles(array):
    for y in range(0, array.shape[0], 64):
        for x in range(0, array.shape[1], 64):
            yield y // 64, x // 64, array[y : y + 64, x : x + 64]


def mask_blocks(spark, pages):
    """``pages``: (doc_id, page_idx) to a mask."""
    rows = [(*key, ty, tx, *t.shape, t.size, M.pack(t)) for key, mask in pages.items() for ty, tx, t in tiles(mask)]
    return spark.createDataFrame(rows, M.MASK_BLOCK).repartition(3)


def picture_blocks(spark, pages):
    """``pages``: (doc_id, page_idx) to a picture of red, green, blue and mask."""
    rows = [(*key, ty, tx, *t.shape[:2], t[:, :, 0].size, t.tobytes()) for key, picture in pages.items() for ty, tx, t in tiles(picture)]
    return spark.createDataFrame(rows, B.BLOCK).repartition(3)


def whole(rows, shapes, unpack):
    """Blocks put together again."""
    out = {key: np.zeros(shape, np.uint8) for key, shape in shapes.items()}
    for r in rows:
        page = out[r.doc_id, r.page_idx]
        spot = page[r.ty * 64 : r.ty * 64 + r.h, r.tx * 64 : r.tx * 64 + r.w]
        spot[...] = unpack(r)[: spot.shape[0], : spot.shape[1]]
    return out
