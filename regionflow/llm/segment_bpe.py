"""Byte-pair merging with a segment tree over adjacent pair ranks.

Each leaf holds one adjacent pair's (rank, place); the root is the leftmost pair of the
lowest rank. A merge changes three leaves, each a point update of logarithmic cost.
Short pre-tokens are merged side by side, one tree per row of a numpy array; a long
one has a tree of its own.
"""

from __future__ import annotations

import numpy as np

NONE = np.int64(1) << np.int64(60)
#: Pre-tokens of more symbols than this get a tree of their own.
WIDE = 64
#: Rows of one array of trees.
ROWS = 20_000


class Merges:
    """Pair (left, right) -> (rank, merged symbol)."""

    def __init__(self, left, right, rank, merged, symbols: int):
        key = np.asarray(left, np.int64) * symbols + np.asarray(right, np.int64)
        order = np.argsort(key, kind="stable")
        self.symbols = symbols
        self.keys = np.append(key[order], np.int64(2) ** 62)
        self.ranks = np.append(np.asarray(rank, np.int64)[order], NONE)
        self.merged = np.append(np.asarray(merged, np.int64)[order], -1)
        self.table = None

    def find(self, left, right):
        """Index of each pair, or the last index (rank NONE) if it cannot be merged."""
        key = left * self.symbols + right
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), at, len(self.keys) - 1)

    def merge_all(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge every pre-token; ``flat`` holds their symbols one after another.

        Returns the remaining symbols in the same manner. Negative symbols never merge.
        """
        starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        out = flat.astype(np.int64, copy=True)
        alive = np.ones(len(flat), bool)
        width = 1
        while width < WIDE:
            rows = np.flatnonzero((lengths > width) & (lengths <= 2 * width) if width > 1 else (lengths == 2))
            for k in range(0, len(rows), ROWS):
                self._forest(out, alive, starts[rows[k : k + ROWS]], lengths[rows[k : k + ROWS]], 2 * width)
            width *= 2
        for row in np.flatnonzero(lengths > WIDE):
            self._tree(out, alive, int(starts[row]), int(lengths[row]))
        before = np.concatenate(([0], np.cumsum(alive)))
        return out[alive], before[starts + lengths] - before[starts]

    def _forest(self, out, alive, starts, lengths, leaves) -> None:
        n, w = len(starts), leaves + 2
        place = np.arange(leaves)
        at = starts[:, None] + place
        sym = np.full((n, w), -1, np.int64)
        sym[:, :leaves] = np.where(place < lengths[:, None], out[np.minimum(at, len(out) - 1)], -1)
        pair = self.find(sym[:, :leaves], sym[:, 1 : leaves + 1])
        tree = np.full((n, 2 * leaves), NONE, np.int64)
        ranks = self.ranks[pair]
        tree[:, leaves:] = np.where(ranks < NONE, ranks * leaves + place, NONE)
        level = leaves
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        # Neighbours in the list of symbols left; the two last columns catch the ends.
        nxt = np.tile(np.arange(1, w + 1), (n, 1))
        prv = np.tile(np.arange(-1, w - 1), (n, 1))
        prv[:, 0] = leaves + 1
        live = np.ones((n, w), bool)
        tree, sym, pair, nxt, prv, live = (x.reshape(-1) for x in (tree, sym, pair, nxt, prv, live))
        row = np.flatnonzero(tree.reshape(n, -1)[:, 1] < NONE)
        while len(row):
            tb, sb, pb = row * (2 * leaves), row * w, row * leaves
            here = tree[tb + 1] % leaves
            right = nxt[sb + here]
            after = nxt[sb + right]
            before = prv[sb + here]
            symbol = self.merged[pair[pb + here]]
            sym[sb + here] = symbol
            live[sb + right] = False
            nxt[sb + here] = after
            prv[sb + np.minimum(after, leaves)] = here
            self._put(tree, pair, tb, pb, leaves, right, None)
            self._put(tree, pair, tb, pb, leaves, here, self.find(symbol, sym[sb + np.minimum(after, leaves)]))
            inner = before <= leaves
            if inner.any():
                b = before[inner]
                found = self.find(sym[sb[inner] + b], symbol[inner])
                self._put(tree, pair, tb[inner], pb[inner], leaves, b, found)
            row = row[tree[tb + 1] < NONE]
        kept = live.reshape(n, w)[:, :leaves] & (place < lengths[:, None])
        inside = place < lengths[:, None]
        alive[at[inside]] = kept[inside]
        out[at[inside]] = sym.reshape(n, w)[:, :leaves][inside]

    def _put(self, tree, pair, tb, pb, leaves, leaf, found) -> None:
        """Point update of one leaf per tree. The last symbol's leaf stays empty."""
        leaf = np.minimum(leaf, leaves - 1)
        if found is None:
            value = np.full(len(leaf), NONE, np.int64)
        else:
            pair[pb + leaf] = found
            rank = self.ranks[found]
            value = np.where(rank < NONE, rank * leaves + leaf, NONE)
        node = leaf + leaves
        tree[tb + node] = value
        node >>= 1
        while node[0] >= 1:
            tree[tb + node] = np.minimum(tree[tb + 2 * node], tree[tb + 2 * node + 1])
            node >>= 1

    def _tree(self, out, alive, start: int, length: int) -> None:
        if self.table is None:
            self.table = dict(zip(self.keys[:-1].tolist(), zip(self.ranks[:-1].tolist(), self.merged[:-1].tolist())))
        table, many, none = self.table, self.symbols, int(NONE)
        sym = out[start : start + length].tolist()
        leaves = 1 << (length - 1).bit_length()

        def value(a: int, b: int, at: int) -> int:
            got = table.get(a * many + b) if a >= 0 and b >= 0 else None
            return none if got is None else got[0] * leaves + at

        tree = [none] * (2 * leaves)
        for k in range(length - 1):
            tree[leaves + k] = value(sym[k], sym[k + 1], k)
        for k in range(leaves - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(leaf: int, new: int) -> None:
            node = leaf + leaves
            tree[node] = new
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                low = a if a < b else b
                if tree[node] == low:
                    return
                tree[node] = low
                node >>= 1

        nxt, prv, live = list(range(1, length + 1)), list(range(-1, length - 1)), [True] * length
        while tree[1] < none:
            here = tree[1] % leaves
            right = nxt[here]
            after, before = nxt[right], prv[here]
            sym[here] = table[sym[here] * many + sym[right]][1]
            live[right] = False
            nxt[here] = after
            put(right, none)
            if after < length:
                prv[after] = here
                put(here, value(sym[here], sym[after], here))
            else:
                put(here, none)
            if before >= 0:
                put(before, value(sym[before], sym[here], before))
        out[start : start + length] = sym
        alive[start : start + length] = live
