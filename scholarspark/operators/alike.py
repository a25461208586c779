"""Pairs of alike texts of two blocks: each pair is met, and left out only by bounds that the ratio cannot beat.

The ratio is 2M/(n+m) for M matched characters, which are a common subsequence. So what the counts of two texts' characters
differ by is at most what may stay unmatched, and their longest common subsequence is at least M. The first bound is one
product of matrices for all pairs of a tile, the second runs over the pairs left, a character of all at a time.
"""

from __future__ import annotations

import difflib

import numpy as np

#: Characters are told apart by so many values of a hash; characters that share one only weaken the bounds.
BAGS, SYMBOLS = 32, 64
#: Most that a count of characters counts.
LEVELS = 40
#: Rows of the two blocks that meet in one product.
TILE = (1024, 4096)
#: Most words of 64 characters of a text for which common subsequences are found side by side.
WORDS = 16
#: Characters after which pairs that are too far apart already are left out.
STEP = 12


class Texts:
    """Lengths, counts of characters and characters of a list of texts that are not empty."""

    def __init__(self, texts: list[str], threshold: float):
        self.texts = texts
        self.n = np.array([len(t) for t in texts], np.int64)
        code = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4") * np.uint32(2654435761)
        self.symbol = (code >> np.uint32(26)).astype(np.uint8)
        self.start = np.concatenate([[0], np.cumsum(self.n)])
        row = np.repeat(np.arange(len(texts)), self.n)
        self.bag = np.minimum(np.bincount(row * BAGS + (self.symbol >> 1), minlength=len(texts) * BAGS).reshape(-1, BAGS), LEVELS)
        self.spare = (self.bag.sum(1) - (1 - threshold) * self.n) / 2

    def levels(self, at: slice, bags: np.ndarray, above: np.ndarray) -> np.ndarray:
        """A row for each text with a 1 for each of its counted characters: products of rows are what two texts have in common."""
        out = np.empty((at.stop - at.start, len(bags) + 2), "f4")
        out[:, :-2] = self.bag[at][:, bags] > above
        return out

    def padded(self, at: slice) -> np.ndarray:
        """The characters of texts, filled up with a symbol that nothing matches."""
        n = self.n[at]
        out = np.full((len(n), int(n.max())), SYMBOLS, np.uint8)
        out[np.arange(out.shape[1]) < n[:, None]] = self.symbol[self.start[at.start] : self.start[at.start + len(n)]]
        return out


def place_masks(symbols: np.ndarray) -> list[np.ndarray]:
    """For each 64 characters the places of each symbol in each text, as the bits of a number at text and symbol."""
    rows, width = symbols.shape
    out = []
    for at in range(0, width, 64):
        part = symbols[:, at : at + 64]
        masks = np.zeros((rows, SYMBOLS + 1), np.uint64)
        for k in range(part.shape[1]):
            masks[np.arange(rows), part[:, k]] |= np.uint64(1) << np.uint64(k)
        masks[:, SYMBOLS] = 0
        out.append(masks.ravel())
    return out


def common_enough(masks: list[np.ndarray], other: np.ndarray, xs: np.ndarray, ys: np.ndarray, m: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Which pairs of a text in ``masks`` and a row of ``other``, ``m`` long, have a common subsequence of ``need`` characters.

    The rows of the usual table are differences held as bits, where a 0 is one more matched character.
    """
    live = np.arange(len(xs))
    at, row, spare, size = xs * (SYMBOLS + 1), ys, m - need, m
    v = [np.full(len(xs), ~np.uint64(0)) for _ in masks]
    width = int(m.max()) if len(m) else 0
    for j in range(width):
        place = at + other[row, j]
        carry = None
        for w, mask in enumerate(masks):
            p = mask[place]
            both = v[w] & p
            added = v[w] + both
            over = added < both
            if carry is not None:
                added += carry
                over |= added < carry
            v[w] = added | (v[w] & ~p)
            carry = over.astype(np.uint64)
        if (j + 1) % STEP == 0 or j + 1 == width:
            matched = 64 * len(masks) - sum(np.bitwise_count(part).astype(np.int64) for part in v)
            keep = np.flatnonzero(np.minimum(j + 1, size) - matched <= spare)
            if len(keep) < len(live):
                live, at, row, spare, size = live[keep], at[keep], row[keep], spare[keep], size[keep]
                v = [part[keep] for part in v]
            if not len(live):
                break
    return live


def alike_pairs(left: list[str], right: list[str], threshold: float, same: bool):
    """``(i, k)`` of texts of two lists whose ratio may reach the threshold; of one list with itself, ``same``, i before k."""
    x, y = Texts(left, threshold), Texts(right, threshold)
    most = np.minimum(x.bag.max(0, initial=0), y.bag.max(0, initial=0))
    bags, above = np.repeat(np.arange(BAGS), most), np.concatenate([np.arange(k) for k in most])
    for a in range(0, len(left), TILE[0]):
        mine = slice(a, min(a + TILE[0], len(left)))
        # what two texts have in common, less half of what may be left over: a product with one more column for either side
        one = x.levels(mine, bags, above)
        one[:, -2], one[:, -1] = -x.spare[mine], 1
        symbols = x.padded(mine)
        masks = place_masks(symbols) if symbols.shape[1] <= 64 * WORDS else None
        for b in range(0, len(right), TILE[1]):
            theirs = slice(b, min(b + TILE[1], len(right)))
            if same and theirs.stop <= a:
                continue
            two = y.levels(theirs, bags, above)
            two[:, -2], two[:, -1] = 1, -y.spare[theirs]
            i, k = np.nonzero(one @ two.T >= -0.05)
            if same:
                i, k = (part[i + a < k + b] for part in (i, k))
            n, m = x.n[a + i], y.n[b + k]
            need = np.ceil((n + m) * (threshold / 2) - 1e-9).astype(np.int64)
            far = np.minimum(n, m) >= need
            i, k, m, need = i[far], k[far], m[far], need[far]
            if masks is not None and len(i):
                live = common_enough(masks, y.padded(theirs), i, k, m, need)
                i, k = i[live], k[live]
            yield from zip((i + a).tolist(), (k + b).tolist(), strict=True)


def ratio(s: str, t: str) -> float:
    """Similarity of two texts by their longest matching blocks; not symmetric, so the order of the sides matters."""
    return difflib.SequenceMatcher(None, s, t).ratio()
