"""Edit distances of many pairs of texts at once, on arrays; the columns that use them are in `text`."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np

HELD_PAIRS, HELD_CELLS = 1 << 14, 1 << 22  # of one table row: pairs side by side, and their cells


class Texts:
    """Texts as one array of code points, with where each begins and how long it is."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        self.codes, self.sizes = codes, sizes
        self.starts = np.cumsum(sizes) - sizes

    @classmethod
    def of(cls, texts: list[str]) -> Texts:
        return cls(np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.int32), np.fromiter(map(len, texts), np.int64, len(texts)))

    def take(self, which: np.ndarray) -> Texts:
        sizes = self.sizes[which]
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return Texts(self.codes[np.repeat(self.starts[which], sizes) + within], sizes)

    def then(self, other: Texts) -> Texts:
        return Texts(np.concatenate([self.codes, other.codes]), np.concatenate([self.sizes, other.sizes]))

    def columns(self, which: np.ndarray, width: int, pad: int) -> np.ndarray:
        """A row for each place, a column for each text; pad behind a text's end."""
        places = np.arange(width)[:, None]
        inside = places < self.sizes[which]
        return np.where(inside, self.codes[np.where(inside, places + self.starts[which], 0)], pad) if len(self.codes) else np.full(inside.shape, pad)


def _osa(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    kind = np.int16 if max(len(a), len(b)) < 1 << 14 else np.int32
    pairs = np.arange(a.shape[1])
    steps = np.arange(len(b) + 1, dtype=kind)[:, None]
    above, second = np.repeat(steps, a.shape[1], axis=1), None
    out = lb.astype(kind)
    for i in range(len(a)):
        row = np.empty_like(above)
        row[0] = i + 1
        cost = (b != a[i]).astype(kind)
        np.minimum(above[1:] + 1, above[:-1] + cost, out=row[1:])
        if i and len(b) > 1:
            swap = (b[:-1] == a[i]) & (b[1:] == a[i - 1])
            row[2:] = np.where(swap, np.minimum(row[2:], second[:-2] + cost[1:]), row[2:])
        row = np.minimum.accumulate(row - steps, axis=0) + steps
        ends = pairs[la == i + 1]
        out[ends] = row[lb[ends], ends]
        above, second = row, above
    return out


def osa_and_prefix(a: Texts, b: Texts, which_a: np.ndarray, which_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair of texts the optimal string alignment distance (edits and swaps of neighbours, no substring edited twice) and
    the number of letters that both begin with. Pairs of like lengths are worked on side by side, so that a long one costs itself."""
    la, lb = a.sizes[which_a], b.sizes[which_b]
    longest = np.maximum(la, lb)
    order = np.argsort(longest, kind="stable")
    distance, same = np.zeros(len(order), dtype=np.int32), np.zeros(len(order), dtype=np.int32)
    at = 0
    while at < len(order):
        n = min(HELD_PAIRS, len(order) - at)
        while n > 1 and n * (longest[order[at + n - 1]] + 1) > HELD_CELLS:
            n //= 2
        now = order[at : at + n]
        x, y = a.columns(which_a[now], int(la[now].max()), -1), b.columns(which_b[now], int(lb[now].max()), -2)
        distance[now] = _osa(x, y, la[now], lb[now])
        both = min(len(x), len(y))
        same[now] = np.logical_and.accumulate(x[:both] == y[:both], axis=0).sum(axis=0) if both else 0
        at += n
    return distance, same


def _score(distance: int, same: int, longest: int) -> float:
    score = (1.0 - distance / longest) * 100 * 0.75 + same / longest * 100 * 0.25
    return float(Decimal(repr(score)).quantize(Decimal("0.01"), ROUND_HALF_EVEN))


def similarities(a: Texts, b: Texts, which_a: np.ndarray, which_b: np.ndarray) -> np.ndarray:
    """text.similarity of each pair. Scores depend on three small numbers, so each combination is rounded once, as decimals are."""
    distance, same = osa_and_prefix(a, b, which_a, which_b)
    la, lb = a.sizes[which_a], b.sizes[which_b]
    longest = np.maximum(la, lb)
    of = np.stack([distance.astype(np.int64), same.astype(np.int64), longest], axis=1)
    base = int(of.max(initial=0)) + 1
    told, at = np.unique((of[:, 0] * base + of[:, 1]) * base + of[:, 2], return_inverse=True)
    scores = np.array([_score(int(t) // base // base, int(t) // base % base, int(t) % base) if t % base else 0.0 for t in told])[at] if len(told) else np.zeros(0)
    return np.where((la == 0) | (lb == 0), 0.0, np.where((distance == 0) & (la == lb), 100.0, scores))
