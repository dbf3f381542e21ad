"""Gradient-boosted trees: histogram splits, monotonic constraints, flat node arrays.

Rows lie in blocks. A level of a tree takes one sum over all blocks, of whole numbers, so that a forest is the
same bits however rows are spread; several models, each on all rows but one fold, grow side by side.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple, Protocol

import numpy as np

BINS = 64
#: Gradients are summed in whole multiples of 2**-30: a block's sums are exact in double, all sums in 64 bits.
UNIT = 2.0**30
#: A node that is not split sends all its rows to the left.
UNSPLIT = 255
#: Trees after which blocks keep their new raw scores; until then each sum walks the trees anew.
KEPT_AFTER = 10
_LOW = (1 << 40) - 1
_REST = np.int64((1 << 63) - 1)


@dataclass
class Forest:
    """All trees in one set of node arrays; a leaf points at itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots.tolist():
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return squashed(self.raw(x))


def squashed(raw: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def keys(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of finite values, which tell apart what differs in the first 13 binary digits."""
    bits = (np.asarray(x, np.float64) + 0.0).view(np.int64)
    return (bits ^ ((bits >> 63) & _REST)) >> 40


def lowest(key: np.ndarray) -> np.ndarray:
    """The least value of each key."""
    bits = np.asarray(key, np.int64) << 40
    return (bits ^ ((bits >> 63) & _REST)).view(np.float64)


def highest(key: np.ndarray) -> np.ndarray:
    """The greatest value of each key."""
    bits = (np.asarray(key, np.int64) << 40) | _LOW
    return (bits ^ ((bits >> 63) & _REST)).view(np.float64)


class Tree(NamedTuple):
    """A whole tree in binned features: children of k are 2k + 1 and 2k + 2; values of the leaves below."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray


class Block(NamedTuple):
    """Some rows: a line of bins for each feature, class, fold, and a line of raw scores for each model."""

    binned: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    raw: np.ndarray


class Blocks(Protocol):
    """All rows, wherever they are."""

    def total(self, part: Callable[[Block], np.ndarray]) -> np.ndarray:
        """The sum of an array of each block."""

    def change(self, part: Callable[[Block], Block]) -> None:
        """Put other blocks in the place of all."""


class InMemory:
    """One block here."""

    def __init__(self, block: Block):
        self.block = block

    def total(self, part):
        return part(self.block)

    def change(self, part):
        self.block = part(self.block)


def block(x: np.ndarray, y: np.ndarray, fold: np.ndarray, cuts: list[np.ndarray], bases: list[float]) -> Block:
    binned = np.array([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], np.uint8).reshape(len(cuts), len(x))
    return Block(binned, y.astype(np.uint8), fold.astype(np.uint8), np.repeat(np.array(bases, float)[:, None], len(x), 1))


def places(binned: np.ndarray, tree: Tree, levels: int) -> np.ndarray:
    """Where each row is, within the level."""
    at = np.zeros(binned.shape[1], np.int64)
    for level in range(levels):
        right, first = np.zeros(binned.shape[1], bool), 2**level - 1
        for k in range(2**level):
            if tree.cut[first + k] != UNSPLIT:
                right |= (at == k) & (binned[tree.feature[first + k]] > tree.cut[first + k])
        at = 2 * at + right
    return at


def raised(b: Block, since: list[list[Tree]], depth: int) -> Block:
    """The block with the values of more trees; ``since`` has one tree for each model in every item."""
    raw = b.raw.copy()
    for trees in since:
        for m, tree in enumerate(trees):
            raw[m] += tree.value[places(b.binned, tree, depth)]
    return b._replace(raw=raw)


def histograms(b: Block, since: list[list[Tree]], now: list[Tree], depth: int, level: int) -> np.ndarray:
    """Sums of gradients, of weights and of rows by model, node of the level, feature and bin."""
    out = np.zeros((len(now), 2**level, len(b.binned), BINS, 3), np.int64)
    raw, size = raised(b, since, depth).raw, 2**level * BINS
    for m, tree in enumerate(now):
        used = b.fold != m
        p = 1 / (1 + np.exp(-raw[m]))
        g, h = np.rint((b.y - p) * UNIT) * used, np.rint(p * (1 - p) * UNIT) * used
        start = places(b.binned, tree, level) * BINS
        for j, bins in enumerate(b.binned):
            at = start + bins
            for k, w in enumerate((g, h, used)):
                out[m, :, j, :, k] = np.bincount(at, w, size).reshape(-1, BINS)
    return out


def base_value(n: int, ones: int) -> float:
    p0 = min(max(ones / n if n else 0.5, 1e-3), 1 - 1e-3)
    return float(np.log(p0 / (1 - p0)))


def boost(
    blocks: Blocks, cuts: list[np.ndarray], counts: list[tuple[int, int]], monotone: list[int], *, trees: int = 60, depth: int = 3, rate: float = 0.2,
    least: int = 5, ridge: float = 1.0
) -> list[Forest]:
    """Logistic boosting of a model for each item of ``counts``, its rows and those of class 1; model m leaves fold m out.

    monotone[j] is -1, 0 or 1 for the direction feature j must push in. A model with a single class, or without
    rows, is its base value alone. Afterwards the blocks hold the raw scores.
    """
    grown: list[list[Tree]] = []
    since: list[list[Tree]] = []
    idle = [not 0 < ones < n for n, ones in counts]

    def split(hist: np.ndarray, lo: float, hi: float) -> tuple[float, int, int, float]:
        """(gain, feature, cut, middle of the children's values) of the best split of a node; the feature is -1 if there is none."""
        cg, ch, cn = (np.cumsum(hist[:, :, k], 1)[:, :-1] for k in range(3))
        gs, hs, n = hist[0].sum(0)
        cg, ch, gs, hs = cg / UNIT, ch / UNIT, gs / UNIT, hs / UNIT
        here = min(max(gs / (hs + ridge), lo), hi)
        vl, vr = np.clip(cg / (ch + ridge), lo, hi), np.clip((gs - cg) / (hs - ch + ridge), lo, hi)
        fine = (cn >= least) & (n - cn >= least) & ((vr - vl) * np.array(monotone)[:, None] >= 0)
        fine &= np.arange(BINS - 1) < np.array([[len(c)] for c in cuts])
        # Gain of the clipped values, so that bounds count.
        gain = 2 * (cg * vl + (gs - cg) * vr) - (ch + ridge) * vl**2 - (hs - ch + ridge) * vr**2 - (2 * gs * here - (hs + ridge) * here**2)
        gain = np.where(fine, gain, -1)
        j, k = np.unravel_index(int(np.argmax(gain)), gain.shape)
        return (float(gain[j, k]), int(j), int(k), float(vl[j, k] + vr[j, k]) / 2) if gain[j, k] > 1e-6 else (0.0, -1, UNSPLIT, 0.0)

    for _ in range(trees if cuts and not all(idle) else 0):
        now = [Tree(np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, UNSPLIT), np.zeros(2**depth)) for _ in counts]
        bounds = [{0: (-8.0, 8.0)} for _ in counts]
        for level in range(depth):
            sums = blocks.total(lambda b, s=list(since), t=now, d=depth, v=level: histograms(b, s, t, d, v))
            for m, tree in enumerate(now):
                for k in [] if idle[m] else range(2**level):
                    at = 2**level - 1 + k
                    if at not in bounds[m]:
                        continue
                    (lo, hi), hist = bounds[m][at], sums[m, k]
                    _, j, cut, mid = split(hist, lo, hi)
                    if j >= 0:
                        tree.feature[at], tree.cut[at] = j, cut
                        sides = {1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid)), 0: ((lo, hi), (lo, hi))}[monotone[j]]
                        bounds[m][2 * at + 1], bounds[m][2 * at + 2] = sides
                        parts = (hist[j, : cut + 1].sum(0), (2 * at + 1, sides[0])), (hist[j, cut + 1 :].sum(0), (2 * at + 2, sides[1]))
                    else:
                        parts = ((hist[0].sum(0), (at, (lo, hi))),)
                    for (g, h, _), (node, (a, b)) in parts:
                        # The leftmost place below a node stands for it while it is not split.
                        leaf = node
                        while leaf < 2**depth - 1:
                            leaf = 2 * leaf + 1
                        tree.value[leaf - (2**depth - 1)] = rate * min(max(g / UNIT / (h / UNIT + ridge), a), b)
        grown.append(now)
        since.append(now)
        if len(since) == KEPT_AFTER:
            blocks.change(lambda b, s=since, d=depth: raised(b, s, d))
            since = []
    if since:
        blocks.change(lambda b, s=since, d=depth: raised(b, s, d))
    return [flat([] if idle[m] else [trees[m] for trees in grown], cuts, depth, base_value(*counts[m])) for m in range(len(counts))]


def flat(trees: list[Tree], cuts: list[np.ndarray], depth: int, base: float) -> Forest:
    """The trees as node arrays, cuts as values of the features."""
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node(tree: Tree, at: int) -> int:
        while at < 2**depth - 1 and tree.cut[at] == UNSPLIT:
            at = 2 * at + 1
        me = len(feature)
        for column, v in ((feature, 0), (threshold, 0.0), (left, me), (right, me), (value, 0.0)):
            column.append(v)
        if at >= 2**depth - 1:
            value[me] = float(tree.value[at - (2**depth - 1)])
        else:
            feature[me], threshold[me] = int(tree.feature[at]), float(cuts[tree.feature[at]][tree.cut[at]])
            left[me] = node(tree, 2 * at + 1)
            right[me] = node(tree, 2 * at + 2)
        return me

    for tree in trees:
        roots.append(node(tree, 0))
    return Forest(
        np.array(feature, np.int64), np.array(threshold, float), np.array(left, np.int64), np.array(right, np.int64),
        np.array(value, float), np.array(roots, np.int64), depth, base
    )


def cuts_of(x: np.ndarray) -> list[np.ndarray]:
    """For each feature, the values that end its bins of about equal numbers of rows."""
    out = []
    for j in range(x.shape[1]):
        found, n = np.unique(keys(x[:, j]), return_counts=True)
        upto = np.minimum(np.cumsum(n) * BINS // max(len(x), 1), BINS - 1)
        out.append(highest(found[np.diff(upto, prepend=0) > 0]))
    return out


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], **options) -> Forest:
    """A forest on rows held here."""
    cuts, counts = cuts_of(x), [(len(y), int(y.sum()))]
    rows = InMemory(block(x, y, np.full(len(y), UNSPLIT), cuts, [base_value(*counts[0])]))
    return boost(rows, cuts, counts, monotone, **options)[0]
