"""Boosted regression trees over packed rows, for tables whose rows do not fit the executors' memory.

The trees are those of Spark ML's ``GBTRegressor``: squared loss, variance impurity, up to 32 bins per
feature cut by its rule, the first tree whole and later ones shrunk. Rows are held in blocks on shared
storage, their features packed into a few numbers of two bytes; each level of a tree reads the blocks once, every task
adds up one table of nodes × features × bins, Spark adds those up, and the driver sees only the sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.runtime import durable
from .features import SeriesRows

BINS = 32
FIT_ROWS = 10_000  # rows in the mean that cut points are fitted on, as many as Spark ML takes
RATE = 0.1  # weight of all trees but the first
LIMIT = 512  # codes per group of features


@dataclass
class Node:
    """A leaf, or a question: rows whose bin of ``feature`` is at most ``bin`` (value at most ``cut``) go left."""

    value: float
    rows: int
    feature: int = -1
    bin: int = 0
    cut: float = 0.0
    gain: float = 0.0
    left: Node | None = None
    right: Node | None = None

    @property
    def leaf(self) -> bool:
        return self.feature < 0


def absent(c: str) -> str:
    return f"(`{c}` IS NULL OR isnan(CAST(`{c}` AS DOUBLE)))"


@dataclass
class Trees:
    """A fitted model. ``flagged`` are the columns with a flag for missing values beside them."""

    cols: list[str]
    flagged: list[str]
    roots: list[Node]
    suffix: str

    @property
    def names(self) -> list[str]:
        return [*self.cols, *(f"{c}{self.suffix}" for c in self.flagged)]

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the forecast in ``yhat``, as one expression of its columns."""
        value = [F.when(F.expr(absent(c)), 0.0).otherwise(F.col(f"`{c}`").cast("double")) for c in self.cols]
        value += [F.expr(absent(c)).cast("double") for c in self.flagged]

        def told(node: Node) -> Column:
            if node.leaf:
                return F.lit(float(node.value))
            return F.when(value[node.feature] <= F.lit(float(node.cut)), told(node.left)).otherwise(told(node.right))

        total = told(self.roots[0])
        for root in self.roots[1:]:
            total = total + told(root) * RATE
        return df.withColumn("yhat", total)

    def importances(self) -> np.ndarray:
        """Share of each feature in what all splits gain, counted by rows."""
        out, todo = np.zeros(len(self.names)), list(self.roots)
        while todo:
            node = todo.pop()
            if not node.leaf:
                out[node.feature] += node.gain * node.rows
                todo += [node.left, node.right]
        return out / out.sum() if out.sum() > 0 else out


def cut_points(values: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` cuts between values: all of them, or those next to equal shares of the rows."""
    v, w = np.unique(values, return_counts=True)
    between = (v[:-1] + v[1:]) / 2
    if len(between) <= most:
        return between
    stride = len(values) / (most + 1)
    target, seen, out = stride, w[0], []
    for i in range(1, len(v)):
        before, seen = seen, seen + w[i]
        if abs(before - target) < abs(seen - target):
            out.append(between[i - 1])
            target += stride
    return np.array(out)


@dataclass(frozen=True)
class Codes:
    """Features packed several to a number: each group is a mixed-radix number below ``LIMIT``."""

    cuts: list[np.ndarray]
    group: list[int]
    base: list[int]
    groups: int

    @staticmethod
    def of(cuts: list[np.ndarray]) -> Codes:
        """Wide features first, each into the first group with room."""
        group, base, room = [0] * len(cuts), [1] * len(cuts), []
        for f in sorted(range(len(cuts)), key=lambda f: -len(cuts[f])):
            radix = len(cuts[f]) + 1
            g = next((g for g, used in enumerate(room) if used * radix <= LIMIT), len(room))
            if g == len(room):
                room.append(1)
            group[f], base[f] = g, room[g]
            room[g] *= radix
        return Codes(cuts, group, base, len(room))

    def pack(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((self.groups, x.shape[1]), np.uint16)
        for f, c in enumerate(self.cuts):
            out[self.group[f]] += (np.searchsorted(c, x[f], side="left") * self.base[f]).astype(np.uint16)
        return out

    def bin_of(self, f: int) -> np.ndarray:
        """The bin of feature ``f`` in each code of its group."""
        return np.arange(LIMIT) // self.base[f] % (len(self.cuts[f]) + 1)

    def questions(self, node: Node) -> dict[int, np.ndarray]:
        """For each question of a tree, which codes of its group go left."""
        if node.leaf:
            return {}
        return {id(node): self.bin_of(node.feature) <= node.bin} | self.questions(node.left) | self.questions(node.right)


def _filled(x: np.ndarray, flagged: list[int]) -> np.ndarray:
    """A missing value is 0, and flags stand below."""
    lacks = np.isnan(x)
    return np.vstack([np.where(lacks, 0.0, x), lacks[flagged]])


def _placed(node: Node, codes: np.ndarray, how: Codes, asked: dict[int, np.ndarray], leaf):
    """``leaf(node)`` of the leaf that each row falls into."""
    if node.leaf:
        return leaf(node)
    left = asked[id(node)].take(codes[how.group[node.feature]])
    return np.where(left, _placed(node.left, codes, how, asked, leaf), _placed(node.right, codes, how, asked, leaf))


def _leaves(root: Node) -> list[Node]:
    return [root] if root.leaf else [*_leaves(root.left), *_leaves(root.right)]


def _residual(roots: list[Node], codes: np.ndarray, how: Codes, asked: dict[int, np.ndarray], label: np.ndarray) -> np.ndarray:
    """What the next tree learns: the label, then twice what the trees before it miss."""
    if not roots:
        return label
    told = np.zeros(len(label))
    for i, root in enumerate(roots):
        told += _placed(root, codes, how, asked, lambda n: n.value) * (RATE if i else 1.0)
    return 2 * (label - told)


def _sums(blocks: DataFrame, roots: list[Node], tree: Node | None, active: list[int], how: Codes) -> tuple[np.ndarray, ...]:
    """Rows and sums per active leaf, feature and bin, and sums of squares per active leaf, over all blocks.

    ``active`` numbers leaves of ``tree`` (None: one leaf holds all rows) in their order.
    """
    d, width, k = len(how.cuts), max(len(c) for c in how.cuts) + 1, len(active)
    size = k * d * width
    slot = {leaf: i for i, leaf in enumerate(active)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, squares = np.zeros((how.groups, k * LIMIT), np.int64), np.zeros((how.groups, k * LIMIT)), np.zeros(k)
        number = {id(leaf): slot.get(i, k) for i, leaf in enumerate(_leaves(tree))} if tree else {}
        asked = {i: t for root in [*roots, *([tree] if tree else [])] for i, t in how.questions(root).items()}
        for batch in batches:
            for packed, labels in zip(batch.column(0), batch.column(1)):
                y = np.frombuffer(labels.as_buffer(), np.float64)
                codes = np.frombuffer(packed.as_buffer(), np.uint16).reshape(how.groups, len(y))
                y, at = _residual(roots, codes, how, asked, y), np.zeros(len(y), np.int64)
                if tree is not None:
                    at += _placed(tree, codes, how, asked, lambda leaf: number[id(leaf)])
                    if (at == k).any():  # rows of leaves that stay
                        here = at < k
                        y, at, codes = y[here], at[here], codes[:, here]
                squares += np.bincount(at, weights=y * y, minlength=k)
                at *= LIMIT
                for g in range(how.groups):
                    cell = at + codes[g]
                    n[g] += np.bincount(cell, minlength=k * LIMIT)
                    s[g] += np.bincount(cell, weights=y, minlength=k * LIMIT)
        rows, total = np.zeros((k, d, width), np.int64), np.zeros((k, d, width))
        for f in range(d):
            b, g = how.bin_of(f), how.group[f]
            for j in range(k):
                cells = slice(j * LIMIT, (j + 1) * LIMIT)
                rows[j, f] = np.bincount(b, weights=n[g, cells], minlength=width)
                total[j, f] = np.bincount(b, weights=s[g, cells], minlength=width)
        rows, total = np.r_[rows.ravel(), np.zeros(k, np.int64)], np.r_[total.ravel(), squares]
        some = np.flatnonzero((rows != 0) | (total != 0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(rows[some]), pa.array(total[some])], ["cell", "n", "s"])

    made = blocks.select("codes", "label").mapInArrow(run, "cell bigint, n bigint, s double")
    n, s = np.zeros(size + k, np.int64), np.zeros(size + k)
    for r in made.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():  # at most size + k rows
        n[r.cell], s[r.cell] = r.n, r.s
    return n[:size].reshape(k, d, width), s[:size].reshape(k, d, width), s[size:]


def _split(leaf: Node, n: np.ndarray, s: np.ndarray, squares: float, cuts: list[np.ndarray]) -> bool:
    """Turn a leaf into the question that lowers the variance most, if any does; of equal ones the first."""
    rows, total = int(n[0].sum()), float(s[0].sum())
    spread = squares / rows - (total / rows) ** 2
    best = (1e-13 * max(spread, 0.0), -1, 0)
    left_n, left_s = np.cumsum(n, axis=1), np.cumsum(s, axis=1)
    for f, c in enumerate(cuts):
        nl, sl = left_n[f, : len(c)], left_s[f, : len(c)]
        nr, sr = rows - nl, total - sl
        ok = (nl > 0) & (nr > 0)
        if ok.any():
            parts = np.where(ok, sl * sl / np.maximum(nl, 1) + sr * sr / np.maximum(nr, 1), -np.inf)
            gain = (parts - total * total / rows) / rows
            i = int(np.argmax(gain >= gain.max() - 1e-12 * abs(gain.max())))
            if gain[i] > best[0] * (1 + 1e-12):  # equal but for rounding: the first stays
                best = (float(gain[i]), f, i)
    gain, f, i = best
    if f < 0 or spread <= np.finfo(float).eps:
        return False
    nl, sl = int(left_n[f, i]), float(left_s[f, i])
    leaf.feature, leaf.bin, leaf.cut, leaf.gain = f, i, float(cuts[f][i]), gain
    leaf.left, leaf.right = Node(sl / nl, nl), Node((total - sl) / (rows - nl), rows - nl)
    return True


def _grown(blocks: DataFrame, roots: list[Node], depth: int, how: Codes) -> Node:
    """The next tree, level by level."""
    root, active = None, [0]
    for _ in range(depth):
        n, s, squares = _sums(blocks, roots, root, active, how)
        if root is None:
            root = Node(float(s[0, 0].sum() / n[0, 0].sum()), int(n[0, 0].sum()))
        leaves, fresh = _leaves(root), set()
        for i, leaf in enumerate(leaves[a] for a in active):
            if _split(leaf, n[i], s[i], float(squares[i]), how.cuts):
                fresh |= {id(leaf.left), id(leaf.right)}
        if not fresh:
            break
        active = [i for i, leaf in enumerate(_leaves(root)) if id(leaf) in fresh]
    return root


def fit(sup: SeriesRows, cols: list[str], trees: int, depth: int, seed: int, suffix: str) -> Trees:
    """Boosted trees that learn from every row with a label.

    Cut points come from all rows, or from about ``FIT_ROWS`` of them where there are more, picked by a
    hash of series and period, so they do not depend on how rows are laid out; all rows are learned from.
    """
    if depth < 1 or trees < 1:
        raise ValueError("trees and depth must be at least 1")
    plain, cols = sup.plain(), list(cols)
    salt = np.uint64(seed * 0xD1342543DE82EF95 % 2**64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, n = len(plain.periods), 0
        for batch in batches:
            known = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.bool_).reshape(batch.num_rows, length)
            n += int(known[:, plain.first + plain.h : plain.end + plain.h].sum())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows = sup.series.select("_known").mapInArrow(count, "n bigint").agg(F.sum("n")).first()[0]
    if not rows:
        raise ValueError("no row has a label")
    bar = np.uint64(2**64 - 1 if rows <= FIT_ROWS else int(FIT_ROWS / rows * 2**64))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lacks, picked = np.zeros(len(cols), bool), [np.zeros((len(cols), 0))]
        for batch in batches:
            for x, _, lot in plain.matrices(batch, cols):
                lacks |= np.isnan(x).any(axis=1)
                picked.append(x[:, (lot ^ salt) <= bar])
        sample = np.hstack(picked).T.tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([lacks.tobytes()], pa.binary()), pa.array([sample], pa.binary())], ["lacks", "sample"])

    # a record per task; the sample has about FIT_ROWS rows in all
    seen = sup.series.select("_id", "_y", "_known").mapInArrow(look, "lacks binary, sample binary").collect()
    flags = np.flatnonzero(np.any([np.frombuffer(r.lacks, np.bool_) for r in seen], axis=0)).tolist()
    sample = np.frombuffer(b"".join(bytes(r.sample) for r in seen), np.float64).reshape(-1, len(cols)).T
    most = min(BINS, rows) - 1
    how = Codes.of([cut_points(v, most) for v in _filled(sample, flags)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, _ in plain.matrices(batch, cols):
                if len(y):
                    packed = [how.pack(_filled(x, flags)).tobytes(), y.astype(np.float64).tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in packed], ["codes", "label"])

    blocks = durable(sup.series.select("_id", "_y", "_known").mapInArrow(pack, "codes binary, label binary"))
    roots: list[Node] = []
    for _ in range(trees):
        roots.append(_grown(blocks, roots, depth, how))
    return Trees(cols, [cols[i] for i in flags], roots, suffix)
