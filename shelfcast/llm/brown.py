"""Language-model scores from a Brown class bigram model.

The probability of a word is that of its class after the class of the word before, times that of the
word in its class. Words that are at least 2^-20 of all tokens get their classes by exchange: round
by round, part by part, each word moves to the class that raises the likelihood of the class bigrams
most. All other words, those that were never seen among them, share classes by their last two bytes;
their own counts still decide their probability in the class.

Counts of words and of symbol pairs are made by Spark over all training documents. There are at most
2^20 words that are 2^-20 of all tokens, whatever the corpus, so their classes and counts may go to
every task; the counts of all other words are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.runtime import durable, scratch_path
from .common import table

CLASSES = 64
ENDINGS = 31
#: Words that are one in so many tokens at least are moved between classes.
MOVED = 2**20
#: The counts of words that are one in so many tokens at least go to every task.
SHARE = 2**20
LEAST = 8
ADD = 0.1
#: Weight of the class's own probability in transitions, in tokens.
PRIOR = 50.0


def fold(doc_id: str, folds: int = 10) -> Column:
    """crc32 of the id as text, mod ``folds``. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def ending(word: bytes) -> int:
    return int.from_bytes(word[-2:], "big") % ENDINGS


@dataclass
class Model:
    index: dict[bytes, int]  # frequent words, most frequent first
    counts: np.ndarray  # of the frequent words
    symbol: np.ndarray  # of the frequent words: a number of its own, or that of its ending
    tokens: int
    kinds: int
    ends: int
    classes: np.ndarray  # class of each symbol: moved words, endings, end
    pairs: np.ndarray  # class bigrams
    kinds_by_ending: np.ndarray  # training words that share the class of an ending
    words: DataFrame = field(repr=False)  # word, ending, n of all training words

    @property
    def moved(self) -> int:
        return len(self.classes) - ENDINGS - 1

    def transitions(self) -> np.ndarray:
        """log10 of class given class before; a mixture with the share of the class keeps all above 0."""
        k = len(self.pairs)
        own = (self.pairs.sum(axis=0) + 1) / (self.pairs.sum() + k)
        return np.log10((self.pairs + PRIOR * own) / (self.pairs.sum(axis=1, keepdims=True) + PRIOR))

    def base(self, n: np.ndarray | float) -> np.ndarray:
        return np.log10((n + ADD) / (self.tokens + ADD * (self.kinds + 1)))

    def by_ending(self) -> np.ndarray:
        """Denominator of the probability of a word in the class of its ending, one unseen word included."""
        return self.pairs.sum(axis=0)[CLASSES : CLASSES + ENDINGS] + ADD * (self.kinds_by_ending + 1)

    def inside(self) -> np.ndarray:
        """log10 of each frequent word in its class."""
        own = self.symbol < self.moved
        share = np.empty(len(self.counts))
        share[own] = self.counts[own] / self.pairs.sum(axis=0)[self.classes[self.symbol[own]]]
        share[~own] = (self.counts[~own] + ADD) / self.by_ending()[self.symbol[~own] - self.moved]
        return np.log10(share)


#: Bytes of text that are cut into words at once.
STRETCH = 8_000_000
#: Neighbours that lie in one row of packed lists, unless one word has more.
ROW = 60_000


def _stretches(texts: pa.Array) -> Iterator[pa.Array]:
    """Texts, null ones empty, in stretches of about ``STRETCH`` bytes or one text."""
    texts = pc.fill_null(texts, "")
    size = np.cumsum(np.asarray(pc.binary_length(texts)), dtype="int64")
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(size, STRETCH + (size[start - 1] if start else 0), "right")))
        yield texts.slice(start, end - start)
        start = end


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(where the words of each text start and end, number of each word, distinct words); the words of ``words_of``."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, cuts = lists.flatten(), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()), dtype="int64")])
    full = np.asarray(pc.binary_length(flat)) > 0  # white space at either end leaves an empty word
    if not full.all():
        cuts = np.concatenate([[0], np.cumsum(full, dtype="int64")])[cuts]
        flat = flat.filter(pa.array(full))
    seen = flat.dictionary_encode()
    return cuts, seen.indices.to_numpy(), seen.dictionary


def endings(words: pa.Array) -> np.ndarray:
    """``ending`` of each word; none is empty."""
    ends = np.frombuffer(words.buffers()[1], "int32")[words.offset + 1 : words.offset + len(words) + 1] if len(words) else np.zeros(0, "int32")
    data = np.frombuffer(words.buffers()[2], "uint8") if len(words) else np.zeros(0, "uint8")
    before = np.where(np.asarray(pc.binary_length(words)) > 1, data[np.maximum(ends - 2, 0)], 0)
    return (before.astype("int64") * 256 + data[ends - 1]) % ENDINGS


def _numbers(words: pa.Array, among: pa.Array) -> np.ndarray:
    """Place of each word in ``among``, or -1."""
    return np.asarray(pc.fill_null(pc.index_in(words, value_set=among), -1)).astype("int64")


def _texts_as(index: dict[bytes, int]) -> pa.Array:
    return pa.array(list(index), pa.binary()).cast(pa.string())


def count_words(train: DataFrame) -> DataFrame:
    """(word, ending, n) over all texts, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []

        def rows() -> pa.RecordBatch:
            words, n = held.pop()
            return pa.RecordBatch.from_arrays([words, pa.array(endings(words), pa.int32()), pa.array(n, pa.int64())], ["word", "ending", "n"])

        def merged() -> tuple[pa.Array, np.ndarray]:
            seen = pa.concat_arrays([w for w, _ in held]).dictionary_encode()
            n = np.bincount(seen.indices.to_numpy(), np.concatenate([n for _, n in held]), len(seen.dictionary))
            return seen.dictionary, n.astype("int64")

        for batch in batches:
            for texts in _stretches(batch.column(0)):
                _, found, words = tokens_of(texts)
                held.append((words, np.bincount(found, minlength=len(words))))
                if sum(len(w) for w, _ in held) > 600_000:
                    held[:] = [merged()]
                    if len(held[0][0]) > 300_000:
                        yield rows()
        if held:
            held[:] = [merged()]
            yield rows()

    counted = train.select("text").mapInArrow(run, "word string, ending int, n long")
    return durable(counted.groupBy("word", "ending").agg(F.sum("n").alias("n")))


# ---- packed lists of neighbours ------------------------------------------------------------------

PACKED = "words binary, sizes binary, slots binary, n binary"


def _pack(word: np.ndarray, slot: np.ndarray, n: np.ndarray) -> list[bytes]:
    """A row of lists: the words, sorted, how many entries each has, the entries. Counts take the bytes that the largest needs."""
    words, sizes = _runs(word)
    width = next(w for w in ("u1", "u2", "u4", "i8") if n.max(initial=0) <= np.iinfo(w).max)
    return [words.astype("i4").tobytes(), sizes.astype("i4").tobytes(), slot.astype("i4").tobytes(), n.astype(width).tobytes()]


def _unpack(row: Iterator[pa.Scalar]) -> tuple[np.ndarray, ...]:
    """(words, sizes, slots, n) of a row."""
    words, sizes, slots, n = (x.as_buffer() for x in row)
    words, sizes, slots = (np.frombuffer(x, "i4") for x in (words, sizes, slots))
    return words, sizes, slots, np.frombuffer(n, {1: "u1", 2: "u2", 4: "u4", 8: "i8"}[n.size // max(1, len(slots))])


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, how often) of sorted values."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, "int64")
    return values[starts], np.diff(np.append(starts, len(values)))


def _added(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes, sorted, and the sum of n of each). Sorted runs are merged fast."""
    order = np.argsort(code, kind="stable")
    code = code[order]
    starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, "int64")
    return code[starts], np.add.reduceat(n[order], starts) if len(code) else n


def neighbours(train: DataFrame, words: pa.Array, symbol: np.ndarray, moved: int, tokens: int, parts: int) -> DataFrame:
    """Symbols beside each moved word over all texts, in packed lists by ``part`` (word modulo ``parts``), stored.

    An entry is (slot, n), slot being twice the symbol beside and 1 more where it stands before the
    word: at most two entries per symbol. Part -1 has the pairs that no move changes: those of a word
    with itself and those of two symbols that do not move.
    """
    size = moved + ENDINGS + 1
    files = max(8, min(1024, tokens // 500_000))
    # the most frequent words have the longest lists: deal words out one by one, and keep what goes together side by side
    buckets = 4 * files
    home = np.argsort(np.argsort(np.arange(size) % buckets, kind="stable"))
    shared = train.sparkSession.sparkContext.broadcast((words, symbol, home))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, symbol, home = shared.value
        symbol_at = np.argsort(home)

        def rows(held: list[np.ndarray]) -> pa.RecordBatch:
            code = np.concatenate(held)
            held.clear()
            code.sort()
            code, n = _runs(code)
            word, slot = symbol_at[code // (2 * size)], code % (2 * size)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(word % buckets)) + 1, [len(word)]])
            out = [[int(word[a] % buckets), *_pack(word[a:b], slot[a:b], n[a:b])] for a, b in zip(cuts, cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int32(), *[pa.binary()] * 4])], ["bucket", "words", "sizes", "slots", "n"])

        held, found = [], 0
        for batch in batches:
            for texts in _stretches(batch.column(0)):
                cuts, ids, distinct = tokens_of(texts)
                at = _numbers(distinct, words)
                of = np.where(at >= 0, symbol[at] if len(symbol) else 0, moved + endings(distinct))
                # an end before the first text and after each
                s = np.insert(of[ids] if len(ids) else ids.astype("int64"), cuts, size - 1)
                a, b = s[:-1], s[1:]
                own = (a < moved) | (b >= moved)
                other = (b < moved) & (a != b)
                held += [home[a[own]] * (2 * size) + 2 * b[own], home[b[other]] * (2 * size) + 2 * a[other] + 1]
                found += len(a)
                if found > 2_000_000:
                    yield rows(held)
                    found = 0
        if found:
            yield rows(held)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, found, limit = [], [], 0, 2_000_000
        for batch in batches:
            for row in zip(*batch.columns[1:]):
                words, sizes, slots, n = _unpack(row)
                codes.append(np.repeat(words.astype("int64"), sizes) * (2 * size) + slots)
                counts.append(n.astype("int64"))
                found += len(n)
                if found > limit:
                    code, n = _added(np.concatenate(codes), np.concatenate(counts))
                    codes, counts, found, limit = [code], [n], len(code), max(limit, 2 * len(code))
        if not found:
            return
        code, n = _added(np.concatenate(codes), np.concatenate(counts))
        word, slot = code // (2 * size), code % (2 * size)
        part = np.where((word >= moved) | (slot == 2 * word), -1, word % parts)
        for p in range(-1, parts):
            at = np.flatnonzero(part == p)
            w, s, m = word[at], slot[at], n[at]
            starts = np.cumsum(np.concatenate([[0], _runs(w)[1]]))  # where each word starts
            cuts = starts[np.unique(np.append(np.searchsorted(starts, np.arange(0, len(w), ROW)), len(starts) - 1))]
            for a, b in zip(cuts, cuts[1:]):
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (p, *_pack(w[a:b], s[a:b], m[a:b]))], ["part", "words", "sizes", "slots", "n"])

    dealt = train.select("text").mapInArrow(count, f"bucket int, {PACKED}").repartition(files, "bucket")
    made = dealt.mapInArrow(join, f"part long, {PACKED}")
    path = scratch_path(train.sparkSession, "neighbours")
    made.write.partitionBy("part").parquet(path)  # a pass over one part reads its files only
    return train.sparkSession.read.schema(made.schema).parquet(path)


def _contexts(row: tuple[np.ndarray, ...], classes: np.ndarray, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(how often each class follows each word, how often it precedes it); words before it that ``skip`` marks do not count."""
    words, sizes, slots, n = row
    symbol, side = slots >> 1, slots & 1
    cell = (np.repeat(np.arange(len(words)), sizes) * 2 + side) * k + classes[symbol]
    if skip is not None:
        n = np.where((side == 1) & skip[symbol], 0, n)
    counts = np.bincount(cell, n, len(words) * 2 * k).reshape(len(words), 2, k)
    return counts[:, 0], counts[:, 1]


def _some(row: tuple[np.ndarray, ...], keep: np.ndarray) -> tuple[np.ndarray, ...]:
    """The words that ``keep`` marks, with their lists."""
    words, sizes, slots, n = row
    mine = keep[words]
    every = np.repeat(mine, sizes)
    return words[mine], sizes[mine], slots[every], n[every]


def class_pairs(around: DataFrame, classes: np.ndarray, changed: np.ndarray, k: int, before: np.ndarray | None = None) -> np.ndarray:
    """Class bigrams of all pairs with a ``changed`` word (less those under the classes ``before``). Pairs of a word with itself are left out."""
    shared = around.sparkSession.sparkContext.broadcast((classes, changed, before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, (now, changed, before) = np.zeros((k, k)), shared.value
        for batch in batches:
            for row in zip(*batch.columns):
                row = _some(_unpack(row), changed)
                for cls, sign in ((now, 1), (before, -1)):
                    if cls is not None and len(row[0]):
                        # pairs of two changed words count where the first one stands
                        right, left = _contexts(row, cls, k, changed)
                        np.add.at(total, cls[row[0]], sign * right)
                        np.add.at(total.T, cls[row[0]], sign * left)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total.ravel()[some].astype("int64"))], ["cell", "n"])

    got = around.select("words", "sizes", "slots", "n").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((k, k), "int64")
    out.ravel()[got["cell"].to_numpy()] += got["n"].to_numpy()
    return out


def unmoved_pairs(around: DataFrame, moved: int) -> tuple[np.ndarray, np.ndarray]:
    """(class bigrams of endings and end, pairs of each moved word with itself): at most (ENDINGS + 1)² and ``moved`` pairs."""
    k = CLASSES + ENDINGS + 1
    fixed, own = np.zeros((k, k), "int64"), np.zeros(moved, "int64")
    for batch in around.where("part = -1").select("words", "sizes", "slots", "n").toArrow().to_batches():
        for row in zip(*batch.columns):
            words, sizes, slots, n = _unpack(row)
            a, b = np.repeat(words, sizes), slots >> 1
            same = a < moved
            own[a[same]] = n[same]
            fixed[a[~same] - moved + CLASSES, b[~same] - moved + CLASSES] = n[~same]
    return fixed, own


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


class Bigrams:
    """Class bigrams made ready for judging words: per neighbour class a row over the classes that a word may take."""

    def __init__(self, pairs: np.ndarray):
        pairs = pairs.astype(float)
        self.rows, self.columns = pairs.sum(axis=1)[:CLASSES], pairs.sum(axis=0)[:CLASSES]
        self.corner = pairs.diagonal()[:CLASSES].copy()
        # behind and before a word: counts and their x·log x
        self.sides = [(t, _xlogx(t)) for t in (np.ascontiguousarray(pairs[:CLASSES].T), np.ascontiguousarray(pairs[:, :CLASSES]))]


def best_classes(own: np.ndarray, right: np.ndarray, left: np.ndarray, pairs: np.ndarray | Bigrams) -> np.ndarray:
    """Class for each word that makes the class bigrams most likely.

    ``own``: present classes; ``right`` and ``left``: how often each class follows and precedes the
    word, pairs of the word with itself left out. The likelihood is the sum of x·log x of the pairs
    less that of their row and column sums.
    """
    ready = pairs if isinstance(pairs, Bigrams) else Bigrams(pairs)
    at = np.arange(len(own))

    def joined(around: np.ndarray, across: np.ndarray, counts: np.ndarray, every: np.ndarray) -> np.ndarray:
        """What the pairs of each class with the neighbours on one side gain; only classes that occur there count."""
        out = np.zeros((len(own), CLASSES))
        word, beside = np.nonzero(around)
        if not len(word):
            return out
        n, mine = around[word, beside], own[word]
        to, was = counts[beside], every[beside]
        # without the word itself: in the row of its class, and in the column of its class
        each, same = np.arange(len(word)), np.flatnonzero(beside == mine)
        to[each, mine] -= n
        to[same] -= across[word[same], :CLASSES]
        np.maximum(to, 0, out=to)
        was[each, mine], was[same] = _xlogx(to[each, mine]), _xlogx(to[same])
        to += n[:, None]  # above 0 from here
        gain = np.log(to)
        gain *= to
        gain -= was
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[starts]] = np.add.reduceat(gain, starts)
        return out

    gain = joined(right, left, *ready.sides[0]) + joined(left, right, *ready.sides[1])
    r, l = right.sum(axis=1, keepdims=True), left.sum(axis=1, keepdims=True)
    a, b = right[:, :CLASSES], left[:, :CLASSES]
    rows, columns = ready.rows - b, ready.columns - a
    rows[at, own] -= r[:, 0]
    columns[at, own] -= l[:, 0]
    corner = np.repeat(ready.corner[None], len(own), axis=0)
    corner[at, own] -= a[at, own] + b[at, own]
    rows, columns, corner = np.maximum(rows, 0), np.maximum(columns, 0), np.maximum(corner, 0)
    gain += _xlogx(corner + a + b) - _xlogx(corner + a) - _xlogx(corner + b) + _xlogx(corner)
    gain -= _xlogx(rows + r) - _xlogx(rows) + _xlogx(columns + l) - _xlogx(columns)
    gain[at, own] += 1e-6  # stay on a tie
    return gain.argmax(axis=1)


def _slices(right: np.ndarray, left: np.ndarray, cells: int = 4000, words: int = 64) -> list[slice]:
    """Words in stretches that have about so many neighbour classes together: what is worked out at once stays in the cache."""
    n = len(right)
    size = np.cumsum(np.count_nonzero(right, axis=1) + np.count_nonzero(left, axis=1))
    cuts = np.unique([0, *np.searchsorted(size, np.arange(cells, size[-1], cells)), *range(words, n, words), n]) if n else [0]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:])]


def exchange(around: DataFrame, counts: np.ndarray, classes: np.ndarray, part: int) -> np.ndarray:
    """One step: the words of a part move, all judged by the same class bigrams. No shuffle."""
    k = len(counts)
    shared = around.sparkSession.sparkContext.broadcast((classes, counts))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, counts = shared.value
        ready = Bigrams(counts)
        for batch in batches:
            for row in zip(*batch.columns):
                row = _unpack(row)
                (words, *_), (right, left) = row, _contexts(row, cls, k)
                best = np.concatenate([best_classes(cls[words[x]], right[x], left[x], ready) for x in _slices(right, left)])
                yield pa.RecordBatch.from_arrays([pa.array(words.astype("int64")), pa.array(best)], ["word", "class"])

    mine = around.where(F.col("part") == part).select("words", "sizes", "slots", "n")
    moved = mine.mapInArrow(judge, "word long, class long").toArrow()
    out = classes.copy()
    out[moved["word"].to_numpy()] = moved["class"].to_numpy()
    return out


def fit(train: DataFrame, rounds: int = 3, parts: int = 3) -> Model:
    """Learn from the ``text`` column of all rows. A null text is empty."""
    words = count_words(train)
    total = words.agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).first()
    texts = train.count()
    tokens, kinds = (total["n"] or 0) + texts, total["kinds"] + (texts > 0)
    # at most SHARE words have a share of 1 / SHARE
    rows = words.where((F.col("n") >= LEAST) & (F.col("n") * SHARE >= tokens)).select("word", "n").toArrow()
    order = sorted(zip(rows["n"].to_pylist(), rows["word"].to_pylist()), key=lambda x: (-x[0], x[1]))
    index = {w.encode(): i for i, (_, w) in enumerate(order)}
    counts = np.array([n for n, _ in order], "int64")
    moved = int((counts * MOVED >= tokens).sum())
    symbol = np.array([i if i < moved else moved + ending(w) for w, i in index.items()], "int64")
    few = (F.col("n") < LEAST) | (F.col("n") * MOVED < tokens)
    by_ending = {r["ending"]: r["n"] for r in words.where(few).groupBy("ending").agg(F.count("*").alias("n")).collect()}

    around = neighbours(train, _texts_as(index), symbol, moved, tokens, parts)
    fixed, own = unmoved_pairs(around, moved)
    classes = np.concatenate([np.arange(moved) % CLASSES, np.arange(CLASSES, CLASSES + ENDINGS + 1)])
    k, to_move = CLASSES + ENDINGS + 1, np.arange(len(classes)) < moved
    bigrams = fixed + class_pairs(around.where("part >= 0"), classes, to_move, k)
    np.add.at(bigrams, (classes[:moved], classes[:moved]), own)

    for _ in range(rounds if moved else 0):
        start = classes
        for part in range(parts):
            before, classes = classes, exchange(around, bigrams, classes, part)
            changed = classes != before
            if changed.any():  # only pairs of words that moved are counted anew
                bigrams = bigrams + class_pairs(around.where(F.col("part") == part), classes, changed, k, before)
                np.add.at(bigrams, (classes[:moved], classes[:moved]), own)
                np.add.at(bigrams, (before[:moved], before[:moved]), -own)
        if (classes == start).all():
            break
    return Model(
        index, counts, symbol, tokens, kinds, texts, classes, bigrams, np.array([by_ending.get(k, 0) for k in range(ENDINGS)]), words,
    )


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns, n_tokens, n_known, train_tokens, base_score and score of whole texts.

    Frequent words are scored where the text lies. Each other word of a text is joined to its count;
    texts that are equal share these sums. Scores are rounded to 7 places, since doubles are added in
    any order.
    """
    spark = docs.sparkSession
    end_base = float(model.base(model.ends))
    shared = spark.sparkContext.broadcast((_texts_as(model.index), model.symbol, model.classes, model.transitions(), model.inside(), model.base(model.counts)))
    moved = model.moved

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in _stretches(batch.column(len(kept))):
                rows = [c.slice(at, len(texts)) for c in batch.columns[: len(kept)]]
                at += len(texts)
                yield pa.RecordBatch.from_arrays([*rows, *compute(texts)], [*kept, *added.names])

    def compute(texts: pa.Array) -> list[pa.Array]:
        among, symbol, classes, step, inside, base = shared.value
        cuts, ids, distinct = tokens_of(texts)
        n, length = len(texts), np.diff(cuts)
        text = np.repeat(np.arange(n), length)
        number = _numbers(distinct, among)
        end = moved + ENDINGS
        of = np.where(number >= 0, symbol[number] if len(symbol) else 0, moved + endings(distinct))
        known = number[ids] >= 0 if len(ids) else np.zeros(0, bool)
        seen, where = number[ids[known]], text[known]
        # a class before and after each word of a text, the end at both sides
        c = classes[np.insert(of[ids] if len(ids) else ids.astype("int64"), np.repeat(cuts, 2)[1:-1], end)]
        moves = np.repeat(np.arange(n), length + 1)
        first = cuts[:-1] + 2 * np.arange(n)
        steps = np.ones(len(c), bool)
        steps[first + length + 1] = False
        before = np.flatnonzero(steps)
        score = np.bincount(moves, step[c[before], c[before + 1]], n) + np.bincount(where, inside[seen], n)
        # rare words of each text, with their counts
        rare, times = _runs(np.sort(text[~known] * len(distinct) + ids[~known]))
        offsets = np.searchsorted(rare, np.arange(n + 1) * len(distinct)) if len(distinct) else np.zeros(n + 1, "int64")
        offsets = pa.array(offsets, pa.int32())
        return [
            pa.array(length + 1, pa.int64()),
            pa.array(np.bincount(where, minlength=n), pa.int64()),
            pa.array(np.bincount(where, base[seen], n) + end_base, pa.float64()),
            pa.array(score, pa.float64()),
            pa.ListArray.from_arrays(offsets, distinct.take(pa.array(rare % max(1, len(distinct))))),
            pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
        ]

    schema = "n_tokens long, frequent long, part_base double, part_score double, rare array<string>, times array<long>"
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    named = docs.select(*[F.col(f"`{c}`") for c in keep], F.xxhash64(body).alias("_hash"), F.crc32(body.cast("binary")).alias("_crc"), body.alias("_body"))
    kept, added = [*keep, "_hash", "_crc"], StructType.fromDDL(schema)
    parts = durable(named.mapInArrow(run, StructType([*(named.schema[c] for c in kept), *added])))

    again = parts.select("_hash", "_crc", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("_hash", "_crc", F.col("r.rare").alias("word"), F.col("r.times").alias("m"))
    # a word is one row of the counts, so a hash table of a partition of them has no long chain
    counted = again.join(model.words.select("word", "n").hint("shuffle_hash"), "word", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    number = F.conv(F.hex(F.substring(F.encode("word", "utf-8"), -2, 2)), 16, 10).cast("long") % ENDINGS
    totals = F.lit([float(x) for x in model.by_ending()])
    under = F.lit(float(model.tokens + ADD * (model.kinds + 1)))
    log = lambda below: F.sum(F.log10((F.col("c") + ADD) / below) * F.col("m"))
    sums = counted.groupBy("_hash", "_crc").agg(
        F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("known"),
        log(under).alias("rare_base"),
        log(F.element_at(totals, (number + 1).cast("int"))).alias("rare_score"),
    )
    # equal texts have added up the same sums as often as there are rows of them
    rows = parts.groupBy("_hash", "_crc").agg(F.count("*").alias("rows"))
    sums = sums.join(rows, ["_hash", "_crc"])
    part = lambda c: F.coalesce(F.col(c) / F.col("rows"), F.lit(0.0))
    return parts.join(sums, ["_hash", "_crc"], "left").select(
        *[F.col(f"`{c}`") for c in keep], "n_tokens", (F.col("frequent") + part("known").cast("long") + int(model.ends > 0)).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        F.round(F.col("part_base") + part("rare_base"), 7).alias("base_score"),
        F.round(F.col("part_score") + part("rare_score"), 7).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (fold("doc_id") == 0).alias("held_out"), "text")
    return score(docs, fit(docs.where("NOT held_out")), ["doc_id", "held_out"])
