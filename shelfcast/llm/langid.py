"""Language identification with interpolated Kneser-Ney models of characters.

Each language has a model of sequences of letters (lower case; whatever lies between letters is one
space). Probabilities and interpolation weights are kept in arrays sorted by a 64-bit hash of the
sequence. The language with the lowest cross-entropy per character is chosen; documents that are half
as unlike that language as texts of its nearest neighbour, or have twice the usual cross-entropy, are
rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import map_texts, table

ORDER = 4
#: Bytes of text per language that the models are fitted on, at the most on average: a sample by hash of the id.
SAMPLE_BYTES = 8_000_000
SPACE = 32
#: Share that the uniform distribution under the shortest sequences gives to one character.
UNIFORM = 1e-5
PIECE = 1 << 19


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Lower-case code point per code point, or a space for all that is no letter."""
    out = np.full(0x110000, SPACE, "uint32")
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


def symbols(text: str) -> Iterator[np.ndarray]:
    """A text as symbols, in pieces; each piece begins with the ORDER - 1 symbols before it."""
    before = np.full(ORDER - 1, SPACE, "uint32")
    for at in range(0, len(text), PIECE):
        s = letters()[np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), "uint32")]
        gap = s == SPACE
        keep = ~gap
        keep[1:] |= ~gap[:-1]
        keep[0] |= before[-1] != SPACE
        s = np.concatenate([before, s[keep]])
        if len(s) > ORDER - 1:
            yield s
            before = s[1 - ORDER :]


def hashed(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hash of sequences given symbol by symbol; sequences of other lengths have other hashes."""
    h = np.full(len(columns[0]) if columns else 1, 0x9E3779B97F4A7C15, "uint64")
    for c in columns:
        h = (h ^ c.astype("uint64")) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


def windows(s: np.ndarray) -> list[np.ndarray]:
    """The ORDER symbols that end at each position behind the context, one array per place."""
    n = len(s) - ORDER + 1
    return [s[i : i + n] for i in range(ORDER)]


def distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(a position of each distinct sequence, number of the distinct sequence at each position)."""
    seen = pa.array(hashed(columns)).dictionary_encode()
    index = seen.indices.to_numpy()
    first = np.empty(len(seen.dictionary), "int64")
    first[index[::-1]] = np.arange(len(index) - 1, -1, -1)
    return first, index


def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, otherwise: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), otherwise)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[i] == wanted, values[i], otherwise)


class KneserNey:
    """One language. ``grams`` has a row of ORDER symbols per distinct sequence, ``counts`` how often it occurs."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.levels = []
        for k in range(ORDER, 0, -1):
            if k < ORDER:  # shorter sequences count the distinct symbols that precede them
                first, index = distinct(list(grams.T[1:]))
                grams, counts = grams[first][:, 1:], np.bincount(index)
            columns = list(grams.T)
            n1, n2 = (counts == 1).sum(), (counts == 2).sum()
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            context, of = np.unique(hashed(columns[:-1]) if k > 1 else np.zeros(len(grams), "uint64"), return_inverse=True)
            total = np.bincount(of, counts)
            kinds = np.bincount(of)
            keys = hashed(columns)
            order = np.argsort(keys)
            probability = np.maximum(counts - discount, 0) / total[of]
            self.levels.append((keys[order], probability[order], context, discount * kinds / total))

    def log2(self, columns: list[np.ndarray]) -> np.ndarray:
        """log2 of the probability of the last symbol given those before it."""
        p = np.full(len(columns[0]), UNIFORM)
        for k, (keys, probability, context, weight) in zip(range(1, ORDER + 1), reversed(self.levels)):
            of = hashed(columns[ORDER - k : -1]) if k > 1 else np.zeros(len(p), "uint64")
            p = look_up(keys, probability, hashed(columns[ORDER - k :]), 0.0) + look_up(context, weight, of, 1.0) * p
        return np.log2(p)


def entropies(models: list[KneserNey], texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bits per character for each text and model, characters per text). 0 characters: no letter."""
    bits, n = np.zeros((len(texts), len(models))), np.zeros(len(texts), "int64")
    held, size = [], 0

    def flush() -> None:
        columns = [np.concatenate(c) for c in zip(*(windows(s) for _, s in held))]
        first, index = distinct(columns)
        kinds = [c[first] for c in columns]
        starts = np.cumsum([0, *(len(s) - ORDER + 1 for _, s in held[:-1])])
        docs = np.array([d for d, _ in held])
        for m, model in enumerate(models):
            np.add.at(bits[:, m], docs, np.add.reduceat(-model.log2(kinds)[index], starts))
        np.add.at(n, docs, np.diff([*starts, len(index)]))

    for d, text in enumerate(texts):
        for s in symbols(text) if text else ():
            held.append((d, s))
            size += len(s)
            if size >= PIECE * 2:
                flush()
                held, size = [], 0
    if held:
        flush()
    return bits / np.maximum(n, 1)[:, None], n


class Identifier:
    """Models of all languages, the sharpness of scores and the limits of rejection."""

    def __init__(self, languages: list[str], models: list[KneserNey]):
        self.languages, self.models = languages, models
        self.usual, self.limit, self.sharp = np.zeros(len(models)), np.full(len(models), np.inf), 1.0

    def logits(self, bits: np.ndarray, n: np.ndarray) -> np.ndarray:
        # neighbouring characters are not independent: evidence grows with the root of their number
        return -bits * np.sqrt(n)[:, None]

    def excess(self, bits: np.ndarray, n: np.ndarray, best: np.ndarray) -> np.ndarray:
        """How far a text's cross-entropy is above the usual one; that of short texts varies more."""
        return (bits[np.arange(len(n)), best] - self.usual[best]) * np.sqrt(np.minimum(n, 200) / 200)

    def calibrate(self, texts: list[str], labels: list[str], share: float = 0.5) -> None:
        """Fit sharpness and limits to labelled texts that the models have not seen.

        A text of another language has an excess of its own under each model. The limit of a language is
        ``share`` of the median excess of the language that comes nearest to it, and no more than its
        own usual cross-entropy. Medians do not move with junk that carries a label.
        """
        bits, n = entropies(self.models, texts)
        some = n > 0
        bits, n = bits[some], n[some]
        truth = np.array([self.languages.index(x) for x in labels], "int64")[some]
        if not len(n):
            return
        def loss(sharp: float) -> float:
            z = self.logits(bits, n) * sharp
            z -= z.max(axis=1, keepdims=True)
            return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(n)), truth]))

        self.sharp = min((2.0**e for e in range(-4, 6)), key=loss)
        for k in range(len(self.models)):
            own = truth == k
            if own.any():
                self.usual[k] = np.median(bits[own, k])
        for k in range(len(self.models)):
            far = self.excess(bits, n, np.full(len(n), k))
            others = [np.median(far[truth == j]) for j in range(len(self.models)) if j != k and (truth == j).any()]
            self.limit[k] = max(min([share * x for x in others] + [self.usual[k]]), 0.1)

    def predict(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        """lang_pred, score and rejected for each text."""
        names = np.array([*self.languages, "und"], dtype=object)
        if not self.models or not texts:
            n = len(texts)
            return {"lang_pred": np.full(n, "und", dtype=object), "score": np.zeros(n), "rejected": np.ones(n, bool)}
        bits, n = entropies(self.models, texts)
        z = self.logits(bits, n) * self.sharp
        best = z.argmax(axis=1)
        z -= z.max(axis=1, keepdims=True)
        score = 1 / np.exp(z).sum(axis=1)
        none = n == 0
        rejected = none | (self.excess(bits, n, best) > self.limit[best])
        return {"lang_pred": names[np.where(none, len(names) - 1, best)], "score": np.where(none, 0.0, score), "rejected": rejected}


def fold(doc_id: str, folds: int = 5) -> Column:
    """crc32 of the id as text, mod ``folds``. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_bytes: int = SAMPLE_BYTES) -> Identifier:
    """Learn from rows with text and lang outside fold 0; fold 1 calibrates, the others give the counts.

    Each language is sampled by a hash of the id so that its texts have ``sample_bytes`` on average;
    counting is done by Spark, and the counts of a sample are what reaches the driver.
    """
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"),
        fold(f"`{doc_id}`").alias("fold"),
    ).where("fold <> 0 AND text IS NOT NULL AND lang IS NOT NULL")
    held = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes")).collect()
    share = {r["lang"]: min(1.0, sample_bytes / max(1, r["bytes"])) for r in held}
    if not share:
        return Identifier([], [])
    # 20 bits of the hash against each language's share
    limit = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(round(v * 2**20)))])
    sample = rows.where(F.shiftrightunsigned(F.xxhash64("id", F.lit(7)), 44) < limit[F.col("lang")])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, part in batch.groupby("lang"):
                pieces = [windows(s) for t in part["text"] for s in symbols(t)]
                if pieces:
                    columns = [np.concatenate(c) for c in zip(*pieces)]
                    first, index = distinct(columns)
                    yield pd.DataFrame({"lang": name, **{c: x[first].astype("int32") for c, x in zip(places, columns)}, "n": np.bincount(index)})

    places = [f"c{i}" for i in range(ORDER)]
    schema = "lang string, " + ", ".join(f"{c} int" for c in places) + ", n long"
    counted = sample.where("fold <> 1").select("lang", "text").mapInPandas(count, schema).groupBy("lang", *places).agg(F.sum("n").alias("n")).toArrow()
    frame = counted.to_pandas().sort_values(["lang", *places])
    models = {name: KneserNey(part[places].to_numpy("uint32"), part["n"].to_numpy("int64")) for name, part in frame.groupby("lang", sort=True)}
    out = Identifier(list(models), list(models.values()))
    # a quarter of the sample reaches the driver as text
    shown = sample.where("fold = 1").where(F.col("lang").isin(*out.languages)).select("text", "lang").toArrow().to_pandas()
    out.calibrate(list(shown["text"]), list(shown["lang"]))
    return out


def identify(docs: DataFrame, model: Identifier, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns with lang_pred, score and rejected; whole texts, read where they lie.

    A text that is null or has no letter is ``und`` with score 0, and rejected.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was fitted on
    return map_texts(docs, keep, text, "lang_pred string, score double, rejected boolean", lambda texts: shared.value.predict(texts))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "text")
    return identify(rows, fit(docs), ["doc_id", "held_out"])
