"""Array columns as vectors, and exact nearest neighbours by blocks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

QUERY_ROWS = 2048  # queries per block
BLOCK_ROWS = 20_000  # vectors per block
CHUNK = 2048  # vectors compared at once


def lit_json(value, ddl: str) -> Column:
    """A nested literal; one expression however many numbers it holds."""
    return F.from_json(F.lit(json.dumps(value)), ddl)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; a zero row stays zero, so it is similar to nothing."""
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _best(q: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int):
    """The k largest similarities of each query; equal ones by id."""
    order = np.lexsort((ids, -sims, q))
    q, ids, sims = q[order], ids[order], sims[order]
    first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    keep = np.arange(len(q)) - start < k
    return q[keep], ids[keep], sims[keep]


def _scan(queries: np.ndarray, query_ids: np.ndarray, batches: Iterator[tuple[np.ndarray, np.ndarray]], k: int):
    """Running top k of every query over batches of (ids, vectors)."""
    queries = _unit(queries)
    found = None
    for all_ids, vectors in batches:
        order = np.argsort(all_ids, kind="stable")
        all_ids, vectors = all_ids[order], _unit(vectors[order])
        for at in range(0, len(all_ids), CHUNK):
            ids = all_ids[at : at + CHUNK]
            sims = np.round(queries @ vectors[at : at + CHUNK].T, 9)
            sims[query_ids[:, None] == ids[None, :]] = -np.inf
            if len(ids) > k:
                kth = -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k]
                above, equal = sims > kth, sims == kth
                room = k - above.sum(axis=1, keepdims=True)
                # ids ascend along a row, so the first equal ones are the right ones
                pick = above | (equal & (np.cumsum(equal, axis=1) <= room))
            else:
                pick = np.ones_like(sims, bool)
            q, j = np.nonzero(pick & np.isfinite(sims))
            new = (q, ids[j], sims[q, j])
            found = new if found is None else tuple(np.concatenate(p) for p in zip(found, new))
            found = _best(*found, k)
    return found


def topk_cosine(vectors: DataFrame, queries: DataFrame, k: int, id: str, emb: str) -> DataFrame:
    """The k vectors most cosine-similar to each query, exactly, without the query itself.

    Columns: query_id, neighbour_id, similarity (9 places), rank; ties by id. Blocks of queries meet
    blocks of vectors in a join, so a task never holds more than one block of each side, and it keeps
    only k rows per query: no pair list is ever built. Both sides are frames of any size.
    """
    vectors, queries = vectors.select(id, emb), queries.select(id, emb)
    id_type = vectors.schema[id].dataType
    out = T.StructType([
        T.StructField("query_id", id_type), T.StructField("neighbour_id", id_type), T.StructField("similarity", T.DoubleType()),
    ])
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    slices = max(1, -(-vectors.count() // BLOCK_ROWS))
    part = lambda n: F.pmod(F.xxhash64(id), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(id, emb, part(blocks).alias("_block"), every(slices).alias("_slice"))
    right = vectors.select(id, emb, every(blocks).alias("_block"), part(slices).alias("_slice"))

    def scan(qs, vs):
        import pandas as pd

        if len(qs) == 0 or len(vs) == 0:
            return pd.DataFrame({n: [] for n in out.names})
        as_matrix = lambda s: np.stack(s.to_numpy()).astype(np.float64)
        query_ids = qs[id].to_numpy()
        ids = np.asarray(vs[id].tolist())
        q, j, sims = _scan(as_matrix(qs[emb]), np.asarray(query_ids.tolist()), iter([(ids, as_matrix(vs[emb]))]), k)
        return pd.DataFrame({"query_id": query_ids[q], "neighbour_id": j, "similarity": sims})

    by = ["_block", "_slice"]
    local = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(scan, out)
    # k rows per query and slice: small groups
    w = W.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbour_id")
    return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
