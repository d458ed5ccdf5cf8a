"""Series as rows: one array per series, worked on a batch of series at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

#: Numbers that one call sees: a batch of long series is cut.
CELLS = 1 << 21


def series_rows(panel: DataFrame, keys: list[str], value: str = "qty") -> DataFrame:
    """keys…, _first (the first period), _y: the values of a dense panel in time order, one row per series."""
    ordered = F.sort_array(F.collect_list(F.struct("period", F.col(value).cast("double").alias("y"))))
    return panel.groupBy(*keys).agg(F.min("period").alias("_first"), F.transform(ordered, lambda p: p["y"]).alias("_y"))


def map_series(series: DataFrame, schema: str, compute: Callable[[np.ndarray], dict[str, list]], column: str = "_y") -> DataFrame:
    """The columns of ``series`` and what ``compute`` makes of a matrix of series of one length, a list per column of ``schema``.

    Series are told apart by length, so that numpy works on whole matrices. Nulls come as NaN.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    added = StructType.fromDDL(schema)
    types, whole, names = to_arrow_schema(added), StructType([*series.schema, *added]), series.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column(names.index(column))
            size = y.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(size)
            flat = y.flatten().to_numpy(zero_copy_only=False).astype("float64")
            out: dict[str, list] = {f.name: [None] * batch.num_rows for f in types}
            for n in np.unique(size):
                same = np.flatnonzero(size == n)
                step = max(1, CELLS // max(1, int(n)))
                for a in range(0, len(same), step):
                    some = same[a : a + step]
                    made = compute(flat[(ends[some] - n)[:, None] + np.arange(n)] if n else np.zeros((len(some), 0)))
                    for c, values in made.items():
                        for i, v in zip(some, values):
                            out[c][i] = v
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(out[f.name], f.type) for f in types)], whole.names)

    return series.mapInArrow(run, whole)


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, list[slice]]]:
    """Tables of rows sorted by the whole numbers ``by``, none of which parts a group, with the place of each group."""
    held: pa.Table | None = None

    def cuts(t: pa.Table) -> np.ndarray:
        return np.flatnonzero(np.any([np.diff(t[c].to_numpy()) != 0 for c in by], axis=0)) + 1

    def told(t: pa.Table) -> tuple[pa.Table, list[slice]]:
        ends = [0, *cuts(t).tolist(), t.num_rows]
        return t.combine_chunks(), [slice(a, b) for a, b in zip(ends, ends[1:])]

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        ends = cuts(held)
        if len(ends):  # the last group may go on in the next batch
            yield told(held.slice(0, int(ends[-1])))
            held = held.slice(int(ends[-1]))
    if held is not None:
        yield told(held)
