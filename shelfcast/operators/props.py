"""Columns from semi-structured text, without a schema that is known ahead.

The text is parsed to variants once, an aggregate over all rows tells the schema that holds them, and
its scalar paths become typed columns. Rows that hold no object are flagged and kept, with nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, NullType, StructType, VariantType

MOST_PATHS = 1000


def parsed(df: DataFrame, col: str, out: str = "_v") -> DataFrame:
    """Add the variant of a text column, null where it is no object."""
    v = F.try_parse_json(F.col(col))
    return df.withColumn(out, F.when(F.schema_of_variant(v).startswith("OBJECT<"), v))


def found_schema(df: DataFrame, col: str = "_v") -> DataType:
    """The type that holds all variants of a column: one row reaches the driver."""
    from pyspark.sql.types import _parse_datatype_string

    told = df.agg(F.schema_of_variant_agg(col)).first()[0] or "VOID"
    return _parse_datatype_string(told.replace("OBJECT<", "STRUCT<"))


def scalar_paths(schema: DataType, before: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], str]]:
    """(names on the way, type) of all scalars in nested objects. Lists, and values of several kinds, are kept as text."""
    if isinstance(schema, StructType):
        return [p for f in schema for p in scalar_paths(f.dataType, (*before, f.name))]
    if not before or isinstance(schema, NullType):
        return []
    return [(before, "string" if isinstance(schema, (ArrayType, VariantType)) else schema.simpleString())]


def columns_of(df: DataFrame, col: str, most: int = MOST_PATHS) -> DataFrame:
    """``df`` with ``<col>_malformed`` and a column per scalar path, named ``<col>_`` and the names on the way with _ between.

    A value that does not fit its column's type is null. More than ``most`` paths are an error: such
    data is a map, not a record. Columns whose names would repeat get a number behind them.
    """
    rows = parsed(df, col)
    paths = scalar_paths(found_schema(rows))
    if len(paths) > most:
        raise ValueError(f"{col}: more than {most} paths")
    taken, cols = {c.lower() for c in df.columns} | {f"{col}_malformed".lower()}, []
    for names, kind in paths:
        name = wanted = "_".join((col, *names))
        number = 2
        while name.lower() in taken:
            name, number = f"{wanted}_{number}", number + 1
        taken.add(name.lower())
        path = "$" + "".join('["' + n.replace("\\", "\\\\").replace('"', '\\"') + '"]' for n in names)
        cols.append(F.try_variant_get("_v", path, kind).alias(name))
    bad = F.col(col).isNotNull() & F.col("_v").isNull()
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], bad.alias(f"{col}_malformed"), *cols)
