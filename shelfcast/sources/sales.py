"""Load transaction tables into the canonical sales frame: keys…, ds, qty, optional price and promo."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

CANONICAL = {"ds": "date", "qty": "double", "price": "double", "promo": "double"}
REJECT = "_reject"


def _canonical(df: DataFrame, colmap: dict[str, str]) -> DataFrame:
    return df.select(*[
        (F.col(src).cast(CANONICAL[name]) if name in CANONICAL else F.col(src)).alias(name)
        for name, src in colmap.items()
    ])


def as_schema(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def read_sales(
    spark: SparkSession, path: str, colmap: dict[str, str], schema: T.StructType | str, fmt: str = "parquet"
) -> DataFrame:
    """Read with a declared schema, rename by ``colmap`` (canonical name → source column) and cast.

    A declared column that a Parquet file lacks would silently read as null, so the file's own
    column names (footer only) are compared first.
    """
    schema = as_schema(schema)
    undeclared = set(colmap.values()) - set(schema.names)
    if undeclared:
        raise ValueError(f"columns not in the declared schema: {sorted(undeclared)}")
    if fmt in ("parquet", "orc"):
        present = set(spark.read.format(fmt).load(path).columns)
        missing = set(colmap.values()) - present
        if missing:
            raise ValueError(f"columns not in {path}: {sorted(missing)}")
    return _canonical(spark.read.schema(schema).format(fmt).load(path), colmap)


def read_sales_csv(
    spark: SparkSession, path: str, schema: T.StructType | str, colmap: dict[str, str], header: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(sales, rejects) from CSV; a line that does not parse goes to rejects as its raw text.

    With a header its names decide which column is which; a column of ``colmap`` that it lacks is an
    error. All files of ``path`` must have the same header. One record per line, so that large files
    stay splittable. Lines are parsed as an expression rather than by the CSV source, which does not
    allow a query on the rejected text alone.
    """
    schema = as_schema(schema)
    undeclared = set(colmap.values()) - set(schema.names)
    if undeclared:
        raise ValueError(f"columns not in the declared schema: {sorted(undeclared)}")
    lines = spark.read.text(path)
    columns = schema.names
    if header:
        # the CSV source reads the names from the first line of the first file
        columns = [c.strip().removeprefix("\ufeff") for c in spark.read.option("header", True).csv(path).columns]
        missing = set(colmap.values()) - set(columns)
        if missing and columns:
            raise ValueError(f"columns not in the header of {path}: {sorted(missing)}")
        # a header line parses to the names, however it is quoted
        spaced = ", ".join(f"c{i} string" for i in range(len(columns))) or "c0 string"
        first = F.from_csv("value", spaced, {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
        plain = F.regexp_replace(F.concat_ws(",", *[first[f"c{i}"] for i in range(len(columns))]), "\ufeff", "")
        named = F.col("value").contains(columns[0]) if columns else F.lit(False)  # parsed only where it can be one
        lines = lines.where(~(named & (plain == ",".join(columns))))
    kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
    parsed_as = ", ".join([*(f"`{c}` {kinds.get(c, 'string')}" for c in columns), f"{REJECT} string"])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECT}
    parsed = lines.where(F.trim("value") != "").select(F.from_csv("value", parsed_as, options).alias("r"))
    rows = parsed.select("r.*")
    good = _canonical(rows.where(F.col(REJECT).isNull()), colmap)
    return good, rows.where(F.col(REJECT).isNotNull()).select(F.col(REJECT).alias("line"))
