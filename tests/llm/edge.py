"""Documents that operators must not stumble over."""

from pyspark.sql import DataFrame, SparkSession, functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha Beta gamma\tdelta\n" * 40_000
PROSE = "The old house by the river was empty for years, and nobody in the village knew who owned it any more. "
ROWS = [
    (1, "one two three four five", "en", "a", 23),
    (2, "one two three four five", "en", "a", 23),
    (2, "one two three four five", "en", "a", 23),  # a repeated row
    (3, None, "en", "b", None),
    (4, "", None, None, 0),
    (5, " \n\t ", "de", "a", 4),
    (None, "a row without id", "de", None, 16),
    (None, "a row without id", "de", None, 16),
    (6, LONG, "fr", "b", len(LONG)),
    (7, "Ünïcödé ſtraße 中文 😀😀 İ", "de", "c", 24),
    (7, "the same id with another text", "en", "c", 29),
    (8, "12345 --- !!!", "en", "😀", 13),
    (9, PROSE * 3, "en", "", 309),
    (-4, PROSE * 3 + "End.", "en", "c", 313),
    (10, "x", "en", "c", 1),
    (11, "İ" * 50 + "\x00 nul \x0b vt", "fr", "a", 60),
]
#: Names that operators use inside, as columns of the caller.
CLASHING = "row fp hash h0 key node size pick copies rank _text _h _s copy label digest lines base n word a b".split()


def frame(spark: SparkSession, rows: list | None = None, clashing: bool = True) -> DataFrame:
    df = spark.createDataFrame(ROWS if rows is None else rows, DOCUMENTS)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING}) if clashing else df
