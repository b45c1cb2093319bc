"""Text rewriting by pattern, line by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integer-like SQL type of one dialect to that of another, as a whole word and in any case.
NUMBER_TYPE, DECIMAL_TYPE = r"(?i)\bnumber\s*\(", "decimal("

LINE_ENDS = r"\r\n|\r|\n"


def rewrite(text: Column, pattern: str = NUMBER_TYPE, put: str = DECIMAL_TYPE) -> Column:
    return F.regexp_replace(text, pattern, put)


def numbered_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 1, line) of every line; a line end at the very end begins no line, an empty text has none."""
    lines = F.split(F.regexp_replace(F.col(text), rf"(?:{LINE_ENDS})\z", ""), LINE_ENDS)
    return df.where(F.length(text) > 0).select(F.col(key).alias("key"), F.posexplode(lines).alias("pos", "line")).select("key", (F.col("pos") + 1).alias("line_no"), "line")


def changed_lines(df: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, line_no, before, after) of lines that differ; the lists are zipped by position up to the shorter one."""
    lines = lambda c: F.split(F.col(c), LINE_ENDS)
    pairs = df.select(F.col(key).alias("key"), F.posexplode(F.slice(F.arrays_zip(lines(before).alias("before"), lines(after).alias("after")), F.lit(1), F.least(F.size(lines(before)), F.size(lines(after))))).alias("pos", "z"))
    return pairs.select("key", (F.col("pos") + 1).alias("line_no"), F.col("z.before").alias("before"), F.col("z.after").alias("after")).where(~F.col("before").eqNullSafe(F.col("after")))
