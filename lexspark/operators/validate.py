"""Checks of lexicon files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.sources.readers import numbered_lines


def duplicate_rows(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows that repeat the keys of an earlier row. Only keys that several rows have meet the rows again."""
    first = df.groupBy(*keys).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return df.join(first, keys).where(F.col(order) > F.col("_first")).drop("_first")


def violations(spark, path: str) -> DataFrame:
    """(file, line_no, kind, value): a missing header or end of it, lines with fewer than two fields, and repeated (text, code) pairs."""
    lines = numbered_lines(spark, path)
    heads = lines.groupBy("file").agg(F.bool_or(F.trim("value") == "---").alias("start"), F.min(F.when(F.trim("value") == "...", F.col("line_no"))).alias("end"))
    no_start = heads.where("NOT start").select("file", F.lit(0).alias("line_no"), F.lit("header").alias("kind"), F.lit("").alias("value"))
    no_end = heads.where("end IS NULL").select("file", F.lit(0).alias("line_no"), F.lit("terminator").alias("kind"), F.lit("").alias("value"))
    body = lines.join(heads.where("end IS NOT NULL").select("file", "end"), "file").where("line_no > end AND trim(value) <> '' AND NOT startswith(value, '#')")
    body = body.withColumn("f", F.split("value", "\t", -1))
    short = body.where("size(f) < 2").select("file", "line_no", F.lit("format").alias("kind"), "value")
    keyed = body.where("size(f) >= 2").select("file", "line_no", "value", F.get("f", F.lit(0)).alias("k1"), F.get("f", F.lit(1)).alias("k2"))
    twice = duplicate_rows(keyed, ["file", "k1", "k2"], "line_no").select("file", "line_no", F.lit("duplicate").alias("kind"), "value")
    return no_start.unionByName(no_end).unionByName(short).unionByName(twice)


def exit_code(found: DataFrame) -> int:
    """0 if nothing was found, else 1."""
    return 0 if found.isEmpty() else 1
