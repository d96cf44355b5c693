"""Tables kept as snapshots in buckets with checksums, and results that are rebuilt for the buckets that differ alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

BUCKETS = 256


def bucketed(df: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """df with `_bucket`, by a hash of the keys."""
    return df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def write(df: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """A snapshot: rows in a folder for each bucket of the keys, and (_bucket, n, check_a, check_b) beside them.

    Checksums are taken over all columns of each row, in any order of rows; repeated rows count. They are read from what was written, so they tell of the files.
    """
    spark = df.sparkSession
    bucketed(df, keys, buckets).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/rows")
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in df.columns]
    hashes = rows(spark, path, df).select("_bucket", F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    hashes.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"), whole("a").alias("check_a"), whole("b").alias("check_b")).coalesce(1).write.mode("overwrite").parquet(f"{path}/checks")


def _with_bucket(like: DataFrame) -> StructType:
    return StructType([*like.schema.fields, StructField("_bucket", IntegerType())])


def rows(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The rows of a snapshot, with `_bucket`; like: a table of the same columns."""
    return spark.read.schema(_with_bucket(like)).parquet(f"{path}/rows")


def _checks(spark: SparkSession, path: str) -> dict[int, tuple]:
    try:
        found = spark.read.parquet(f"{path}/checks").collect()  # a row a bucket
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return {}
        raise
    return {r["_bucket"]: (r["n"], r["check_a"], r["check_b"]) for r in found}


def differing(spark: SparkSession, old: str, new: str) -> list[int]:
    """The buckets whose rows differ between two snapshots of the same number of buckets, those of one alone included. An old one that isn't there has none."""
    a, b = _checks(spark, old), _checks(spark, new)
    return sorted(k for k in {*a, *b} if a.get(k) != b.get(k))


def rebuild(like: DataFrame, old: str, new: str, out: str, aggregate: Callable[[DataFrame], DataFrame], keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The aggregate of the new snapshot, made anew for the buckets that differ from the old one's; the others stay as they lie in `out`.

    aggregate gives rows that keep the keys and depend on the rows of their own keys alone (a groupBy of the keys, or of more). Buckets are overwritten one folder each, so a rebuild that was broken off is simply done again: the old snapshot still names what differs. What differs is read by folder, so the plan reads those buckets alone.
    """
    spark = like.sparkSession
    found = differing(spark, old, new)
    made = aggregate(rows(spark, new, like).where(F.col("_bucket").isin(found)).drop("_bucket"))
    if found:
        changed = bucketed(made, keys, buckets).repartition("_bucket")
        changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(out)
    present = sorted(_checks(spark, new))  # a bucket whose rows are all gone has no folder in the new snapshot, and is left
    whole = spark.read.schema(_with_bucket(made)).parquet(out) if present else bucketed(made, keys, buckets)
    return whole.where(F.col("_bucket").isin(present)).drop("_bucket")
