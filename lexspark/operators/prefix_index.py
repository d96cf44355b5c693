"""A stored index from every prefix of a lexicon's codes to its weightiest entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .lookup import LIMIT


def build(lexicon: DataFrame, path: str, k: int = LIMIT) -> int:
    """Writes the k weightiest entries of each prefix below `path`, a folder for each length; gives the number of lengths.

    From the longest codes up: what a prefix needs are its own entries and the k best of each prefix one character longer, so a level reads the level below it and the codes of its own length, never all entries that begin so. Each level is written before the next is made. Entries rank by falling weight, code and text. Prefixes of no character have no entries.
    """
    spark = lexicon.sparkSession
    lexicon.where("rime_key <> ''").withColumn("len", F.length("rime_key")).repartition("len").write.mode("overwrite").partitionBy("len").parquet(f"{path}/codes")
    codes = spark.read.schema(StructType([*lexicon.schema.fields, StructField("len", IntegerType())])).parquet(f"{path}/codes")
    top = codes.agg(F.max("len")).first()[0] or 0
    columns = lexicon.columns
    by_rank = Window.partitionBy("prefix").orderBy(F.desc("weight"), "rime_key", "hanlo")
    for at in range(max(top, 1), 0, -1):  # of an empty lexicon, one empty level
        rows = codes.where(F.col("len") == at).select(*columns)
        if at < top:
            rows = rows.unionByName(spark.read.schema(level.schema).parquet(f"{path}/prefixes/len={at + 1}").select(*columns))
        # row_number below a limit is pruned before the shuffle too, so a prefix with many entries sends k from each task
        level = rows.withColumn("prefix", F.left("rime_key", F.lit(at))).withColumn("pos", F.row_number().over(by_rank)).where(F.col("pos") <= k)
        level.sortWithinPartitions("prefix", "pos").write.mode("overwrite").parquet(f"{path}/prefixes/len={at}")
    return top


def look_up(queries: DataFrame, path: str) -> DataFrame:
    """(query_id, input) with their entries and `pos`: an equi-join on length and prefix, which meets the k rows of each input's prefix and no others."""
    index = queries.sparkSession.read.parquet(f"{path}/prefixes")
    asked = queries.withColumns({"prefix": F.col("input"), "len": F.length("input")})
    return asked.join(index, ["len", "prefix"]).drop("len", "prefix")


def entries(spark: SparkSession, path: str, inputs: list[str]) -> DataFrame:
    """Entries of a few inputs known beforehand: only their lengths' folders and, by the pages' statistics, their prefixes' pages are read."""
    index = spark.read.parquet(f"{path}/prefixes")
    return index.where(F.col("len").isin(sorted({len(x) for x in inputs})) & F.col("prefix").isin(inputs))
