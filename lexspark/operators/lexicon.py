"""From raw entries to a weighted lexicon, and what is read off it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import text as T


def first_seen(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The first row of each key by seq. An aggregate, so it is combined before the shuffle and no key is held whole."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), seq).alias("_r")).select(*keys, "_r.*").select(df.columns)


def last_wins(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last row of each key by seq."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(*keys, "_r.*").select(df.columns)


def weighted(entries: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """One row per (hanlo, rime_key): that of the weightiest source, the first of equals, with `weight`.

    Weight: source, text length, how many sources agree, and corpus counts of the code (case matters).
    """
    ranked = entries.withColumn("_w", T.source_weight(F.col("source")))
    rest = [c for c in entries.columns if c not in ("hanlo", "rime_key")]
    best = ranked.groupBy("hanlo", "rime_key").agg(
        F.min_by(F.struct("_w", *rest), F.struct(-F.col("_w"), F.col("seq"))).alias("_b"),
        F.count_distinct("source").alias("_n"),
    )
    rows = best.select("hanlo", "rime_key", "_b.*", "_n")
    if counts is None:
        rows = rows.withColumn("cnt", F.lit(0))
    else:
        rows = rows.join(counts.select(F.col("word").alias("kip_input"), "cnt"), "kip_input", "left").fillna(0, ["cnt"])
    weight = T.entry_weight(F.col("_w"), T.length_modifier(F.col("hanlo")), F.col("_n"), F.col("cnt"))
    return rows.withColumn("weight", weight).select("hanlo", "kip_input", "rime_key", "hoabun", "source", "weight", "seq")


def top_by_key(df: DataFrame, key: str, k: int, order: list) -> DataFrame:
    """The first k rows of each key. k = 1 and plain columns go better through first_seen."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= k)


def reverse_index(lexicon: DataFrame) -> DataFrame:
    """(rime_key, entries): texts and weights of each code, weightiest first, equals in file order."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("_w"), "seq", F.col("hanlo").alias("text"), "weight")))
    return lexicon.groupBy("rime_key").agg(F.transform(listed, lambda x: F.struct(x["text"].alias("text"), x["weight"].alias("weight"))).alias("entries"))


def texts_by_code(lexicon: DataFrame) -> DataFrame:
    """(kip, texts, n): the distinct texts of each code in hyphenated form, sorted."""
    return lexicon.groupBy(T.key_to_code(F.col("rime_key")).alias("kip")).agg(F.sort_array(F.collect_set("hanlo")).alias("texts")).withColumn("n", F.size("texts"))


def weight_by_code(lexicon: DataFrame) -> DataFrame:
    """(kip, weight): the largest weight of each code."""
    return lexicon.groupBy(T.key_to_code(F.col("rime_key")).alias("kip")).agg(F.max("weight").alias("weight"))


def without(df: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't there yet."""
    return df.join(existing.select(*keys).distinct(), keys, "left_anti")
