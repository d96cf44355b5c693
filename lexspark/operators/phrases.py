"""Phrase entries from neighbouring words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions import text as T


def phrase_entries(pairs: DataFrame, lexicon: DataFrame, min_count: int = 5, match: str = "exact") -> DataFrame:
    """(hanlo, rime_key, weight) of frequent pairs whose words are both in the lexicon: their weightiest texts joined, unless the entry is there already.

    match "exact" compares the pairs' bare words with codes as they are (few meet, as codes carry tones); "toneless" compares them without tones, with hyphens as spaces. The lexicon is read three times, so it should be a table or stored.
    """
    code = F.col("rime_key")
    key = code if match == "exact" else T.strip_all_tones(code)
    best = lexicon.groupBy(key.alias("key")).agg(F.min_by(F.struct(F.col("hanlo").alias("text"), F.col("rime_key").alias("code")), F.struct(-F.col("weight"), F.col("seq"))).alias("b"))
    word = lambda c: F.col(c) if match == "exact" else F.replace(F.col(c), F.lit("-"), F.lit(" "))
    rows = pairs.where(F.col("cnt") >= min_count).withColumns({"k1": word("w1"), "k2": word("w2")})
    rows = rows.join(best.select(F.col("key").alias("k1"), F.col("b").alias("b1")), "k1").join(best.select(F.col("key").alias("k2"), F.col("b").alias("b2")), "k2")
    out = rows.select(F.concat("b1.text", "b2.text").alias("hanlo"), F.concat_ws(" ", "b1.code", "b2.code").alias("rime_key"), T.phrase_weight(F.col("cnt")).alias("weight"))
    out = out.groupBy("hanlo", "rime_key").agg(F.max("weight").alias("weight"))
    return out.join(lexicon.select("hanlo", "rime_key").distinct(), ["hanlo", "rime_key"], "left_anti")
