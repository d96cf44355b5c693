"""Entries with light-tone marks, found by whole words or put together from segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions import text as T

from .lexicon import texts_by_code, weight_by_code


def light_words(counts: DataFrame) -> DataFrame:
    """(word, cnt) of words with a light-tone mark inside, lower-cased and summed."""
    word = F.lower("word")
    ok = F.contains(word, F.lit("--")) & ~F.endswith(word, F.lit("--")) & ~F.contains(word, F.lit("("))
    return counts.where(ok).groupBy(word.alias("word")).agg(F.sum("cnt").alias("cnt"))


def suffix_texts(rules: DataFrame) -> DataFrame:
    """(kip, hanzi): the first rule of each suffix, its spelling in digits. Rules of every kind count here."""
    return rules.withColumn("kip", T.numbered(F.lower("tl"))).groupBy("kip").agg(F.min_by("hanzi", "seq").alias("hanzi"))


def resolved_segments(segments: DataFrame, texts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """segments (with `kip`) with `hanzi`: the rule's, else the lexicon's if it has just one text, else null."""
    one = texts.where("n = 1").select("kip", F.element_at("texts", 1).alias("_one"))
    return segments.join(suffixes, "kip", "left").join(one, "kip", "left").withColumn("hanzi", F.coalesce("hanzi", "_one")).drop("_one")


def ordered_light_words(counts: DataFrame) -> DataFrame:
    """light_words by falling count, equals by the word."""
    return light_words(counts).orderBy(F.desc("cnt"), "word")


def resolved_tails(words: DataFrame, texts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(word, ok, tail) of words in `parts`: whether all parts behind the first are resolved, and their texts joined by marks (unresolved ones as they are)."""
    rows = words.select("word", F.posexplode(F.expr("slice(parts, 2, size(parts) - 1)")).alias("at", "kip"))
    rows = resolved_segments(rows, texts, suffixes)
    listed = F.array_sort(F.collect_list(F.struct("at", F.coalesce("hanzi", "kip").alias("t"))))
    return rows.groupBy("word").agg(F.bool_and(F.col("hanzi").isNotNull()).alias("ok"), F.array_join(F.transform(listed, lambda x: x["t"]), "--").alias("tail"))


def found_texts(words: DataFrame, lexicon: DataFrame, rules: DataFrame) -> DataFrame:
    """(word, hanlo): marked texts of each word.

    A word of two parts takes the texts of the whole word; only if there are none, and for words of more parts always, each text of the first part is joined with the segments behind it, if all are resolved.
    """
    texts, suffixes = texts_by_code(lexicon), suffix_texts(rules)
    parts = words.select("word", F.split("word", "--", -1).alias("parts")).where("size(parts) >= 2 AND NOT exists(parts, p -> p = '')")
    head = F.element_at("parts", 1)
    whole = parts.where("size(parts) = 2").select("word", T.syllable_count(head).alias("before"), F.array_join("parts", "-").alias("kip"))
    whole = whole.join(texts, "kip").select("word", "before", F.explode("texts").alias("plain")).withColumn("hanlo", T.with_light_mark(F.col("plain"), F.col("before")))
    whole = whole.where("contains(hanlo, '--') AND hanlo <> plain").select("word", "hanlo")
    rest = parts.join(whole.select("word").distinct(), "word", "left_anti")
    tails = resolved_tails(rest, texts, suffixes).where("ok").select("word", "tail")
    heads = rest.select("word", F.element_at("parts", 1).alias("kip")).join(texts, "kip").select("word", F.explode("texts").alias("head"))
    made = heads.join(tails, "word").select("word", F.concat_ws("--", "head", "tail").alias("hanlo"))
    return whole.unionByName(made)


def light_tone_entries(counts: DataFrame, lexicon: DataFrame, rules: DataFrame) -> DataFrame:
    """(hanlo, rime_key, weight) of light-tone words of the corpus that the lexicon lacks; capped by the plain variant's weight."""
    words = light_words(counts)
    found = found_texts(words, lexicon, rules).join(words, "word")
    plain = weight_by_code(lexicon).select(F.col("kip").alias("_plain"), F.col("weight").alias("_cap"))
    found = found.withColumn("_plain", F.replace("word", F.lit("--"), F.lit("-"))).join(plain, "_plain", "left")
    out = found.select("hanlo", T.code_to_key(F.col("word")).alias("rime_key"), T.light_tone_weight(F.col("cnt"), F.col("_cap")).alias("weight"))
    return out.distinct().join(lexicon.select("hanlo", "rime_key").distinct(), ["hanlo", "rime_key"], "left_anti")
