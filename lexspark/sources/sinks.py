"""Exports of lexicons, frequency tables, sentences, rules and maps. Parquet is the canonical store; these are the text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_ordered(df: DataFrame, path: str, *order, head: list[str] | None = None, foot: list[str] | None = None) -> None:
    """`value` lines in an order, between lines of a head and a foot: a folder of text parts that go on from one to the next. Lines are dealt by ranges, so no task holds them all."""
    ends = [(0, i, x) for i, x in enumerate(head or [])] + [(2, i, x) for i, x in enumerate(foot or [])]
    fixed = df.sparkSession.createDataFrame(ends, "_part int, _line int, value string")
    lines = df.select(F.lit(1).alias("_part"), F.lit(0).alias("_line"), F.struct(*order).alias("_order"), "value")
    whole = lines.unionByName(fixed.select("_part", "_line", F.lit(None).cast(lines.schema["_order"].dataType).alias("_order"), "value")) if ends else lines
    whole.orderBy("_part", "_line", "_order").select("value").write.mode("overwrite").text(path)


def write_lexicon(df: DataFrame, path: str, name: str, version: str) -> None:
    """Text, code and weight, ordered by code and falling weight; the first part starts with the header."""
    head = ["# lexicon", "---", f"name: {name}", f'version: "{version}"', "sort: by_weight", "use_preset_vocabulary: false", "..."]
    line = F.concat_ws("\t", "hanlo", "rime_key", F.col("weight").cast("string"))
    write_ordered(df.withColumn("value", line), path, F.col("rime_key"), (-F.col("weight")).alias("w"), F.col("hanlo"), head=head)


def write_frequencies(df: DataFrame, path: str) -> None:
    """(word, cnt) by falling count; ties by first place (`seq`) if there is one, else by word."""
    tie = "seq" if "seq" in df.columns else "word"
    df.orderBy(F.desc("cnt"), tie).select(F.concat_ws("\t", "word", F.col("cnt").cast("string")).alias("value")).write.mode("overwrite").text(path)


def sentence_line() -> Column:
    """Tokens as a line."""
    return F.array_join("tokens", " ")


def write_sentences(df: DataFrame, path: str) -> None:
    """Token lists as lines; empty ones are dropped."""
    df.where("size(tokens) > 0").select(sentence_line().alias("value")).write.mode("overwrite").text(path)


def last_rules(df: DataFrame) -> DataFrame:
    """Writing rules with the last row of each word, in the order of first rows."""
    out = df.groupBy("word").agg(F.max_by(F.struct("type", "kip", "hoabun"), "seq").alias("r"), F.min("seq").alias("seq"))
    return out.select("word", "r.*", "seq")


def write_rules(df: DataFrame, path: str) -> None:
    """Writing rules as YAML blocks."""
    q = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    block = F.concat(q(F.col("word")), F.lit(":\n  type: "), F.col("type"), F.lit("\n  kip: "), q(F.col("kip")), F.lit("\n  hoabun: "), q(F.col("hoabun")))
    write_ordered(last_rules(df).withColumn("value", block), path, F.col("seq"))


def write_words(df: DataFrame, path: str) -> None:
    """A word list as YAML."""
    write_ordered(df.withColumn("value", F.concat(F.lit('- "'), "word", F.lit('"'))), path, F.col("word"))


def write_rules_json(df: DataFrame, path: str) -> None:
    """Light-tone rules as one JSON array, a rule a line; all but the first line bring their comma. Rules with the same seq go by their texts, and equal ones are numbered, so just one line is the first."""
    rule = F.struct("seq", "tl", "hanzi", "rule")
    rows = df.groupBy("seq", "tl", "hanzi", "rule").agg(F.count(F.lit(1)).alias("_n"))
    first = df.agg(F.min(rule).alias("_first"))
    rows = rows.crossJoin(F.broadcast(first)).select("*", F.explode(F.sequence(F.lit(1), "_n")).alias("_i"))
    comma = F.when(rule.eqNullSafe(F.col("_first")) & (F.col("_i") == 1), F.lit("")).otherwise(F.lit(","))
    write_ordered(rows.withColumn("value", F.concat(comma, F.to_json(F.struct("tl", "hanzi", "rule")))), path, F.col("seq"), F.col("tl"), F.col("hanzi"), F.col("rule"), F.col("_i"), head=["["], foot=["]"])


def vocabulary_reverse(df: DataFrame) -> DataFrame:
    """Reverse lexicon of the vocabulary: weight 500 for plain readings, 300 for literary or colloquial ones; nothing is deduplicated."""
    return df.select(F.col("word").alias("hanlo"), F.col("word").alias("rime_key"), "reading", F.when(F.col("wen_bai") == "0", 500).otherwise(300).alias("weight"))


def reverse_first(df: DataFrame) -> DataFrame:
    """Reverse lexicon of the other dictionary: the first row of each word, 500 for main entries, else 300."""
    first = df.groupBy("word").agg(F.min_by(F.struct("roman", "kind"), "seq").alias("r"))
    return first.select("word", F.col("r.roman").alias("roman"), F.when(F.col("r.kind") == "主詞目", 500).otherwise(300).alias("weight"))


def write_gloss_map(df: DataFrame, path: str) -> None:
    """(mandarin, kip) in code-point order."""
    df.orderBy("mandarin").select(F.concat_ws("\t", "mandarin", "kip").alias("value")).write.mode("overwrite").text(path)


def appended(lexicon: DataFrame, *more: DataFrame) -> DataFrame:
    """A lexicon with generated entries, for one write."""
    for df in more:
        lexicon = lexicon.unionByName(df.select(lexicon.columns))
    return lexicon
