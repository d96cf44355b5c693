"""From dictionaries, corpora and rules to a lexicon and its companions, in one go; `python -m lexspark.plans.build --help` runs it."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexspark.operators import corpus, glossmap, lexicon, lighttone, phrases
from lexspark.sources import readers, sinks


def counted(df: DataFrame, name: str, **values) -> tuple[DataFrame, Observation]:
    """df and what is counted of it in the pass that writes it."""
    seen = Observation(name)
    return df.observe(seen, *(v.alias(k) for k, v in values.items())), seen


def build(spark: SparkSession, dictionaries: str, lines: DataFrame, rules: DataFrame, out: str, version: str = "1", match: str = "exact", min_count: int = 5, reverse: str | None = None, vocabulary: str | None = None, writing_rules: str | None = None) -> DataFrame:
    """Writes lexicon, frequencies, sentences, gloss map and, where their sources are given, the reverse dictionaries and rule files below `out`, and gives the lexicon (hanlo, rime_key, weight).

    dictionaries: a folder of dictionary files; lines: (line) of all corpora; rules: light-tone rules; reverse, vocabulary, writing_rules: CSV files. Lines are tokenised once, as the table of sentences that counts, pairs and the text form are made of. Base entries are weighted by corpus counts, written as Parquet and read again, so phrases and light-tone words find what they lack in a table. `report.json` has what was counted while writing.
    """
    one, tokens = F.lit(1), F.col("cnt")
    report = {}
    sentences, seen = counted(corpus.sentences(lines), "sentences", sentences=F.count(one), sentence_tokens=F.sum(F.size("tokens")))
    sentences.write.mode("overwrite").parquet(f"{out}/sentences")
    report |= seen.get
    sentences = spark.read.parquet(f"{out}/sentences")
    counts = sentences.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count(one).alias("cnt"))
    counts, seen = counted(counts, "counts", unique_words=F.count(one), total_tokens=F.coalesce(F.sum(tokens), F.lit(0)))
    counts.write.mode("overwrite").parquet(f"{out}/counts")
    report |= seen.get
    counts = spark.read.parquet(f"{out}/counts")
    lexicon.weighted(readers.dictionary_entries(spark, dictionaries), counts).write.mode("overwrite").parquet(f"{out}/base")
    base = spark.read.parquet(f"{out}/base")
    pairs = corpus.pair_counts(sentences, min_count=min_count)
    whole = sinks.appended(base.select("hanlo", "rime_key", "weight"), phrases.phrase_entries(pairs, base, min_count, match), lighttone.light_tone_entries(counts, base, rules))
    broken = (F.trim("hanlo") == "") | (F.trim("rime_key") == "") | F.contains("hanlo", F.lit("\t")) | F.contains("rime_key", F.lit("\t"))
    whole, seen = counted(whole, "lexicon", entries=F.count(one), violations=F.count_if(broken), heaviest=F.max("weight"))
    whole.write.mode("overwrite").parquet(f"{out}/lexicon")
    report |= seen.get
    whole = spark.read.parquet(f"{out}/lexicon")
    sinks.write_lexicon(whole, f"{out}/lexicon.txt", "lexicon", version)
    sinks.write_frequencies(counts, f"{out}/frequencies.txt")
    sinks.write_sentences(sentences, f"{out}/sentences.txt")
    sinks.write_gloss_map(glossmap.gloss_map(readers.gloss_rows(spark, dictionaries)), f"{out}/glosses.txt")
    if reverse:
        found = sinks.reverse_first(readers.reverse_rows(readers.csv(spark, reverse)))
        sinks.write_lexicon(found.select(F.col("word").alias("hanlo"), F.col("roman").alias("rime_key"), "weight"), f"{out}/reverse.txt", "reverse", version)
    if vocabulary:
        found = sinks.vocabulary_reverse(readers.vocabulary_rows(readers.csv(spark, vocabulary)))
        sinks.write_lexicon(found.select("hanlo", F.col("reading").alias("rime_key"), "weight"), f"{out}/vocabulary.txt", "vocabulary", version)
    if writing_rules:
        found = readers.csv(spark, writing_rules)
        sinks.write_rules(readers.writing_rules(found), f"{out}/writing_rules.yaml")
        sinks.write_words(readers.word_list(found), f"{out}/words.yaml")
    sinks.write_rules_json(rules, f"{out}/light_tones.json")
    spark.createDataFrame([(json.dumps(report),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/report.json")
    return whole


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    """The command line. On a cluster, spark-submit brings the session."""
    p = argparse.ArgumentParser(prog="python -m lexspark.plans.build", description=build.__doc__.splitlines()[0])
    p.add_argument("--dictionaries", required=True, help="folder of dictionary files")
    p.add_argument("--corpus", required=True, nargs="+", help="text files or folders")
    p.add_argument("--rules", required=True, help="light-tone rules (CSV)")
    p.add_argument("--output", required=True, help="folder for all results")
    p.add_argument("--reverse", help="reverse dictionary (CSV)")
    p.add_argument("--vocabulary", help="vocabulary with readings (CSV)")
    p.add_argument("--writing-rules", help="rules for Han or Latin writing (CSV)")
    p.add_argument("--min-count", type=int, default=5, help="least count of a pair that makes a phrase")
    p.add_argument("--match", choices=("exact", "toneless"), default="exact", help="how words of pairs meet codes")
    p.add_argument("--lexicon-version", default="1")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("lexspark-build").getOrCreate()
    rules = readers.light_tone_rules(readers.csv(spark, a.rules))
    whole = build(spark, a.dictionaries, readers.line_corpus(spark, a.corpus), rules, a.output, a.lexicon_version, a.match, a.min_count, a.reverse, a.vocabulary, a.writing_rules)
    print(json.dumps({"entries": whole.count(), "output": a.output}))


if __name__ == "__main__":
    main()
