"""Queries through files: tables written to the shared folder in the library's formats and read back by its readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.operators import lighttone, snapshots
from lexspark.session import shared_path
from lexspark.sources import csv_ranges, readers, sinks

from .corpus_queries import table
from .registry import register


def csv_of(df, name: str) -> str:
    """df as CSV files with all cells quoted; gives their folder."""
    path = shared_path(df.sparkSession, name)
    df.write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return path


@register("csv_by_ranges", """SELECT p_partkey, p_name || chr(10) || '"' || p_type || '", ' || p_brand || chr(10) AS note, repeat(p_name || chr(10), p_size) AS long_note FROM part""")
def csv_by_ranges(spark, sf_dir):
    """Cells with quotes, separators and line breaks, written as CSV and read by ranges of bytes."""
    note = F.concat("p_name", F.lit('\n"'), "p_type", F.lit('", '), "p_brand", F.lit("\n"))
    rows = table(spark, sf_dir, "part").select("p_partkey", note.alias("note"), F.repeat(F.concat("p_name", F.lit("\n")), F.col("p_size")).alias("long_note"))
    return csv_ranges.read_csv(spark, csv_of(rows, "parts")).select(F.col("p_partkey").cast("long").alias("p_partkey"), "note", "long_note")


_FIRST, _SECOND = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
_TONED = "array_to_string(list_transform(string_split(code, '-'), lambda s: CASE WHEN regexp_matches(s, '^[a-z]+$') THEN s || CASE WHEN regexp_matches(s, '[ptkh]$') THEN '4' ELSE '1' END ELSE s END), '-')"


@register(
    "dictionary_entries",
    f"""WITH d AS (SELECT replace(p_name, ' ', '-') || ' / ' || {_FIRST} || '(替)/' AS codes, CASE WHEN p_size % 9 = 0 THEN ' ' ELSE p_type END AS hanlo, p_brand AS hoabun, 'itaigi' AS source FROM part
UNION ALL SELECT {_SECOND} || '/' || {_FIRST} || '2', p_type, p_brand || chr(10) || '"' || p_size || '"', 'taihoa' FROM part
UNION ALL SELECT CASE WHEN p_size % 2 = 0 THEN {_SECOND} ELSE {_FIRST} || '-' || {_SECOND} || '5' END, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_type END, '', 'maryknoll' FROM part),
v AS (SELECT hanlo, hoabun, source, unnest(list_filter(list_transform(string_split(replace(codes, '(替)', ''), '/'), lambda x: trim(x)), lambda x: x <> '')) AS code FROM d WHERE trim(hanlo) <> '')
SELECT hanlo, {_TONED} AS kip_input, replace({_TONED}, '-', ' ') AS rime_key, hoabun, source FROM v""",
)
def dictionary_entries(spark, sf_dir):
    """Three dictionaries of different columns, with several codes, substitutes, blank texts and line breaks in a cell."""
    part = table(spark, sf_dir, "part").withColumns({"a": F.split_part("p_name", F.lit(" "), F.lit(1)), "b": F.split_part("p_name", F.lit(" "), F.lit(2))})
    text = F.when(F.col("p_size") % 9 == 0, " ").otherwise(F.col("p_type"))
    first = part.select(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(" / "), "a", F.lit("(替)/")).alias("KipInput"), text.alias("HanLoTaibunKip"), F.col("p_brand").alias("HoaBun"))
    note = F.concat("p_brand", F.lit('\n"'), F.col("p_size").cast("string"), F.lit('"'))
    second = part.select(F.col("b").alias("KipInput"), F.concat("a", F.lit("2")).alias("KipInputOthers"), F.col("p_type").alias("HanLoTaibunKip"), note.alias("HoaBun"))
    even, third = F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0
    other = part.select(F.when(even, "").otherwise(F.concat("a", F.lit("-"), "b", F.lit("5"))).alias("KipInput"), F.when(even, F.col("b")).otherwise("x").alias("PojInput"), F.when(third, "").otherwise(F.col("p_type")).alias("HanLoTaibunKip"), F.col("p_brand").alias("HanLoTaibunPoj"))
    read = lambda df, name: readers.csv(spark, csv_of(df, name))
    entries = readers.union([readers.itaigi_entries(read(first, "itaigi")), readers.taihoa_entries(read(second, "taihoa")), readers.generic_entries(read(other, "maryknoll"), "maryknoll")])
    return entries.select("hanlo", "kip_input", "rime_key", "hoabun", "source")


@register("lexicon_file", "SELECT p_type AS hanlo, p_name || ' ' || p_partkey AS rime_key, p_size AS weight FROM part")
def lexicon_file(spark, sf_dir):
    """A lexicon as text with header, in several ordered parts, read back."""
    path = shared_path(spark, "lexicon")
    sinks.write_lexicon(table(spark, sf_dir, "part").select(F.col("p_type").alias("hanlo"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("rime_key"), F.col("p_size").alias("weight")), path, "parts", "1")
    return readers.lexicon(spark, path).select("hanlo", "rime_key", "weight")


@register("frequency_files", f"SELECT word, sum(cnt)::BIGINT AS cnt FROM (SELECT {_FIRST} AS word, count(*) AS cnt FROM part GROUP BY 1 UNION ALL SELECT {_SECOND}, count(*) FROM part GROUP BY 1 UNION ALL SELECT p_type, max(p_size) FROM part GROUP BY 1) GROUP BY word")
def frequency_files(spark, sf_dir):
    """Frequency files by falling count, read and summed."""
    part = table(spark, sf_dir, "part")
    paths = []
    for word, count in ((F.split_part("p_name", F.lit(" "), F.lit(1)), F.count(F.lit(1))), (F.split_part("p_name", F.lit(" "), F.lit(2)), F.count(F.lit(1))), (F.col("p_type"), F.max("p_size"))):
        paths.append(shared_path(spark, "frequencies"))
        sinks.write_frequencies(part.groupBy(word.alias("word")).agg(count.alias("cnt")), paths[-1])
    return readers.frequencies(spark, paths)


@register("gloss_file", "SELECT p_name AS mandarin, max(p_type) AS kip FROM part GROUP BY p_name")
def gloss_file(spark, sf_dir):
    """A gloss map as text in code-point order, read back."""
    path = shared_path(spark, "glosses")
    sinks.write_gloss_map(table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("mandarin")).agg(F.max("p_type").alias("kip")), path)
    return readers.gloss_map(spark, path)


@register("writing_rule_file", "SELECT p_name AS word, arg_max(CASE WHEN p_size % 2 = 0 THEN 'han' ELSE 'lo' END, p_partkey) AS type, arg_max(p_type, p_partkey) AS kip, arg_max(p_brand, p_partkey) AS hoabun FROM part GROUP BY p_name")
def writing_rule_file(spark, sf_dir):
    """Writing rules as YAML blocks, of repeated words the last, read back."""
    path = shared_path(spark, "rules")
    kind = F.when(F.col("p_size") % 2 == 0, "han").otherwise("lo")
    sinks.write_rules(table(spark, sf_dir, "part").select(F.col("p_name").alias("word"), kind.alias("type"), F.col("p_type").alias("kip"), F.col("p_brand").alias("hoabun"), F.col("p_partkey").alias("seq")), path)
    return readers.writing_rules_yaml(spark, path).select("word", "type", "kip", "hoabun")


@register("word_file", "SELECT DISTINCT p_name AS word, len(p_name)::INTEGER AS n_chars FROM part")
def word_file(spark, sf_dir):
    path = shared_path(spark, "words")
    sinks.write_words(table(spark, sf_dir, "part").select(F.col("p_name").alias("word")).distinct(), path)
    return readers.word_list_yaml(spark, path)


@register("light_rule_file", "SELECT replace(p_name, ' ', '--') AS tl, p_type AS hanzi, p_brand AS rule FROM part")
def light_rule_file(spark, sf_dir):
    """Light-tone rules as one JSON array, read back."""
    path = shared_path(spark, "light")
    sinks.write_rules_json(table(spark, sf_dir, "part").select(F.replace("p_name", F.lit(" "), F.lit("--")).alias("tl"), F.col("p_type").alias("hanzi"), F.col("p_brand").alias("rule"), F.col("p_partkey").alias("seq")), path)
    return readers.light_tone_rules_json(spark, path).select("tl", "hanzi", "rule")


@register(
    "reverse_files",
    """SELECT p_name AS word, arg_min(p_type, p_partkey) AS reading, CASE WHEN arg_min(p_size, p_partkey) % 2 = 0 THEN 500 ELSE 300 END AS weight, 'first' AS kind FROM part GROUP BY p_name
UNION ALL SELECT p_name, p_type, CASE WHEN p_size % 3 = 0 THEN 500 ELSE 300 END, 'all' FROM part""",
)
def reverse_files(spark, sf_dir):
    """Both reverse dictionaries from CSV: the first row of each word, and all rows of the vocabulary."""
    part = table(spark, sf_dir, "part").orderBy("p_partkey").coalesce(1)  # one file, so that its order is the table's
    first = part.select(F.col("p_name").alias("漢字"), F.col("p_type").alias("羅馬字"), F.when(F.col("p_size") % 2 == 0, "主詞目").otherwise("附錄").alias("詞目類型"))
    second = part.select(F.col("p_name").alias("詞目"), F.col("p_type").alias("音讀"), F.col("p_partkey").alias("主編碼"), F.when(F.col("p_size") % 3 == 0, "0").otherwise("1").alias("文白屬性"))
    a = sinks.reverse_first(readers.reverse_rows(readers.csv(spark, csv_of(first, "reverse"))))
    b = sinks.vocabulary_reverse(readers.vocabulary_rows(readers.csv(spark, csv_of(second, "vocabulary"))))
    return a.select("word", F.col("roman").alias("reading"), "weight", F.lit("first").alias("kind")).unionByName(b.select(F.col("hanlo").alias("word"), "reading", "weight", F.lit("all").alias("kind")))


@register(
    "writing_rules_csv",
    """SELECT w AS word, CASE WHEN regexp_matches(w, '\p{Lo}') THEN 'han' ELSE 'lo' END AS type, coalesce(nullif(p_type, ''), '') AS kip, p_brand AS hoabun FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '食' || p_name END AS w FROM part)
UNION ALL SELECT p_name, CASE WHEN p_size % 5 = 0 THEN '不處理' ELSE '連' END, p_type, '' FROM part""",
)
def writing_rules_csv(spark, sf_dir):
    """Writing rules and light-tone rules from CSV."""
    part = table(spark, sf_dir, "part")
    word = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.lit("食"), "p_name"))
    rules = part.select(word.alias("建議用字"), F.lit("").alias("數字版音讀"), F.col("p_type").alias("音讀"), F.col("p_brand").alias("對應華語"))
    light = part.select(F.col("p_name").alias("臺羅"), F.col("p_type").alias("漢字"), F.when(F.col("p_size") % 5 == 0, "不處理").otherwise("連").alias("分連不處理"))
    a = readers.writing_rules(readers.csv(spark, csv_of(rules, "writing"))).select("word", "type", "kip", "hoabun")
    b = readers.light_tone_rules(readers.csv(spark, csv_of(light, "light")))
    return a.unionByName(b.select(F.col("tl").alias("word"), F.col("rule").alias("type"), F.col("hanzi").alias("kip"), F.lit("").alias("hoabun")))



@register(
    "corpus_files",
    """SELECT 'chapters' AS kind, p_name || ' a' AS line FROM part UNION ALL SELECT 'chapters', p_type FROM part UNION ALL SELECT 'works', p_name FROM part UNION ALL SELECT 'lines', p_type FROM part WHERE p_size % 4 <> 0
UNION ALL SELECT 'heads', p_name FROM part UNION ALL SELECT 'examples', p_type FROM part UNION ALL SELECT 'text', p_name || ' ' || p_type FROM part UNION ALL SELECT 'readings', p_name FROM part UNION ALL SELECT 'readings', p_type FROM part WHERE p_size % 2 = 0""",
)
def corpus_files(spark, sf_dir):
    """Corpora of each shape: JSON documents, one a brand, lines of text, and the reading columns of a dictionary."""
    part = table(spark, sf_dir, "part")

    def documents(*columns, text: bool = False) -> str:
        path = shared_path(spark, "corpus")
        rows = part.groupBy("p_brand").agg(*columns).write.partitionBy("p_brand")  # a row, so a file, for each brand
        (rows.text if text else rows.json)(path)
        return path

    pair = lambda c: F.array(F.lit("x"), c)
    paragraph = F.array(pair(F.concat("p_name", F.lit(" a\n"), "p_type")), F.array(F.lit("short")))
    chapters = readers.chapter_corpus(spark, documents(F.collect_list(F.struct(F.col("p_type").alias("篇名"), paragraph.alias("段"))).alias("資料")))
    works = readers.works_corpus(spark, documents(F.concat(F.collect_list(pair(F.col("p_name"))), F.array(pair(F.lit(" ")))).alias("資料")))
    lines = readers.lines_corpus(spark, documents(F.collect_list(F.when(F.col("p_size") % 4 == 0, " ").otherwise(F.col("p_type"))).alias("tailo")))
    entry = F.struct(F.col("p_partkey").cast("string").alias("id"), F.struct(F.col("p_name").alias("詞條臺羅"), F.col("p_type").alias("例句臺羅")).alias("e"))
    entries = readers.map_corpus(spark, documents(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"), text=True) + "/*")
    text = shared_path(spark, "corpus")
    part.select(F.concat_ws(" ", "p_name", "p_type").alias("value")).write.text(text)
    readings = part.select(F.col("p_name").alias("羅馬字"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("").alias("俗唸作"))
    parts = {"chapters": chapters, "works": works, "lines": lines, "heads": entries.select(F.col("head").alias("line")), "examples": entries.select(F.col("example").alias("line")), "text": readers.line_corpus(spark, text), "readings": readers.readings_corpus(readers.csv(spark, csv_of(readings, "readings")))}
    return readers.union([df.select(F.lit(kind).alias("kind"), "line") for kind, df in parts.items()])


@register("light_word_counts", "SELECT lower(replace(p_name, ' ', '--')) AS word, sum(p_size)::BIGINT AS cnt FROM part WHERE p_size % 3 <> 0 GROUP BY 1")
def light_word_counts(spark, sf_dir):
    """Words with a light-tone mark inside, by falling count; marks at the end and brackets are none."""
    name = F.col("p_name")
    word = F.when(F.col("p_size") % 3 == 0, F.concat(F.replace(name, F.lit(" "), F.lit("-(")), F.lit("--"))).otherwise(F.upper(F.replace(name, F.lit(" "), F.lit("--"))))
    return lighttone.ordered_light_words(table(spark, sf_dir, "part").groupBy(word.alias("word")).agg(F.sum("p_size").alias("cnt")))


@register("snapshot_rebuild", "SELECT p_type, count(*) AS n, sum(p_size)::BIGINT AS total, min(p_name) AS first_name FROM part GROUP BY p_type")
def snapshot_rebuild(spark, sf_dir):
    """Counts by type, first of a snapshot in which one brand's parts differ, then rebuilt for the buckets that the table's own rows change."""
    part = table(spark, sf_dir, "part").select("p_type", "p_name", "p_size", "p_partkey")
    before = table(spark, sf_dir, "part").select("p_type", "p_name", F.when(F.col("p_brand") == "Brand#1", 0).otherwise(F.col("p_size")).cast("int").alias("p_size"), "p_partkey")
    path = shared_path(spark, "snapshots")

    def counts(df):
        return df.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").cast("long").alias("total"), F.min("p_name").alias("first_name"))

    snapshots.write(before, f"{path}/1", ["p_type"], 64)
    snapshots.rebuild(before, f"{path}/0", f"{path}/1", f"{path}/out", counts, ["p_type"], 64)
    snapshots.write(part, f"{path}/2", ["p_type"], 64)
    return snapshots.rebuild(part, f"{path}/1", f"{path}/2", f"{path}/out", counts, ["p_type"], 64)
