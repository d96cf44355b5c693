"""Readers of dictionaries, corpora, rules and lexicon files. All give rows with an explicit order column `seq` where first or last rows decide."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions import text as T

from .csv_ranges import read_csv

# File-name fragment -> source, the order of sources, gloss priorities, reading columns.
SOURCE_FILES = {
    "iTaigiHoataiTuichiautian": "itaigi",
    "TaihoaSoanntengTuichiautian": "taihoa",
    "KauiokpooTaigiSutian": "moe",
    "TaijitToaSutian": "taijit",
    "MaryknollTaiengSutian": "maryknoll",
    "EmbreeTaiengSutian": "embree",
    "KamJitian": "kamjitian",
    "TaioanPehoeKichhooGiku": "pehoe",
    "TaioanSitbutMialui": "sitbut",
}
GLOSS_PRIORITY = {"moe": 4, "itaigi": 3, "taihoa": 2, "maryknoll": 1}
READING_COLUMNS = ("羅馬字", "又唸作", "合音唸作", "俗唸作")

ENTRY = ("hanlo", "kip_input", "rime_key", "hoabun", "source", "seq")


def csv(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """CSV with header, quoted line breaks and doubled quotes, read by ranges of bytes; a byte-order mark is no part of the first name.

    `_file` and `_row` order rows by file and place: the number of the record in its file, whichever tasks read it.
    """
    return read_csv(spark, path, sep)


def cell(df: DataFrame, name: str) -> Column:
    """A trimmed cell; empty if blank, absent in the row or no column at all."""
    return F.coalesce(F.trim(F.col(f"`{name}`")), F.lit("")) if name in df.columns else F.lit("")


def either(*columns: Column) -> Column:
    """The first that isn't blank, else empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def _order(*more: Column) -> Column:
    return F.struct(F.col("_file").alias("file"), F.col("_row").alias("row"), *(c.alias(f"n{i}") for i, c in enumerate(more)))


def _entries(df: DataFrame, codes: Column, hanlo: Column, hoabun: Column, source: Column, rank: Column) -> DataFrame:
    """One row per code variant with a text: the lexicon's raw entries."""
    out = df.select("_file", "_row", hanlo.alias("hanlo"), hoabun.alias("hoabun"), source.alias("source"), rank.alias("_rank"), F.posexplode(codes).alias("_n", "_code"))
    out = out.where("hanlo <> ''").withColumn("kip_input", T.implicit_tone(F.col("_code")))
    seq = F.struct("_rank", F.col("_file"), F.col("_row"), F.col("_n"))
    return out.withColumns({"rime_key": F.replace(F.col("kip_input"), F.lit("-"), F.lit(" ")), "seq": seq}).select(*ENTRY)


def itaigi_entries(df: DataFrame, rank: int = 0) -> DataFrame:
    codes = T.code_variants(cell(df, "KipInput"))
    return _entries(df, codes, cell(df, "HanLoTaibunKip"), cell(df, "HoaBun"), F.lit("itaigi"), F.lit(rank))


def taihoa_entries(df: DataFrame, rank: int = 1) -> DataFrame:
    """Main codes, then other readings."""
    codes = F.concat(T.code_variants(cell(df, "KipInput")), T.code_variants(cell(df, "KipInputOthers")))
    return _entries(df, codes, cell(df, "HanLoTaibunKip"), cell(df, "HoaBun"), F.lit("taihoa"), F.lit(rank))


def generic_entries(df: DataFrame, source: str | Column, rank: int = 2) -> DataFrame:
    """Codes and texts of the first system, else of the second; any of the columns may be absent."""
    codes = T.code_variants(either(cell(df, "KipInput"), cell(df, "PojInput")))
    hanlo = either(cell(df, "HanLoTaibunKip"), cell(df, "HanLoTaibunPoj"))
    return _entries(df, codes, hanlo, cell(df, "HoaBun"), T.lit(source), F.lit(rank))


def source_of(file_name: Column) -> Column:
    """The source that a file name stands for; null if unknown."""
    return F.coalesce(*(F.when(F.contains(file_name, F.lit(k)), F.lit(v)) for k, v in SOURCE_FILES.items()))


def found(spark: SparkSession, path: str, pattern: str = "*") -> list[str]:
    """Paths of the files below a path whose names fit, sorted by name; none if there is no such path. Spark lists them, so any store that it reads will do; no content is read."""
    try:
        rows = spark.read.format("binaryFile").options(pathGlobFilter=pattern, recursiveFileLookup=True).load(path).select("path").collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise
    return sorted((r.path for r in rows), key=lambda x: (x.rpartition("/")[2], x))


def dictionary_files(spark: SparkSession, folder: str, prefix: str = "ChhoeTaigi_") -> list[tuple[str, str]]:
    """(path, source) of the known dictionary files of a folder, sorted by name."""
    return [(x, s) for x in found(spark, folder, f"{prefix}*.csv") for k, s in SOURCE_FILES.items() if k in x.rpartition("/")[2]]


def dictionary_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of all dictionaries of a folder: itaigi, then taihoa, then the others by file name."""
    parts = []
    for path, source in dictionary_files(spark, folder):
        df = csv(spark, path)
        parts.append(itaigi_entries(df) if source == "itaigi" else taihoa_entries(df) if source == "taihoa" else generic_entries(df, source))
    return union(parts)


def union(parts: list[DataFrame]) -> DataFrame:
    if not parts:
        raise ValueError("no sources")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gloss_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(hoabun, kip, priority, hanlo, seq) of the four dictionaries that gloss maps are made of."""
    parts = []
    for path, source in dictionary_files(spark, folder):
        if source in GLOSS_PRIORITY:
            df = csv(spark, path)
            kip = T.first_code(either(cell(df, "KipInput"), cell(df, "PojInput")))
            hanlo = either(cell(df, "HanLoTaibunKip"), cell(df, "HanLoTaibunPoj"))
            parts.append(df.select(cell(df, "HoaBun").alias("hoabun"), kip.alias("kip"), F.lit(GLOSS_PRIORITY[source]).alias("priority"), hanlo.alias("hanlo"), F.struct("_file", "_row").alias("seq")).where("hoabun <> '' AND kip IS NOT NULL"))
    return union(parts)


# --- corpora --------------------------------------------------------------------------------


def line_corpus(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """(line) of text files, of whole folders too."""
    read = spark.read.option("recursiveFileLookup", True)
    return (read.option("pathGlobFilter", pattern) if pattern else read).text(path).select(F.col("value").alias("line"))


def _json(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Whole JSON files; broken ones are skipped."""
    return spark.read.schema(schema).options(multiLine=True, recursiveFileLookup=True, mode="DROPMALFORMED", pathGlobFilter="*.json").json(path)


def chapter_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(line) from objects of chapters of paragraphs, each [text, romanisation]; shorter paragraphs are skipped, line breaks part lines."""
    rows = _json(spark, path, "`資料` array<struct<`篇名`: string, `段`: array<array<string>>>>")
    parts = rows.select(F.explode("資料").alias("c")).select(F.explode("c.段").alias("p")).where("size(p) >= 2")
    return parts.select(F.explode(F.split(F.get("p", F.lit(1)), r"\R")).alias("line")).where("trim(line) <> ''")


def works_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(line) from arrays of works with [text, romanisation] pairs; works without pairs and blank lines are skipped."""
    rows = _json(spark, path, "`資料` array<array<string>>")
    return rows.select(F.explode("資料").alias("p")).where("size(p) >= 2").select(F.get("p", F.lit(1)).alias("line")).where("trim(line) <> ''")


def lines_corpus(spark: SparkSession, path: str, field: str = "tailo") -> DataFrame:
    """(line) from arrays of objects that hold a list of lines."""
    return _json(spark, path, f"`{field}` array<string>").select(F.explode(field).alias("line")).where("trim(line) <> ''")


def map_corpus(spark: SparkSession, path: str, head: str = "詞條臺羅", example: str = "例句臺羅") -> DataFrame:
    """(id, head, example) from a JSON object of entries by id; both fields count tokens, only the example is a sentence."""
    texts = spark.read.option("wholetext", True).text(path)
    entries = F.from_json("value", f"map<string, struct<`{head}`: string, `{example}`: string>>")
    out = texts.select(F.explode(entries).alias("id", "e"))
    return out.select("id", F.coalesce(F.col(f"e.{head}"), F.lit("")).alias("head"), F.coalesce(F.col(f"e.{example}"), F.lit("")).alias("example"))


def first_with_rows(*frames: DataFrame) -> DataFrame:
    """The first frame that has rows, else the last: JSON before text, for example."""
    for df in frames[:-1]:
        if not df.isEmpty():
            return df
    return frames[-1]


def textbook_corpus(spark: SparkSession, *folders: str) -> DataFrame:
    """chapter_corpus of the first folder that holds JSON files."""
    for folder in folders:
        if found(spark, folder, "*.json"):
            return chapter_corpus(spark, folder)
    raise ValueError("no sources")


def literary_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(line) of the works in JSON files; without any, of the text files."""
    return first_with_rows(works_corpus(spark, path), line_corpus(spark, path, "*.{tbk,txt}").where("trim(line) <> ''"))


def poj_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(line) of lists of lines in JSON files; only if they give no line, of the text files. Lines are respelled from the other system."""
    lines = first_with_rows(lines_corpus(spark, path), line_corpus(spark, path, "*.txt").where("trim(line) <> ''"))
    return lines.select(T.poj_to_tl(F.trim("line")).alias("line"))


def readings_corpus(df: DataFrame) -> DataFrame:
    """(line) of the reading columns of a dictionary, one line each."""
    return df.select(F.explode(F.array(*(cell(df, c) for c in READING_COLUMNS))).alias("line")).where("line <> ''")


# --- reverse dictionaries, rules, word lists ------------------------------------------------


def reverse_rows(df: DataFrame) -> DataFrame:
    """(word, roman, kind, seq) of the multi-line reverse dictionary."""
    return df.select(cell(df, "漢字").alias("word"), cell(df, "羅馬字").alias("roman"), cell(df, "詞目類型").alias("kind"), _order().alias("seq")).where("word <> '' AND roman <> ''")


def vocabulary_rows(df: DataFrame) -> DataFrame:
    return df.select(cell(df, "詞目").alias("word"), cell(df, "音讀").alias("reading"), cell(df, "主編碼").alias("moe_id"), cell(df, "文白屬性").alias("wen_bai"), _order().alias("seq")).where("word <> '' AND reading <> ''")


def definitions(df: DataFrame) -> DataFrame:
    """(moe_id, definitions) in file order."""
    rows = df.select(cell(df, "主編碼").alias("moe_id"), cell(df, "釋義").alias("d"), _order().alias("seq")).where("moe_id <> '' AND d <> ''")
    listed = F.array_sort(F.collect_list(F.struct("seq", "d")))
    return rows.groupBy("moe_id").agg(F.transform(listed, lambda x: x["d"]).alias("definitions"))


def sniffed_separator(spark: SparkSession, path: str, head: int = 1024) -> str:
    """TAB if one occurs in the first characters, else comma. Only the first lines are read."""
    lines = spark.read.text(path).select(F.left("value", F.lit(head)).alias("value")).limit(head).collect()
    return "\t" if "\t" in "\n".join(r.value for r in lines)[:head] else ","


def writing_rules(df: DataFrame) -> DataFrame:
    """(word, type, kip, hoabun, seq): whether a word is written in Han or Latin letters."""
    word = cell(df, "建議用字")
    kip = either(cell(df, "數字版音讀"), cell(df, "音讀"))
    return df.select(word.alias("word"), T.rule_type(word).alias("type"), kip.alias("kip"), cell(df, "對應華語").alias("hoabun"), _order().alias("seq")).where("word <> ''")


def light_tone_rules(df: DataFrame) -> DataFrame:
    """(tl, hanzi, rule, seq)."""
    return df.select(cell(df, "臺羅").alias("tl"), cell(df, "漢字").alias("hanzi"), cell(df, "分連不處理").alias("rule"), _order().alias("seq")).where("tl <> ''")


def light_tone_rules_json(spark: SparkSession, path: str) -> DataFrame:
    """(tl, hanzi, rule, seq) of a JSON array of rules.

    The parts of a folder that was written in order (part-00000 and so on) are one array with whole rules in a line: they are read by lines, as no part is an array by itself, and a line that holds something else raises an error. Other files are read whole.
    """
    fields = "tl string, hanzi string, rule string"
    part = F.startswith(F.col("_metadata.file_name"), F.lit("part-"))
    file = F.col("_metadata.file_path").alias("file")
    whole = spark.read.schema(fields).option("multiLine", True).json(path).where(~part).select("tl", "hanzi", "rule", F.struct(file, F.monotonically_increasing_id().alias("line_no")).alias("seq"))
    inside = F.regexp_replace("value", r"^[\s,\[]+|[\s,\]]+$", "")
    lines = numbered_lines(spark, path).where(F.regexp_like("file", F.lit(r"/part-[^/]*$"))).select(inside.alias("inside"), F.struct("file", "line_no").alias("seq")).where("inside <> ''")
    found = F.from_json(F.concat(F.lit("["), "inside", F.lit("]")), f"array<struct<{fields.replace(' string', ': string')}>>", {"mode": "FAILFAST"})
    return whole.unionByName(lines.select(F.explode(found).alias("r"), "seq").select("r.*", "seq"))


def _unquoted(c: Column) -> Column:
    return F.regexp_replace(c, r"""^(['"])(.*)\1$""", "$2")


def writing_rules_yaml(spark: SparkSession, path: str) -> DataFrame:
    """(word, type, kip, hoabun, seq) from blocks of a word and its indented fields; comments and blank lines are skipped, of repeated fields and words the last holds."""
    lines = numbered_lines(spark, path).where(r"NOT value RLIKE '^\\s*(#|$)'")
    head, field = F.regexp_extract("value", r"^([^\s].*?):$", 1), r"^\s+(\w+):\s*(.*)$"
    block = F.max(F.when(head != "", F.col("line_no"))).over(Window.partitionBy("file").orderBy("line_no"))
    rows = lines.select("file", "line_no", head.alias("head"), F.regexp_extract("value", field, 1).alias("key"), F.regexp_extract("value", field, 2).alias("text"), block.alias("block")).where("block IS NOT NULL")
    of = lambda k: F.coalesce(F.max_by("text", F.when(F.col("key") == k, F.col("line_no"))), F.lit(""))
    fields = rows.groupBy("file", "block").agg(F.max_by("head", F.when(F.col("head") != "", F.col("line_no"))).alias("word"), *(_unquoted(of(k)).alias(k) for k in ("type", "kip", "hoabun")))
    fields = fields.withColumns({"word": _unquoted(F.col("word")), "seq": F.struct("file", F.col("block").alias("line_no"))})
    return fields.groupBy("word").agg(F.max_by(F.struct("type", "kip", "hoabun", "seq"), "seq").alias("r")).select("word", "r.*")


def word_list_yaml(spark: SparkSession, path: str) -> DataFrame:
    """(word, n_chars) of a list with a word a line."""
    words = spark.read.text(path).select(_unquoted(F.regexp_extract("value", r"^-\s*(.+)$", 1)).alias("word"))
    return words.where("word <> ''").distinct().withColumn("n_chars", F.length("word"))


def word_list(df: DataFrame) -> DataFrame:
    """(word, n_chars) of recommended words."""
    return df.select(cell(df, "建議用字").alias("word")).where("word <> ''").distinct().withColumn("n_chars", F.length("word"))


# --- frequency tables and lexicon files -----------------------------------------------------


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, value): lines with their number from 0 in their file.

    Files are read by ranges of bytes; lines are numbered within each range, and ranges are shifted by the lines of those before them.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), "value")
    sizes = rows.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    # numbers rise by one within a task, and a range lies in one task
    return rows.join(shifts, ["file", "_block"]).select("file", (F.col("_shift") + F.col("_id") - F.col("_first")).alias("line_no"), "value")


def frequencies(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(word, cnt) summed over files; bad counts are skipped, and within a file the last row of a word holds."""
    rows = numbered_lines(spark, path).withColumn("f", F.split("value", "\t", -1)).where("size(f) >= 2")
    rows = rows.select("file", "line_no", F.trim(F.get("f", F.lit(0))).alias("word"), F.expr("try_cast(trim(f[1]) AS bigint)").alias("cnt")).where("word <> '' AND cnt IS NOT NULL")
    last = rows.groupBy("file", "word").agg(F.max_by("cnt", "line_no").alias("cnt"))
    return last.groupBy("word").agg(F.sum("cnt").alias("cnt"))


def lexicon(spark: SparkSession, path: str, bad_weight: int | None = 0) -> DataFrame:
    """(hanlo, rime_key, weight, seq) behind a file's header, which ends with a line of three dots. A weight that is no number counts as bad_weight; None drops its row.

    The parts of a folder that was written in order (part-00000 and so on) are one file: what follows the first part needs no header.
    """
    whole = F.regexp_replace("file", r"/part-\d[^/]*$", "")
    lines = numbered_lines(spark, path).withColumn("_whole", whole)
    head = lines.where("trim(value) = '...'").groupBy("_whole").agg(F.min(F.struct("file", "line_no")).alias("_head"))
    rows = lines.join(head, "_whole").where((F.struct("file", "line_no") > F.col("_head")) & ~F.startswith("value", F.lit("#"))).withColumn("f", F.split("value", "\t", -1)).where("size(f) >= 3")
    weight = F.coalesce(F.expr("try_cast(trim(f[2]) AS int)"), F.lit(bad_weight).cast("int"))
    return rows.select(F.get("f", F.lit(0)).alias("hanlo"), F.get("f", F.lit(1)).alias("rime_key"), weight.alias("weight"), F.struct("file", "line_no").alias("seq")).where("weight IS NOT NULL")


def gloss_map(spark: SparkSession, path: str) -> DataFrame:
    """(mandarin, kip) of a TAB-separated map."""
    rows = spark.read.text(path).withColumn("f", F.split("value", "\t", -1)).where("size(f) >= 2")
    return rows.select(F.get("f", F.lit(0)).alias("mandarin"), F.get("f", F.lit(1)).alias("kip"))


def latest(spark: SparkSession, folder: str, wanted: str) -> str | None:
    """The file of that name in the newest snapshot folder (by name) that holds one."""
    return max(found(spark, folder, wanted), key=lambda x: x.split("/")[-2], default=None)


def first_present(spark: SparkSession, *paths: str) -> str | None:
    return next((x for x in paths if found(spark, x)), None)

