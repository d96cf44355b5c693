"""Filters over ordered candidates: (query_id, pos, text, comment, quality). Each keeps or gives back `pos`, the place in the list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import text as T

from .contains import WordList
from .lookup import longest_suffix

#: Options -> mode: full romanisation adds 2, the other spelling adds 1.
MODES = {(False, False): 0, (False, True): 1, (True, False): 2, (True, True): 3}


def repositioned(df: DataFrame, *order) -> DataFrame:
    """pos anew from 1 in the given order; other columns of the order are dropped by the caller."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def unique(df: DataFrame) -> DataFrame:
    """The first candidate of each text."""
    rest = [c for c in df.columns if c not in ("query_id", "text")]
    return df.groupBy("query_id", "text").agg(F.min_by(F.struct(*rest), "pos").alias("_r")).select("query_id", "text", "_r.*").select(df.columns)


def merged(*lists: DataFrame) -> DataFrame:
    """Candidates of several translators, those of the first before those of the second."""
    out = None
    for i, df in enumerate(lists):
        part = df.withColumn("_t", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return repositioned(out, "_t", "pos").drop("_t")


def with_light_tones(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Each candidate, then one variant per rule of the longest tail of its romanisation: the text's front, two hyphens and the rule's text, 0.3 less in quality. Texts of variants differ.

    rules: (tail, hanzi, seq) of toneless_rules.
    """
    words = F.filter(F.split(T.bracketed(F.col("comment")), r"\s+"), lambda x: x != "")
    rows = df.withColumns({"_id": F.struct("query_id", "pos"), "_s": words})
    met = longest_suffix(rows.select(F.col("_id").alias("id"), F.col("_s").alias("syllables")), rules.select("tail", "hanzi", F.col("seq").alias("_seq")))
    made = rows.join(met.select(F.col("id").alias("_id"), "n", "hanzi", "_seq"), "_id").withColumn("_before", F.size("_s") - F.col("n"))
    made = made.where((F.col("_before") < F.length("text")) & (F.col("_before") > 0))
    variant = F.concat(F.left("text", F.col("_before")), F.lit("--"), F.col("hanzi"))
    comment = F.concat(F.lit(" ["), T.marked_key(F.col("_s"), F.col("n")), F.lit("]"))
    rest = [c for c in df.columns if c not in ("text", "comment", "quality")]
    made = made.select(*rest, variant.alias("text"), comment.alias("comment"), (F.col("quality") - 0.3).alias("quality"), "_seq")
    made = made.groupBy(*rest, "text", "comment", "quality").agg(F.min("_seq").alias("_seq"))
    both = df.withColumn("_seq", F.lit(None).cast(dict(made.dtypes)["_seq"])).unionByName(made.select(*df.columns, "_seq"))
    return repositioned(both, "pos", F.col("_seq").asc_nulls_first(), "text").drop("_seq")


def _synced(text: Column, roman: Column) -> Column:
    """The romanisation with the text's light-tone mark, where only the text has one."""
    before = F.length(F.regexp_extract(text, r"(?s)^(.*?)--", 1))
    words = F.filter(F.split(roman, r"\s+"), lambda x: x != "")
    need = (roman != "") & F.contains(text, F.lit("--")) & ~F.contains(roman, F.lit("--")) & (before > 0) & (before < F.size(words))
    put = F.concat(F.array_join(F.slice(words, 1, before), " "), F.lit("--"), F.array_join(F.slice(words, before + 1, F.size(words)), " "))
    return F.when(need, put).otherwise(roman)


def _rewritten(text: Column, roman: Column, lo: Column) -> tuple[Column, Column]:
    """The text with words of kind "lo" as marked romanisation, and whether any was. lo: array of those of its segments that are such words (rule_hits).

    The whole text first; else group by group between light-tone marks, a group as a whole or character by character where it has as many characters as syllables.
    """

    def group(t: Column, r: Column) -> Column:
        words, chars = F.filter(F.split(r, r"\s+"), lambda x: x != ""), T.characters(t)
        each = F.array_join(F.zip_with(chars, words, lambda c, w: F.when(F.array_contains(lo, c), T.marked(w)).otherwise(c)), "")
        return F.when(F.array_contains(lo, t), T.marked(r)).when((F.size(chars) == F.size(words)) & F.exists(chars, lambda c: F.array_contains(lo, c)), each).otherwise(t)

    whole = F.array_contains(lo, F.replace(text, F.lit("--"), F.lit("")))
    ts, rs = F.split(text, "--", -1), F.split(roman, "--", -1)
    parts = F.array_join(F.zip_with(ts, rs, group), "--")
    out = F.when(roman == "", text).when(whole, T.marked(roman)).when(F.size(ts) == F.size(rs), parts).otherwise(text)
    return out, (roman != "") & (whole | ((F.size(ts) == F.size(rs)) & (parts != text)))


def lo_words_of(rules: DataFrame) -> DataFrame:
    """(word): what (word, type) rules write in Latin letters."""
    return rules.where("type = 'lo'").select("word")


def rule_hits(texts: DataFrame, lo_words: DataFrame) -> DataFrame:
    """(text, _lo): of each text, those of its segments that are words of the list: the whole without light-tone marks, the groups between them, and single characters.

    The segments of distinct texts meet the words by equality, so the cost doesn't grow with the number of rules; a short list is broadcast by Spark's own measure of its size, a long one shuffled.
    """
    bare = F.replace("text", F.lit("--"), F.lit(""))
    segments = F.array_distinct(F.concat(F.array(bare), F.split("text", "--", -1), T.characters(bare)))
    rows = texts.select("text").distinct().select("text", F.explode(segments).alias("word")).where("word <> ''")
    return rows.join(lo_words.select("word").distinct(), "word").groupBy("text").agg(F.collect_set("word").alias("_lo"))


def rewritten(df: DataFrame, lo_words: list[str] | DataFrame, mode: int = 0) -> DataFrame:
    """The core filter: texts in Han or Latin by rule, comments with marked romanisation, quality raised for romanised and long texts. Order stays.

    Modes 0 and 1 (other spelling) raise by the text's length; 2 and 3 by its syllables. lo_words: the words that rules write in Latin letters, as a list or a table of (word).
    """
    if isinstance(lo_words, list):
        lo_words = df.sparkSession.createDataFrame([(w,) for w in lo_words], "word string")
    df = df.join(rule_hits(df, lo_words), "text", "left").withColumn("_lo", F.coalesce("_lo", F.array().cast("array<string>"))).select(*df.columns, "_lo")
    raw = _synced(F.col("text"), T.bracketed(F.coalesce("comment", F.lit(""))))
    df = df.withColumn("_raw", raw)
    text, has = _rewritten(F.col("text"), F.col("_raw"), F.col("_lo"))
    df = df.withColumns({"_text": text, "_has": has})
    poj = mode in (1, 3)
    shown = F.when(F.col("_has"), T.poj_marks(T.tl_to_poj(F.col("_text")))).otherwise(F.col("_text")) if poj else F.col("_text")
    roman = T.poj_marks(T.marked(T.tl_to_poj(F.col("_raw")))) if poj else T.marked(F.col("_raw"))
    if mode >= 2:
        n = F.size(F.filter(F.split("_raw", r"[\s\-]+"), lambda x: x != ""))
        boost = F.when(F.col("_raw") == "", F.lit(0.0)).when(n >= 3, F.lit(1.0)).when(n >= 2, F.lit(0.5)).otherwise(F.lit(0.0))
    else:
        n = F.length(F.replace(shown, F.lit("--"), F.lit("")))
        boost = F.when(F.col("_has"), F.lit(5.0)).otherwise(F.lit(0.0)) + F.when(n >= 4, F.lit(1.0)).when(n >= 2, F.lit(0.5)).otherwise(F.lit(0.0))
    comment = F.when(F.col("_raw") == "", F.col("comment")).otherwise(F.concat(F.lit(" ["), roman, F.lit("]")))
    return df.withColumns({"text": F.when(F.col("_raw") == "", F.col("text")).otherwise(shown), "comment": comment, "quality": F.col("quality") + boost}).drop("_raw", "_text", "_has", "_lo")


def with_both_spellings(df: DataFrame) -> DataFrame:
    """Comments with both spellings where they differ."""
    inner = T.bracketed(F.col("comment"))
    return df.withColumn("comment", F.when(inner == "", F.col("comment")).otherwise(F.concat(F.lit(" "), T.both_spellings(inner))))


def recommended(df: DataFrame, words: DataFrame, enabled: bool = True) -> DataFrame:
    """Marks before the bracket of comments: a diamond if the text holds a recommended Han word, a star for a Latin one.

    words: (word, type), type han or lo. Each text goes once through an automaton of all words.
    """
    if not enabled:
        return df
    tags = WordList(words, "word", "type").tags(F.col("text"))
    rows = df.withColumn("_tags", tags).withColumns({"_han": F.array_contains("_tags", "han"), "_lo": F.array_contains("_tags", "lo")})
    mark = F.concat(F.when(F.col("_han"), F.lit("◆")).otherwise(F.lit("")), F.when(F.col("_lo"), F.lit("★")).otherwise(F.lit("")), F.lit(" "))
    at = F.instr(F.col("comment"), "[")
    comment = F.concat(F.left("comment", at - 1), mark, F.substring("comment", at, F.length("comment")))
    marked = (F.col("_han") | F.col("_lo")) & (at > 0)
    return rows.withColumn("comment", F.when(marked, comment).otherwise(F.col("comment"))).select(df.columns)


def synonyms(df: DataFrame) -> DataFrame:
    """Identity; a place in the chain."""
    return df


def long_words_first(df: DataFrame, count: int = 2, idx: int = 4, buffer: int = 50) -> DataFrame:
    """From place idx on, the first `count` candidates that are longer than the first one and not in ASCII alone jump ahead of the others, unless more than `buffer` others came before."""
    w = Window.partitionBy("query_id").orderBy("pos")
    length = F.length("text")
    first = F.first(F.when(length > 0, length), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    eligible = (F.row_number().over(w) >= idx) & (length > first) & ~F.col("text").rlike(r"^[\p{Alpha}\p{Digit}\p{Punct}\s]+$")
    df = df.withColumns({"_n": F.row_number().over(w), "_e": eligible})
    so_far = F.sum(F.col("_e").cast("int")).over(w)
    others = F.sum(((F.col("_n") >= idx) & ~F.col("_e")).cast("int")).over(w)
    df = df.withColumns({"_so": so_far, "_others": others})
    bucket = F.when(F.col("_n") < idx, 0).when(F.col("_e") & (F.col("_so") <= count) & (F.col("_others") <= buffer), 1).otherwise(2)
    return repositioned(df.withColumn("_b", bucket), "_b", "_n").drop("_n", "_e", "_so", "_others", "_b")


def formatted_readings(df: DataFrame, poj: bool = False) -> DataFrame:
    return df.withColumn("comment", T.readings(F.col("comment"), poj))


def paged(df: DataFrame, size: int = 10, keys: str = "asdfghjkl;") -> DataFrame:
    """Page, place on it and select key of each candidate."""
    at = (F.col("pos") - 1) % size
    return df.withColumns({"page": F.floor((F.col("pos") - 1) / size).cast("int"), "on_page": at.cast("int"), "key": F.substring(F.lit(keys), at.cast("int") + 1, F.lit(1))})


def chain(df: DataFrame, rules: DataFrame, lo_words: list[str] | DataFrame, words: DataFrame, mode: int = 0) -> DataFrame:
    """All filters in order: light tones, rewriting, both spellings, recommendations, synonyms, long words, readings, unique texts."""
    out = with_light_tones(df, rules)
    out = with_both_spellings(rewritten(out, lo_words, mode))
    out = synonyms(recommended(out, words))
    return unique(formatted_readings(long_words_first(out), mode in (1, 3)))
