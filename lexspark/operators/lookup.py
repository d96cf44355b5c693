"""Look-ups of many inputs at once: exact, toneless, fuzzy, prefix, wildcard, reverse and longest-suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions import text as T

# Initials (the first is empty) and finals of syllables, in the order in which a wildcard is spelled out.
INITIALS = ("", "p", "ph", "b", "m", "t", "th", "n", "l", "k", "kh", "g", "ng", "ts", "tsh", "s", "j", "h")
FINALS = (
    "a", "e", "i", "o", "oo", "u", "ah", "eh", "ih", "oh", "ooh", "uh", "ak", "ek", "ik", "ok", "ap", "ip", "op", "at", "it", "ut", "am", "im", "om",
    "an", "in", "un", "ang", "eng", "ing", "ong", "ai", "aih", "au", "auh", "ia", "iah", "iak", "iam", "ian", "iang", "iap", "iat", "iau", "iauh", "io",
    "ioh", "iok", "iong", "iu", "iuh", "ua", "uah", "uai", "uaih", "uak", "uan", "uang", "uat", "ue", "ueh", "ui", "uih", "ann", "enn", "inn", "onn",
    "ainn", "aunn", "iann", "ionn", "iunn", "iaunn", "uann", "uainn", "uinn", "ainnh", "annh", "aunnh", "ennh", "innh", "onnh", "unnh", "iannh",
    "iaunnh", "iunnh", "uainnh", "uinnh", "er", "erh", "ere", "ir", "irh", "irn", "ioo", "m", "mh", "ng", "ngh", "nng",
)
# Texts and comments of the help, the abbreviations and the symbols, in order.
HELP = (
    ("漢羅/全羅", "F4切換 漢羅↔全羅模式"),
    ("TL/POJ", "F4切換 TL↔POJ 羅馬字系統"),
    ("\\", "切換輸出：漢羅↔全羅（當前候選）"),
    ("[  ]", "以詞定字：[ 首字、] 尾字"),
    ("'", "同音選字：輸入後按 ' 查同音字"),
    ("~", "注音反查→台語（選字後送回台語輸入）"),
    ("`", "符號選單（調號/方音/標點）"),
    ("?", "萬用查字（?iah → 選音節 → 選字）"),
    (";", "造詞模式（;拼音 → 查字典選字）"),
    ("vvh", "本說明"),
    ("vvjit", "台語日期時間"),
    ("vvsp", "簡拼提示表"),
)
_NAMES = ("波 (p)", "頗 (ph)", "門 (b)", "毛 (m)", "地 (t)", "他 (th)", "耐 (n)", "柳 (l)", "求 (k)", "去 (kh)", "語 (g)", "雅 (ng)", "曾 (ts/ch)", "出 (tsh/chh)", "時 (s)", "入 (j/l)", "喜 (h)")
ABBREVIATIONS = (
    *((f"{i}-", f"{i:<3} → {n}") for i, n in zip(INITIALS[1:], _NAMES, strict=True)),
    ("---", "─" * 14),
    ("用法", "聲母 + Enter = 快速選字"),
    ("例", "ts → 曾/做/走/... (所有 ts- 開頭字)"),
    ("提示", "schema algebra 已設定 abbrev 規則"),
)
SYMBOLS = (
    ("á", "第二聲 (TL)"),
    ("à", "第三聲 (TL)"),
    ("â", "第五聲 (TL)"),
    ("ā", "第七聲 (TL)"),
    ("a̍", "第八聲 (TL)"),
    ("o͘", "POJ oo (o͘)"),
    ("ⁿ", "鼻化上標 (ⁿ)"),
    ("ㆠ", "方音 b"),
    ("ㆣ", "方音 g"),
    ("ㄫ", "方音 ng"),
    ("ㆢ", "方音 j"),
    ("ㆦ", "方音 oo"),
    ("ㆤ", "方音 ee"),
    ("ㆰ", "方音 am"),
    ("ㆱ", "方音 om"),
    ("ㆲ", "方音 ong"),
    ("ㆬ", "方音 m (韻母)"),
    ("ㆭ", "方音 ng (韻母)"),
    ("--", "輕聲連字號 (--)"),
    ("、", "頓號"),
    ("。", "句號"),
)
#: Entries that a predictive look-up gives at most.
LIMIT = 100


def route(c: Column) -> Column:
    """What kind of look-up an input asks for."""
    return (
        F.when(c.isin("vvh", "vvjit", "vvsp"), F.lit("command"))
        .when(c.rlike(r"^[a-z]*\?[a-z0-9]*$"), F.lit("wildcard"))
        .when(c.rlike("^;[a-z0-9]*$"), F.lit("phrase"))
        .when(F.startswith(c, F.lit("~")), F.lit("reverse"))
        .when(F.startswith(c, F.lit("`")), F.lit("symbol"))
        .otherwise(F.lit("plain"))
    )


#: Parts in which the entries of one input are ranked first.
PARTS = 16


def _top(df: DataFrame, k: int) -> DataFrame:
    """The k weightiest entries of each input. They are first ranked in PARTS parts of which k stay each, so a one-letter input that meets much of the lexicon is no single task."""
    order = (F.desc("weight"), "rime_key", "hanlo")
    part = F.pmod(F.xxhash64("hanlo", "rime_key"), F.lit(PARTS))
    few = df.withColumn("_part", part).withColumn("_at", F.row_number().over(Window.partitionBy("query_id", "_part").orderBy(*order))).where(F.col("_at") <= k).drop("_part", "_at")
    return few.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("pos") <= k)


def exact(queries: DataFrame, lexicon: DataFrame, k: int = LIMIT) -> DataFrame:
    """(query_id, input) against codes."""
    return _top(queries.join(lexicon, queries["input"] == lexicon["rime_key"]), k)


def spellings(lexicon: DataFrame) -> DataFrame:
    """(spelling, hanlo, rime_key, weight): every spelling that the rules derive for one-syllable codes, and toneless forms of longer ones. Written once, it turns fuzzy look-up into an equi-join."""
    one = ~F.contains("rime_key", F.lit(" "))
    many = F.array_distinct(F.array(F.col("rime_key"), T.strip_final_tones(F.replace("rime_key", F.lit(" "), F.lit("-")), " ")))
    forms = F.when(one, T.spelling_variants(F.col("rime_key"))).otherwise(many)
    return lexicon.select("hanlo", "rime_key", "weight", F.explode(forms).alias("spelling"))


def fuzzy(queries: DataFrame, spelled: DataFrame, k: int = LIMIT) -> DataFrame:
    return _top(queries.join(spelled, queries["input"] == spelled["spelling"]), k)


def prefix(queries: DataFrame, lexicon: DataFrame, k: int = LIMIT, head: int = 2) -> DataFrame:
    """Entries whose code begins with the input, weightiest first.

    The join runs on the first `head` characters, so it stays an equi-join; shorter inputs meet codes by their own first characters.
    """
    parts = []
    for n in range(1, head + 1):
        q = queries.where(F.length("input") == n if n < head else F.length("input") >= n).withColumn("_h", F.left("input", F.lit(n)))
        parts.append(q.join(lexicon.withColumn("_h", F.left("rime_key", F.lit(n))), "_h").where(F.startswith("rime_key", F.col("input"))).drop("_h"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _top(out, k)


def phrase(queries: DataFrame, lexicon: DataFrame) -> DataFrame:
    """One-syllable texts for `;code` inputs, each once; an input without any gives one row that says so (null hanlo)."""
    asked = queries.where(route(F.col("input")) == "phrase").select("query_id", F.substring("input", F.lit(2), F.length("input")).alias("input"))
    found = prefix(asked.where("input <> ''"), lexicon.where(~F.contains("rime_key", F.lit(" "))))
    first = found.groupBy("query_id", "hanlo").agg(F.min("pos").alias("pos"), F.min_by("rime_key", "pos").alias("rime_key"))
    return asked.join(first, "query_id", "left")


def syllables(spark: SparkSession) -> DataFrame:
    """(initial, final, seq): the static inventory."""
    rows = [(a, b, i * len(FINALS) + j) for i, a in enumerate(INITIALS) for j, b in enumerate(FINALS)]
    return spark.createDataFrame(rows, "initial string, final string, seq int")


def wildcard_codes(queries: DataFrame) -> DataFrame:
    """(query_id, code, seq): what a `?` may stand for.

    At the start it stands for an initial, and what follows is kept. Elsewhere a syllable's initial is the longest that the letters before `?` begin with; its final begins with the letters left over and ends with those after, and a tone digit stays. The inventory is fixed (18 by 101), so it is broadcast.
    """
    asked = queries.where(route(F.col("input")) == "wildcard").select("query_id", F.split("input", r"\?").alias("p"))
    asked = asked.select("query_id", F.element_at("p", 1).alias("before"), F.regexp_replace(F.element_at("p", 2), "[0-9]+$", "").alias("after"), F.regexp_extract(F.element_at("p", 2), "([0-9]*)$", 1).alias("tone"), F.element_at("p", 2).alias("rest"))
    spark = queries.sparkSession
    first = spark.createDataFrame([(a, i) for i, a in enumerate(INITIALS)], "initial string, seq int")
    at_start = asked.where("before = ''").join(F.broadcast(first)).select("query_id", F.concat("initial", "rest").alias("code"), "seq")
    inventory = F.broadcast(syllables(spark))
    inner = asked.where("before <> ''").join(inventory, F.startswith(F.col("before"), F.col("initial")))
    left = F.substring("before", F.length("initial") + 1, F.length("before"))
    inner = inner.where(F.startswith("final", left) & F.endswith("final", F.col("after")))
    inner = inner.select("query_id", F.concat("initial", "final", "tone").alias("code"), "seq")
    return at_start.unionByName(inner).where("code <> ''").groupBy("query_id", "code").agg(F.min("seq").alias("seq"))


def wildcard(queries: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(query_id, code, seq, n): codes of a wildcard with how many one-syllable texts begin so (of the first LIMIT entries); codes without any are left out."""
    codes = wildcard_codes(queries)
    ids = codes.select("code").distinct()
    found = prefix(ids.select(F.col("code").alias("query_id"), F.col("code").alias("input")), lexicon).where(~F.contains("rime_key", F.lit(" ")))
    counts = found.groupBy(F.col("query_id").alias("code")).agg(F.count_distinct("hanlo").alias("n"))
    return codes.join(counts, "code").select("query_id", "code", "seq", "n")


def codes_of(texts: DataFrame, reverse: DataFrame, glosses: DataFrame) -> DataFrame:
    """texts (with `text`) with `code`: of the reverse lexicon, else of the gloss map, else null."""
    first = reverse.groupBy(F.col("hanlo").alias("text")).agg(F.min_by("rime_key", F.struct(-F.col("weight"), F.col("seq"))).alias("_a"))
    return texts.join(first, "text", "left").join(glosses.select(F.col("mandarin").alias("text"), F.col("kip").alias("_b")), "text", "left").withColumn("code", F.coalesce("_a", "_b")).drop("_a", "_b")


def homophones(texts: DataFrame, reverse: DataFrame, glosses: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Other texts with the code of a text."""
    coded = codes_of(texts, reverse, glosses).where("code IS NOT NULL")
    same = lexicon.select(F.col("rime_key").alias("code"), "hanlo", "weight")
    return coded.join(same, "code").where("hanlo <> text")


def longest_suffix(codes: DataFrame, rules: DataFrame, longest: int = 3) -> DataFrame:
    """codes (with `id`, `syllables`) joined with all rules (`tail`, toneless, hyphenated) of the longest matching tail; one syllable at least stays before it.

    Each code meets one row per tail length, so the join is on equal tails, and the longest is picked by an aggregate.
    """
    n = F.size("syllables")
    bare = F.transform("syllables", lambda s: F.lower(T.strip_tones_before_breaks(s)))
    tails = codes.where(n >= 2).select("id", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), n - 1))).alias("n"), bare.alias("_b"))
    tails = tails.select("id", "n", F.array_join(F.slice("_b", F.size("_b") - F.col("n") + 1, F.col("n")), "-").alias("tail"))
    met = tails.join(rules, "tail")
    best = met.groupBy("id").agg(F.max("n").alias("n"))
    return met.join(best, ["id", "n"])


def toneless_rules(rules: DataFrame, fixed: bool = False) -> DataFrame:
    """(tail, hanzi, rule, seq) for suffix matching, without rules of the kind that asks for no change.

    As written, only combining marks are dropped, so rules with composed letters never match; `fixed` drops those marks too.
    """
    tl = F.lower("tl")
    tail = T.strip_marks(T.decomposed(tl) if fixed else tl)
    return rules.where("rule <> '不處理'").select(tail.alias("tail"), "hanzi", "rule", "seq")


def static_rows(queries: DataFrame) -> DataFrame:
    """(query_id, seq, text, comment): help for `vvh`, abbreviations for `vvsp`, symbols for inputs that start with a backtick."""
    rows = [(k, i, *row) for k, table in (("vvh", HELP), ("vvsp", ABBREVIATIONS), ("`", SYMBOLS)) for i, row in enumerate(table)]
    fixed = queries.sparkSession.createDataFrame(rows, "_key string, seq int, text string, comment string")
    key = F.when(F.startswith("input", F.lit("`")), F.lit("`")).otherwise(F.col("input"))
    return queries.select("query_id", key.alias("_key")).join(F.broadcast(fixed), "_key").drop("_key")  # some fifty fixed rows


def dates(queries: DataFrame, day: Column) -> DataFrame:
    """(query_id, text, seq): the date in Han, with a romanised weekday, and in ISO form, for the date command."""
    forms = F.array(T.date_han(day), T.weekday_roman(day), F.date_format(day, "yyyy-MM-dd"))
    return queries.where("input = 'vvjit'").select("query_id", F.posexplode(forms).alias("seq", "text"))
