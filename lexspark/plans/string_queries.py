"""Queries of the text functions over fixed rows and the driver's strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.functions import text as T

from .corpus_queries import table
from .registry import register

#: Invented syllables in ASCII, numbered.
CODES = ("sian7-neh", "tua7-lang5", "tsit8", "a-ba3", "tshing5", "kua2-kue1", "to3-tng2--lai5", "ik4-ing", "oo7-siong", "Tai5-uan", "sann1-ui7", "ji7-hit4", "phah4--khi3", "nng7")
_FIXED = ", ".join(f"('{c}')" for c in CODES)
#: Codes made of the parts' names and sizes, beside the invented ones.
_ROWS = f"(SELECT DISTINCT code FROM (SELECT replace(p_name, ' ', '-') AS code FROM part UNION ALL SELECT replace(p_name, ' ', '--') || (p_size % 9 + 1) FROM part UNION ALL SELECT replace(p_name, ' ', (p_size % 9 + 1)::VARCHAR || '-') || (p_size % 7 + 1) FROM part UNION ALL SELECT * FROM (VALUES {_FIXED}))) v"


def _codes(spark, sf_dir):
    name, n = F.col("p_name"), F.col("p_size")
    digit = lambda k: (n % k + 1).cast("string")
    forms = F.array(F.replace(name, F.lit(" "), F.lit("-")), F.concat(F.replace(name, F.lit(" "), F.lit("--")), digit(9)), F.concat(F.replace(name, F.lit(" "), F.concat(digit(9), F.lit("-"))), digit(7)))
    rows = table(spark, sf_dir, "part").select(F.explode(forms).alias("code"))
    return rows.unionByName(spark.createDataFrame([(c,) for c in CODES], "code string")).distinct()


def _each(expression: str, separator: str = "-") -> str:
    return f"array_to_string(list_transform(string_split(code, '{separator}'), lambda s: {expression}), '{separator}')"


@register("implicit_tone", "SELECT code, " + _each("CASE WHEN regexp_matches(s, '^[a-z]+$') THEN s || CASE WHEN regexp_matches(s, '[ptkh]$') THEN '4' ELSE '1' END ELSE s END") + f" AS toned FROM {_ROWS}")
def implicit_tone(spark, sf_dir):
    return _codes(spark, sf_dir).withColumn("toned", T.implicit_tone(F.col("code")))


@register(
    "tone_fold",
    "SELECT code, " + _each("regexp_replace(s, '[1-9]$', '')") + f" AS last_only, regexp_replace(code, '[1-9]', '', 'g') AS all_digits, replace(replace(replace(code, '--', chr(1)), '-', ' '), chr(1), '  ') AS rime_key, CASE WHEN code = '' THEN 0 ELSE len(string_split(code, '-')) END::INTEGER AS syllables FROM {_ROWS}",
)
def tone_fold(spark, sf_dir):
    c = F.col("code")
    return _codes(spark, sf_dir).select("code", T.strip_final_tones(c).alias("last_only"), T.strip_all_tones(c).alias("all_digits"), T.code_to_key(c).alias("rime_key"), T.syllable_count(c).alias("syllables"))


def _chain(start: str, *rules: tuple[str, str]) -> str:
    for pattern, to in rules:
        start = f"regexp_replace({start}, '{pattern}', '{to}', 'g')"
    return start


@register(
    "tl_poj",
    "SELECT code, "
    + _chain("code", ("tsh", "chh"), ("ts", "ch"), ("ing([^a-zA-Z0-9_]|$)", r"eng\1"), ("ik([^a-zA-Z0-9_]|$)", r"ek\1"), ("ua", "oa"), ("ue", "oe"))
    + " AS by_words, "
    + "replace(replace("
    + _chain("code", ("tsh", "chh"), ("ts", "ch"), ("ing([^a-z])", r"eng\1"), ("ing$", "eng"), ("ik([^a-z])", r"ek\1"), ("ik$", "ek"), ("nn([^g])", r"ⁿ\1"), ("nn$", "ⁿ"), ("oo", "o' || chr(856) || '"))
    + f", 'ua', 'oa'), 'ue', 'oe') AS shown FROM {_ROWS}",
)
def tl_poj(spark, sf_dir):
    return _codes(spark, sf_dir).select("code", T.tl_to_poj_words(F.col("code")).alias("by_words"), T.tl_to_poj(F.col("code")).alias("shown"))


@register(
    "poj_tl",
    "SELECT code, " + _chain("lower(replace(replace(code, 'tsh', 'chh'), 'ts', 'ch'))", ("ou", "oo"), ("chh", "tsh"), ("ch", "ts"), ("eng([^a-z0-9_]|$)", r"ing\1"), ("ek([^a-z0-9_]|$)", r"ik\1"), ("oa", "ua"), ("oe", "ue")) + f" AS tl FROM {_ROWS}",
)
def poj_tl(spark, sf_dir):
    poj = T.swap(F.col("code"), ("tsh", "chh"), ("ts", "ch"))
    return _codes(spark, sf_dir).select("code", T.poj_to_tl(poj).alias("tl"))


_MARK = "CASE right(code, 1) " + " ".join(f"WHEN '{d}' THEN chr({ord(m)})" for d, m in T.TONE_MARKS.items()) + " ELSE '' END"
_SYLLABLES = ("gua2", "ui7", "nng7", "ere5", "m7", "lau1", "iu2", "kooh8", "tsit8", "loo7", "be3", "bo5", "ng5", "hm9", "to", "ki4", "khi3", "pn7", "uan5", "sue2")


@register(
    "tone_marks",
    f"""WITH v AS (SELECT DISTINCT w || (p_size % 9 + 1) AS code FROM (SELECT unnest(string_split(p_name, ' ')) AS w, p_size FROM part) UNION SELECT * FROM (VALUES {', '.join(f"('{s}')" for s in _SYLLABLES)})),
b AS (SELECT code, regexp_matches(code, '[1-9]$') AS toned, CASE WHEN regexp_matches(code, '[1-9]$') THEN left(code, len(code) - 1) ELSE code END AS base, {_MARK} AS mark FROM v),
p AS (SELECT *, CASE WHEN instr(base,'oo') > 0 THEN instr(base,'oo') WHEN instr(base,'a') > 0 THEN instr(base,'a') WHEN instr(base,'ere') > 0 THEN instr(base,'ere') + 2 WHEN instr(base,'e') > 0 THEN instr(base,'e') WHEN instr(base,'o') > 0 THEN instr(base,'o')
WHEN instr(base,'i') > 0 OR instr(base,'u') > 0 THEN greatest(instr(base,'i'), instr(base,'u')) WHEN left(base,2) = 'nn' THEN 2 WHEN regexp_matches(base,'[mn]') THEN len(regexp_extract(base,'^([^mn]*)',1)) + 1 ELSE 0 END AS place FROM b)
SELECT code, CASE WHEN NOT toned OR mark = '' OR place = 0 THEN base ELSE left(base, place) || mark || substr(base, place + 1) END AS marked FROM p""",
)
def tone_marks(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w"), "p_size").select(F.concat("w", (F.col("p_size") % 9 + 1).cast("string")).alias("code"))
    rows = words.unionByName(spark.createDataFrame([(s,) for s in _SYLLABLES], "code string")).distinct()
    return rows.select("code", T.marked_syllable(F.col("code")).alias("marked"))


_VOWELS, _TAILS, _MARKS = ("oa", "oe", "ui", "iu"), ("", "-a", "ⁿ", "n"), (769, 768, 770, 772)


@register(
    "poj_mark_shift",
    f"WITH v AS (SELECT DISTINCT left(p_name, 1) || ({list(_VOWELS)})[p_size % 4 + 1] || chr(({list(_MARKS)})[p_partkey % 4 + 1]) || ({list(_TAILS)})[(p_size // 4) % 4 + 1] AS t FROM part) SELECT t, "
    + "regexp_replace(regexp_replace(regexp_replace(t, 'o([ae])([' || chr(768) || '-' || chr(831) || '])(-|ⁿ)', 'o\\2\\1\\3', 'g'), 'o([ae])([' || chr(768) || '-' || chr(831) || '])$', 'o\\2\\1'), 'ui([' || chr(768) || '-' || chr(831) || '])', 'u\\1i', 'g') AS shifted FROM v",
)
def poj_mark_shift(spark, sf_dir):
    """Syllables put together from the parts' names, vowels, marks and tails."""
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    size = F.col("p_size")
    t = F.concat(F.left("p_name", F.lit(1)), pick(_VOWELS, size % 4), pick([chr(m) for m in _MARKS], F.col("p_partkey") % 4), pick(_TAILS, F.floor(size / 4) % 4))
    return table(spark, sf_dir, "part").select(t.alias("t")).distinct().select("t", T.poj_marks(F.col("t")).alias("shifted"))


_HAN = ("食", "食飯", "ā好", "四字成語語", "三个字", "beh", "", "ê")
#: Capitals of the parts' types that stand for Han characters, a comma and a full stop; the others stay Latin.
_FROM, _TO = "ABDEILNORST ", "食飯好人大水火山口手日、"
_HAN_SQL = f"(SELECT DISTINCT translate(w, '{_FROM}', '{_TO}') AS t FROM (SELECT unnest([p_type, split_part(p_type, ' ', 1), right(p_type, 3), left(p_type, 1)]) AS w FROM part) UNION SELECT * FROM (VALUES {', '.join(f"('{h}')" for h in _HAN)}))"


def _han(spark, sf_dir):
    c = F.col("p_type")
    forms = F.array(c, F.element_at(F.split(c, " "), 1), F.right(c, F.lit(3)), F.left(c, F.lit(1)))
    rows = table(spark, sf_dir, "part").select(F.explode(forms).alias("t")).select(F.translate("t", _FROM, _TO).alias("t"))
    return rows.unionByName(spark.createDataFrame([(h,) for h in _HAN], "t string")).distinct()


@register(
    "cjk_length_modifier",
    f"""WITH v AS {_HAN_SQL}, n AS (SELECT t, len(regexp_extract_all(t, '\\p{{Lo}}')) AS n FROM v)
SELECT t, n::INTEGER AS n, CASE WHEN n = 0 THEN 1.0::DOUBLE WHEN n = 1 THEN 0.8::DOUBLE WHEN n <= 3 THEN 1.2::DOUBLE ELSE 0.6::DOUBLE END AS modifier FROM n""",
)
def cjk_length_modifier(spark, sf_dir):
    rows = _han(spark, sf_dir)
    return rows.select("t", T.han_count(F.col("t")).alias("n"), T.length_modifier(F.col("t")).alias("modifier"))


@register("hanlo_classify", f"""WITH v AS {_HAN_SQL} SELECT t, CASE WHEN regexp_matches(t, '\\p{{Lo}}') THEN 'han' ELSE 'lo' END AS kind FROM v""")
def hanlo_classify(spark, sf_dir):
    rows = _han(spark, sf_dir)
    return rows.select("t", T.rule_type(F.col("t")).alias("kind"))


_WEEK = ", ".join(f"'{d}'" for d in T.WEEKDAYS_HAN)
_ROMAN = ", ".join(f"'{d}'" for d in T.WEEKDAYS_ROMAN)


@register(
    "date_phrases",
    f"SELECT DISTINCT o_orderdate::DATE AS d, year(o_orderdate) || '年' || month(o_orderdate) || '月' || day(o_orderdate) || '日 ' || ([{_WEEK}])[dayofweek(o_orderdate) + 1] AS han, ([{_ROMAN}])[dayofweek(o_orderdate) + 1] AS roman, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders",
)
def date_phrases(spark, sf_dir):
    d = F.col("d")
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return days.select("d", T.date_han(d).alias("han"), T.weekday_roman(d).alias("roman"), F.date_format(d, "yyyy-MM-dd").alias("iso"))


def _variants() -> str:
    out = "WITH s0 AS (SELECT DISTINCT w AS word, w AS x FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part))"
    for i, (pattern, to) in enumerate(T.SPELLING_RULES):
        out += f", s{i + 1} AS (SELECT word, x FROM s{i} UNION SELECT word, regexp_replace(x, '{pattern}', '{to}', 'g') FROM s{i})"
    return out + f" SELECT word, x AS spelling FROM s{len(T.SPELLING_RULES)} WHERE x <> ''"


@register("spelling_variants", _variants())
def spelling_variants(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return words.select("word", F.explode(T.spelling_variants(F.col("word"))).alias("spelling"))


_GLOSSES = ("吃飯、用餐(文)", "我去。", "abc", "好", "很長很長的一句話,短", "甲,乙；丙")


@register(
    "gloss_split",
    f"""WITH v AS (SELECT t AS g FROM {_HAN_SQL} UNION SELECT * FROM (VALUES {', '.join(f"('{g}')" for g in _GLOSSES)})), b AS (SELECT g, trim(regexp_replace(g, '\\([^)]*\\)', '', 'g')) AS bare FROM v),
w AS (SELECT g, unnest(list_transform(regexp_split_to_array(bare, '[、，,;]'), lambda x: trim(x))) AS word FROM b WHERE NOT regexp_matches(bare, '[。！？；：]'))
SELECT g, word FROM w WHERE regexp_matches(word, '[一-鿿㐀-䶿]') AND len(word) <= 6""",
)
def gloss_split(spark, sf_dir):
    rows = _han(spark, sf_dir).withColumnRenamed("t", "g").unionByName(spark.createDataFrame([(g,) for g in _GLOSSES], "g string")).distinct()
    return rows.select("g", F.explode(T.gloss_words(F.col("g"))).alias("word"))


@register(
    "variant_explode",
    """WITH c AS (SELECT p_partkey, replace(p_name, ' ', '(替)/ ') || '//' || p_brand AS cell FROM part),
p AS (SELECT p_partkey, unnest(list_filter(list_transform(string_split(replace(cell, '(替)', ''), '/'), lambda x: trim(x)), lambda x: x <> '')) AS code FROM c) SELECT p_partkey, code, count(*) AS n FROM p GROUP BY ALL""",
)
def variant_explode(spark, sf_dir):
    cell = F.concat(F.replace("p_name", F.lit(" "), F.lit("(替)/ ")), F.lit("//"), "p_brand")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(T.code_variants(cell)).alias("code"))
    return rows.groupBy("p_partkey", "code").agg(F.count(F.lit(1)).alias("n"))


@register(
    "edge_characters",
    "SELECT p_partkey, left(p_name, 1) AS first_char, right(p_name, 1) AS last_char, CASE WHEN regexp_matches(p_name, '^[a-z]') THEN upper(left(p_name, 1)) || substr(p_name, 2) ELSE p_name END AS capitalised FROM part",
)
def edge_characters(spark, sf_dir):
    c = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", T.first_character(c).alias("first_char"), T.last_character(c).alias("last_char"), T.capitalised(c).alias("capitalised"))


@register(
    "syllable_numbers",
    f"""WITH v AS (SELECT DISTINCT w AS code FROM (SELECT unnest([replace(p_name, ' ', chr(769) || '-'), replace(p_name, ' ', '-') || chr(770), 'a' || chr(772) || left(p_name, 2)]) AS w FROM part))
SELECT code, array_to_string(list_transform(string_split(code, '-'), lambda s: regexp_replace(s, '[' || chr(769) || chr(770) || chr(772) || ']', '', 'g') || CASE WHEN contains(s, chr(769)) THEN '2' WHEN contains(s, chr(770)) THEN '5' WHEN contains(s, chr(772)) THEN '7' ELSE '' END), '-') AS numbered,
regexp_replace(regexp_replace(regexp_replace(code, chr(769), '2', 'g'), chr(770), '5', 'g'), chr(772), '7', 'g') AS digits, regexp_replace(code, '[' || chr(768) || '-' || chr(879) || ']', '', 'g') AS bare FROM v""",
)
def syllable_numbers(spark, sf_dir):
    """Marks behind the parts' names as digits: at the syllable's end, where they stand, and left out. Letters that have a composed form lie apart from marks here, so nothing is composed."""
    c, hyphened = F.col("p_name"), F.replace("p_name", F.lit(" "), F.lit("-"))
    forms = F.array(F.replace(c, F.lit(" "), F.lit("\u0301-")), F.concat(hyphened, F.lit("\u0302")), F.concat(F.lit("a\u0304"), F.left(c, F.lit(2))))
    rows = table(spark, sf_dir, "part").select(F.explode(forms).alias("code")).distinct()
    return rows.select("code", T.numbered(F.col("code")).alias("numbered"), T.marks_to_digits(F.col("code")).alias("digits"), T.strip_marks(F.col("code")).alias("bare"))


@register(
    "character_pairs",
    f"""WITH v AS (SELECT DISTINCT translate(split_part(p_type, ' ', 1), '{_FROM}', '{_TO}') AS word, replace(p_name, ' ', '-') AS code FROM part UNION SELECT '食' || translate(left(p_type, 1), '{_FROM}', '{_TO}'), replace(p_name, ' ', '-') FROM part),
c AS (SELECT word, code, regexp_extract_all(word, '[一-鿿㐀-䶿]') AS han, string_split(code, '-') AS s FROM v)
SELECT word, code, unnest(han) AS character, unnest(s) AS syllable FROM c WHERE len(han) = len(s) AND len(han) >= 2""",
)
def character_pairs(spark, sf_dir):
    han = lambda c: F.translate(c, _FROM, _TO)
    p = table(spark, sf_dir, "part")
    code = F.replace("p_name", F.lit(" "), F.lit("-")).alias("code")
    words = p.select(han(F.element_at(F.split("p_type", " "), 1)).alias("word"), code).unionByName(p.select(F.concat(F.lit("食"), han(F.left("p_type", F.lit(1)))).alias("word"), code)).distinct()
    return words.select("word", "code", F.explode(T.characters_with_syllables(F.col("word"), F.col("code"))).alias("c")).select("word", "code", "c.*")


@register(
    "half_width",
    "SELECT DISTINCT t AS text, translate(t, '，。！？：「」（）', ',.!?:\"\"()') AS half, right(translate(t, '，。！？：「」（）', ',.!?:\"\"()'), 1) IN ('.', '!', '?') AS ends FROM (SELECT p_name || ('，。！？：「」（）')[p_size % 9 + 1] || CASE WHEN p_size % 2 = 0 THEN ('。！？」')[p_size % 4 + 1] ELSE p_brand END AS t FROM part)",
)
def half_width(spark, sf_dir):
    pick = lambda chars, at: F.substring(F.lit(chars), (at + 1).cast("int"), F.lit(1))
    n = F.col("p_size")
    t = F.concat("p_name", pick("，。！？：「」（）", n % 9), F.when(n % 2 == 0, pick("。！？」", n % 4)).otherwise(F.col("p_brand")))
    rows = table(spark, sf_dir, "part").select(t.alias("text")).distinct()
    return rows.select("text", T.half_width(F.col("text")).alias("half"), T.ends_sentence(T.half_width(F.col("text"))).alias("ends"))
