"""Queries of the candidate filters over candidates made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators import candidates, contains, lookup, prefix_index
from lexspark.session import shared_path

from . import declared, string_queries  # noqa: F401  their SQL is used here
from .corpus_queries import table
from .registry import ORACLE, register

_MODES = (0, 1, 2, 3)


def _spelled(text: str) -> str:
    """The other spelling, in DuckDB SQL."""
    shown = ORACLE["tl_poj"].partition(" AS by_words, ")[2].partition(" AS shown FROM ")[0]
    return shown.replace("replace(code,", f"replace({text},")


_CHAR = "chr((19968 + ascii({w}) % 26 * 26 + len({w}))::INTEGER)"
_CORE_ROWS = f"""c AS (SELECT p_partkey AS query_id, p_size, string_split(p_name, ' ') AS w FROM part),
d AS (SELECT query_id, p_size, w, {_CHAR.format(w='w[1]')} AS a, {_CHAR.format(w='w[2]')} AS b FROM c),
k AS (SELECT query_id, a || CASE WHEN p_size % 3 = 0 THEN '--' ELSE '' END || b || CASE WHEN p_size % 7 = 0 THEN '好' ELSE '' END AS text, CASE WHEN p_size % 11 = 0 THEN '' ELSE ' [' || w[1] || CASE WHEN p_size % 5 = 0 THEN '--' ELSE ' ' END || w[2] || ']' END AS comment FROM d),
l AS (SELECT list(DISTINCT word) AS lo FROM (SELECT a AS word FROM d WHERE len(w[1]) % 2 = 0 UNION ALL SELECT a || b FROM d WHERE p_size > 40))"""
_CORE_SQL = f"""WITH {_CORE_ROWS},
s AS (SELECT query_id, text, comment, regexp_extract(comment, '\\[(.*?)\\]', 1) AS r0 FROM k),
r AS (SELECT *, CASE WHEN r0 <> '' AND contains(text, '--') AND NOT contains(r0, '--') AND len(string_split(text, '--')[1]) BETWEEN 1 AND len(string_split(r0, ' ')) - 1
  THEN array_to_string(string_split(r0, ' ')[1:len(string_split(text, '--')[1])], ' ') || '--' || array_to_string(string_split(r0, ' ')[len(string_split(text, '--')[1]) + 1:], ' ') ELSE r0 END AS raw FROM s),
g AS (SELECT r.*, lo, string_split(text, '--') AS ts, string_split(raw, '--') AS rs FROM r, l),
h AS (SELECT *, raw <> '' AND list_contains(lo, replace(text, '--', '')) AS whole, replace(raw, ' ', '-') AS shown,
  CASE WHEN len(ts) = len(rs) THEN array_to_string(list_transform(list_zip(ts, rs), lambda p: CASE WHEN list_contains(lo, p[1]) THEN replace(p[2], ' ', '-')
    WHEN len(p[1]) = len(string_split(p[2], ' ')) AND list_has_any(string_split(p[1], ''), lo) THEN array_to_string(list_transform(list_zip(string_split(p[1], ''), string_split(p[2], ' ')), lambda q: CASE WHEN list_contains(lo, q[1]) THEN q[2] ELSE q[1] END), '') ELSE p[1] END), '--') ELSE text END AS parts FROM g),
m AS (SELECT query_id, text, comment, raw, raw <> '' AND (whole OR parts <> text) AS has, CASE WHEN raw = '' THEN text WHEN whole THEN shown ELSE parts END AS new FROM h),
o AS (SELECT unnest([0, 1, 2, 3]) AS mode),
n AS (SELECT m.*, mode, CASE WHEN mode % 2 = 1 AND has THEN {{new}} ELSE new END AS out, CASE WHEN mode % 2 = 1 THEN replace({{raw}}, ' ', '-') ELSE replace(raw, ' ', '-') END AS roman,
  len(list_filter(regexp_split_to_array(raw, '[ -]+'), lambda x: x <> '')) AS syllables FROM m, o)
SELECT query_id, mode, out AS text, CASE WHEN raw = '' THEN comment ELSE ' [' || roman || ']' END AS comment,
(1.0 + CASE WHEN mode >= 2 THEN CASE WHEN raw = '' THEN 0.0 WHEN syllables >= 3 THEN 1.0 WHEN syllables >= 2 THEN 0.5 ELSE 0.0 END
  ELSE CASE WHEN has THEN 5.0 ELSE 0.0 END + CASE WHEN len(replace(out, '--', '')) >= 4 THEN 1.0 WHEN len(replace(out, '--', '')) >= 2 THEN 0.5 ELSE 0.0 END END)::DOUBLE AS quality FROM n"""


def core_sql() -> str:
    return _CORE_SQL.replace("{new}", _spelled("new")).replace("{raw}", _spelled("raw"))


def core_candidates(spark, sf_dir):
    """(query_id, pos, text, comment, quality) of parts: two characters made of the name's words, some with a light tone or one character more, and the rules' words."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), "p_size", F.split("p_name", " ").alias("w"))
    point = lambda w: F.lit(19968) + F.ascii(w) % 26 * 26 + F.length(w)
    char = lambda i: F.decode(F.unhex(F.hex(point(F.get("w", F.lit(i))))), "UTF-16BE")
    rows = rows.withColumns({"a": char(0), "b": char(1)})
    mark = F.when(F.col("p_size") % 3 == 0, "--").otherwise("")
    more = F.when(F.col("p_size") % 7 == 0, "好").otherwise("")
    between = F.when(F.col("p_size") % 5 == 0, "--").otherwise(" ")
    comment = F.when(F.col("p_size") % 11 == 0, "").otherwise(F.concat(F.lit(" ["), F.get("w", F.lit(0)), between, F.get("w", F.lit(1)), F.lit("]")))
    df = rows.select("query_id", F.lit(1).alias("pos"), F.concat("a", mark, "b", more).alias("text"), comment.alias("comment"), F.lit(1.0).alias("quality"))
    words = rows.where(F.length(F.get("w", F.lit(0))) % 2 == 0).select(F.col("a").alias("word")).unionByName(rows.where("p_size > 40").select(F.concat("a", "b").alias("word")))
    return df, words


@register("core_filter", core_sql())
def core_filter(spark, sf_dir):
    """The core filter in its four modes."""
    df, words = core_candidates(spark, sf_dir)
    out = None
    for mode in _MODES:
        part = candidates.rewritten(df, words, mode).select("query_id", F.lit(mode).alias("mode"), "text", "comment", "quality")
        out = part if out is None else out.unionByName(part)
    return out


_LIST = "(SELECT DISTINCT unnest(string_split(regexp_replace(text, '[.,]', '', 'g'), ' ')) AS word FROM benchmark)"


@register(
    "contains_words",
    f"WITH w AS (SELECT word FROM {_LIST} WHERE len(word) >= 2) SELECT doc_id, count(*) AS n, min(word) AS first_word, max(word) AS last_word, sum(len(word))::BIGINT AS n_chars FROM documents JOIN w ON contains(text, word) GROUP BY doc_id",
)
def contains_words(spark, sf_dir):
    """Which of the benchmark's words each document contains anywhere."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.regexp_replace("text", "[.,]", ""), " ")).alias("word")).where(F.length("word") >= 2)
    found = F.col("found")
    rows = table(spark, sf_dir, "documents").select("doc_id", contains.WordList(words).found(F.col("text")).alias("found")).where("size(found) > 0")
    total = F.aggregate(found, F.lit(0).cast("long"), lambda n, w: n + F.length(w))
    return rows.select("doc_id", F.size(found).cast("long").alias("n"), F.element_at(found, 1).alias("first_word"), F.element_at(found, -1).alias("last_word"), total.alias("n_chars"))


@register(
    "prefix_index_lookup",
    """WITH q AS (SELECT DISTINCT left(p_name, 1 + p_size % 6) AS input FROM part UNION SELECT DISTINCT left(p_type, 1) FROM part)
SELECT input, pos::INTEGER AS pos, p_partkey FROM (SELECT input, p_partkey, row_number() OVER (PARTITION BY input ORDER BY p_size DESC, p_name, printf('%09d', p_partkey)) AS pos FROM q JOIN part ON starts_with(p_name, input)) WHERE pos <= 100""",
)
def prefix_index_lookup(spark, sf_dir):
    """The hundred weightiest entries (the look-up's own limit) of inputs that come from the table, through the stored index."""
    part = table(spark, sf_dir, "part")
    path = shared_path(spark, "prefixes")
    prefix_index.build(part.select(F.col("p_name").alias("rime_key"), F.col("p_size").alias("weight"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("hanlo"), "p_partkey"), path)
    inputs = part.select(F.left("p_name", 1 + F.col("p_size") % 6).alias("input")).unionByName(part.select(F.left("p_type", F.lit(1)).alias("input"))).distinct()
    return prefix_index.look_up(inputs, path).select("input", "pos", "p_partkey")



@register(
    "both_spellings",
    f"SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN p_name WHEN {_spelled('p_name')} = p_name THEN ' [' || p_name || ']' ELSE ' [TL:' || p_name || ' POJ:' || {_spelled('p_name')} || ']' END AS comment FROM part",
)
def both_spellings(spark, sf_dir):
    """Comments with both spellings where they differ; those without brackets stay."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 10 == 0, F.col("p_name")).otherwise(F.concat(F.lit(" ["), "p_name", F.lit("]"))).alias("comment"))
    return candidates.with_both_spellings(rows)


def _marked_words() -> str:
    """(code, marked) of the numbered words of part names, in DuckDB SQL."""
    sql = ORACLE["tone_marks"]
    return "WITH v AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) || d AS code FROM part, (SELECT unnest(range(1, 10)) AS d))" + sql[sql.index(",\nb AS"):]


@register(
    "reading_comments",
    f"""WITH m AS ({_marked_words()}), c AS (SELECT p_partkey, p_size, split_part(p_name, ' ', 1) || (p_size % 9 + 1) AS a, split_part(p_name, ' ', 2) || (p_partkey % 9 + 1) AS b, p_name FROM part)
SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN '  ' || p_name ELSE x.marked || ' ' || y.marked || '(白)' END AS comment FROM c JOIN m x ON x.code = a JOIN m y ON y.code = b""",
)
def reading_comments(spark, sf_dir):
    """Numbered readings as marked ones, notes behind them kept; comments without digits stay."""
    word = lambda i, n: F.concat(F.split_part("p_name", F.lit(" "), F.lit(i)), (n % 9 + 1).cast("string"))
    comment = F.when(F.col("p_size") % 10 == 0, F.concat(F.lit("  "), "p_name")).otherwise(F.concat(word(1, F.col("p_size")), F.lit("  "), word(2, F.col("p_partkey")), F.lit("(白)")))
    rows = table(spark, sf_dir, "part").select("p_partkey", comment.alias("comment"))
    return candidates.formatted_readings(candidates.synonyms(rows))


@register(
    "marked_codes",
    f"""WITH m AS ({_marked_words()}), c AS (SELECT DISTINCT split_part(p_name, ' ', 1) || (p_size % 9 + 1) AS a, split_part(p_name, ' ', 2) || (p_size % 7 + 1) AS b FROM part)
SELECT a || ' ' || b || '--' || a AS code, x.marked || '-' || y.marked || '--' || x.marked AS marked FROM c JOIN m x ON x.code = a JOIN m y ON y.code = b""",
)
def marked_codes(spark, sf_dir):
    """Keys of several syllables with a light-tone boundary, marked."""
    word = lambda i, k: F.concat(F.split_part("p_name", F.lit(" "), F.lit(i)), (F.col("p_size") % k + 1).cast("string"))
    rows = table(spark, sf_dir, "part").select(word(1, 9).alias("a"), word(2, 7).alias("b")).distinct()
    code = F.concat(F.concat_ws(" ", "a", "b"), F.lit("--"), F.col("a"))
    return rows.select(code.alias("code"), T.marked(code).alias("marked"))


@register(
    "merged_candidates",
    """WITH a AS (SELECT p_brand AS query_id, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS pos FROM part WHERE p_size % 2 = 0),
b AS (SELECT p_brand AS query_id, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS pos FROM part WHERE p_size % 3 = 0),
u AS (SELECT *, 0 AS t FROM a UNION ALL SELECT *, 1 FROM b) SELECT query_id, p_partkey, row_number() OVER (PARTITION BY query_id ORDER BY t, pos)::INTEGER AS pos FROM u""",
)
def merged_candidates(spark, sf_dir):
    """Candidates of two translators, those of the first before those of the second."""
    part = table(spark, sf_dir, "part").withColumn("query_id", F.col("p_brand"))
    ranked = lambda where, *order: candidates.repositioned(part.where(where), *order).select("query_id", "p_partkey", "pos")
    return candidates.merged(ranked("p_size % 2 = 0", "p_retailprice", "p_partkey"), ranked("p_size % 3 = 0", F.desc("p_size"), "p_partkey"))


@register(
    "toneless_rules",
    "SELECT p_partkey AS seq, lower(replace(p_name, ' ', '-')) AS tail, p_type AS hanzi, p_brand AS rule FROM part WHERE p_size % 5 <> 0",
)
def toneless_rules(spark, sf_dir):
    """Light-tone rules made ready for suffix matching: combining marks dropped, those that ask for no change left out."""
    name = F.upper(F.replace("p_name", F.lit(" "), F.lit("\u0301-\u0300")))
    rules = table(spark, sf_dir, "part").select(name.alias("tl"), F.col("p_type").alias("hanzi"), F.when(F.col("p_size") % 5 == 0, "不處理").otherwise(F.col("p_brand")).alias("rule"), F.col("p_partkey").alias("seq"))
    return lookup.toneless_rules(rules).select("seq", "tail", "hanzi", "rule")


@register(
    "reverse_translator",
    f"""WITH w AS (SELECT split_part(p_name, ' ', 1) AS code, p_type || p_partkey AS hanlo, p_name AS reading, p_size AS weight FROM part), q AS (SELECT DISTINCT '~' || code AS query_id, code FROM w),
r AS (SELECT query_id, hanlo, reading, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, hanlo) AS pos FROM q JOIN w USING (code))
SELECT query_id, pos::INTEGER AS pos, hanlo AS text, CASE WHEN {_spelled('reading')} = reading THEN ' [' || reading || ']' ELSE ' [TL:' || reading || ' POJ:' || {_spelled('reading')} || ']' END AS comment FROM r WHERE pos <= 100""",
)
def reverse_translator(spark, sf_dir):
    """A declared chain: inputs with a tilde through the reverse translator (a hundred entries, its own limit), both spellings and unique texts; other inputs have no translator."""
    part = table(spark, sf_dir, "part").withColumn("code", F.split_part("p_name", F.lit(" "), F.lit(1)))
    reverse = part.select(F.concat("p_type", F.col("p_partkey").cast("string")).alias("hanlo"), F.col("code").alias("rime_key"), F.col("p_name").alias("reading"), F.col("p_size").alias("weight"))
    inputs = part.select(F.explode(F.array("code", F.concat(F.lit("~"), "code"))).alias("input")).distinct()
    chain = declared.declared(["engine:", "  translators:", "    - reverse_lookup_translator", "  filters:", "    - lua_filter@*any_lookup", "    - uniquifier"])
    out = declared.composed(chain, declared.Context({"reverse": reverse}), inputs.select(F.col("input").alias("query_id"), "input"))
    return out.select("query_id", "pos", "text", "comment")
