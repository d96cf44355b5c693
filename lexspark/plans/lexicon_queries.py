"""Queries with the driver's parts, orders and lineitems as lexicon, sources and candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators import candidates, glossmap, lexicon, lighttone, lookup, validate
from lexspark.sources import readers
from lexspark.streaming import sessions

from .corpus_queries import table
from .registry import ORACLE, register

_SOURCES = tuple(T.SOURCE_WEIGHTS.items())
_BRAND = "CASE right(p_brand, 1) " + " ".join(f"WHEN '{i + 1}' THEN '{s}'" for i, (s, _) in enumerate(_SOURCES[:4])) + " ELSE 'other' END"
_WEIGHT = "CASE source " + " ".join(f"WHEN '{s}' THEN {w}" for s, w in _SOURCES) + f" ELSE {T.OTHER_WEIGHT} END"


def _source():
    last = F.right("p_brand", F.lit(1))
    out = None
    for i, (s, _) in enumerate(_SOURCES[:4]):
        out = (F if out is None else out).when(last == str(i + 1), F.lit(s))
    return out.otherwise(F.lit("other"))


def entries(spark, sf_dir):
    """Parts as raw entries: type is the text, name the code, brand the source."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_type").alias("hanlo"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("kip_input"), F.col("p_name").alias("rime_key"), F.lit("").alias("hoabun"), _source().alias("source"), F.col("p_partkey").alias("seq"))


_ENTRIES = f"SELECT p_type AS hanlo, replace(p_name, ' ', '-') AS kip_input, p_name AS rime_key, {_BRAND} AS source, p_partkey AS seq FROM part"


@register(
    "source_rank_dedup",
    f"SELECT hanlo, rime_key, arg_min(source, {{'w': -w, 's': seq}}) AS source, arg_min(seq, {{'w': -w, 's': seq}}) AS seq FROM (SELECT *, {_WEIGHT} AS w FROM ({_ENTRIES})) GROUP BY hanlo, rime_key",
)
def source_rank_dedup(spark, sf_dir):
    return lexicon.weighted(entries(spark, sf_dir)).select("hanlo", "rime_key", "source", "seq")


@register(
    "source_overlap_weight",
    f"""WITH e AS (SELECT *, {_WEIGHT} AS w FROM ({_ENTRIES})), c AS (SELECT p_name AS word, count(*) AS cnt FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name),
b AS (SELECT hanlo, rime_key, max(w) AS w, count(DISTINCT source) AS n FROM e GROUP BY ALL)
SELECT b.hanlo, b.rime_key, trunc(w * 1.0 * pow(1.1, n - 1) * (1 + log10(1 + coalesce(cnt, 0)) * 0.2))::INTEGER AS weight FROM b LEFT JOIN c ON c.word = b.rime_key""",
)
def source_overlap_weight(spark, sf_dir):
    """Lexicon weights with counts of the parts' names in lineitem as the corpus."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    counts = li.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("word")), "l_partkey").groupBy("word").agg(F.sum("n").alias("cnt"))
    return lexicon.weighted(entries(spark, sf_dir), counts).select("hanlo", "rime_key", "weight")


_LI = "{'a': l_orderkey, 'b': l_linenumber, 'c': l_extendedprice, 'd': l_shipdate}"


@register("first_seen_dedup", f"SELECT l_partkey, l_suppkey, arg_min(l_orderkey, {_LI}) AS l_orderkey, min({_LI}).b AS l_linenumber FROM lineitem GROUP BY l_partkey, l_suppkey")
def first_seen_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate").alias("seq"))
    return lexicon.first_seen(rows, ["l_partkey", "l_suppkey"]).drop("seq")


@register(
    "column_fallback",
    "SELECT c_custkey, coalesce(nullif(CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END, ''), nullif(trim(c_name), ''), '') AS label FROM customer",
)
def column_fallback(spark, sf_dir):
    from lexspark.sources.readers import cell, either

    c = table(spark, sf_dir, "customer").withColumn("main", F.when(F.col("c_mktsegment") == "BUILDING", F.lit("")).otherwise(F.col("c_mktsegment")))
    return c.select("c_custkey", either(cell(c, "main"), cell(c, "absent"), cell(c, "c_name")).alias("label"))


@register("reverse_index_topk", "SELECT p_type, p_name, p_partkey, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS place FROM part) WHERE place <= 3")
def reverse_index_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_type", "p_name", "p_partkey", "p_retailprice")
    return lexicon.top_by_key(rows, "p_type", 3, [F.desc("p_retailprice"), "p_partkey"]).drop("p_retailprice")


@register("reverse_index", "SELECT p_name AS rime_key, string_agg(p_type || ':' || p_size, '|' ORDER BY p_size DESC, p_partkey) AS entries FROM part GROUP BY p_name")
def reverse_index(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("rime_key"), F.col("p_type").alias("hanlo"), F.col("p_size").alias("weight"), F.col("p_partkey").alias("seq"))
    listed = F.transform("entries", lambda e: F.concat_ws(":", e["text"], e["weight"].cast("string")))
    return lexicon.reverse_index(rows).select("rime_key", F.array_join(listed, "|").alias("entries"))


@register("set_per_key", "SELECT replace(p_name, ' ', '-') AS kip, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS texts, count(DISTINCT p_type)::INTEGER AS n FROM part GROUP BY 1")
def set_per_key(spark, sf_dir):
    return lexicon.texts_by_code(entries(spark, sf_dir)).select("kip", F.array_join("texts", "|").alias("texts"), "n")


@register("weight_by_code", "SELECT replace(p_name, ' ', '-') AS kip, max(p_size) AS weight FROM part GROUP BY 1")
def weight_by_code(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("rime_key"), F.col("p_size").alias("weight"))
    return lexicon.weight_by_code(rows)


@register("ordered_list_agg", "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS parts FROM lineitem GROUP BY l_orderkey")
def ordered_list_agg(spark, sf_dir):
    """Lineitems as definitions of their orders, in the order of their lines."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("主編碼"), F.col("l_partkey").cast("string").alias("釋義"), F.lit("").alias("_file"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("_row"))
    return readers.definitions(rows).select(F.col("moe_id").cast("long").alias("l_orderkey"), F.array_join("definitions", ",").alias("parts"))


_ARG = "{'a': l_returnflag = 'R', 'b': l_linenumber = l_suppkey % 7, 'c': l_quantity, 'd': -l_orderkey, 'e': -l_linenumber, 'f': -l_extendedprice}"


@register("lexicographic_argmax", f"SELECT l_partkey, arg_max(l_orderkey, {_ARG}) AS l_orderkey FROM lineitem GROUP BY l_partkey")
def lexicographic_argmax(spark, sf_dir):
    order = F.struct((F.col("l_returnflag") == "R").alias("a"), (F.col("l_linenumber") == F.col("l_suppkey") % 7).alias("b"), F.col("l_quantity"), -F.col("l_orderkey"), -F.col("l_linenumber"), -F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.max_by("l_orderkey", order).alias("l_orderkey"))


@register(
    "gap_fill_map",
    "WITH o AS (SELECT o_custkey AS k, max(o_orderpriority) AS v FROM orders GROUP BY o_custkey) SELECT k, v FROM o UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.k = c_custkey)",
)
def gap_fill_map(spark, sf_dir):
    main = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderpriority").alias("v"))
    rest = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    return main.unionByName(lexicon.without(rest, main, ["k"]))


@register("anti_join_existing", "SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
def anti_join_existing(spark, sf_dir):
    sold = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return lexicon.without(table(spark, sf_dir, "part").select("p_partkey", "p_name"), sold, ["p_partkey"])


def _light(spark, sf_dir):
    """Words with a light-tone mark made of the parts' names; a lexicon of first words and, for large parts, of whole names; rules for some suffixes."""
    p = table(spark, sf_dir, "part").select("p_name", "p_partkey", "p_type", "p_size", F.split("p_name", " ").alias("w"))
    one = p.select(F.concat(F.lit("甲"), F.substring("p_type", 1, 3)).alias("hanlo"), F.element_at("w", 1).alias("rime_key"), F.lit(500).alias("weight"), F.col("p_partkey").alias("seq"))
    two = p.where("p_size > 48").select(F.concat(F.lit("乙"), F.left("p_type", F.lit(1)), F.lit("丙")).alias("hanlo"), F.col("p_name").alias("rime_key"), (F.col("p_size") * 9).alias("weight"), F.col("p_partkey").alias("seq"))
    words = p.select(F.array_join("w", "--").alias("word"), F.col("p_partkey").alias("n")).groupBy("word").agg(F.count("n").alias("cnt"))
    rules = p.where("w[1] >= 'm'").select(F.element_at("w", 2).alias("tl"), F.upper(F.element_at("w", 2)).alias("hanzi"), F.lit("補語").alias("rule"), F.col("p_partkey").alias("seq"))
    return words, one.unionByName(two), rules


_RULES = "suf AS (SELECT DISTINCT w[2] AS kip, upper(w[2]) AS hanzi FROM p WHERE w[2] >= 'm')"
_LEX = "txt AS (SELECT w[1] AS kip, list_sort(list(DISTINCT '甲' || left(p_type, 3))) AS texts FROM p GROUP BY 1)"
_P = "p AS (SELECT *, string_split(p_name, ' ') AS w FROM part)"
_FOUND = f"""{_P}, {_RULES}, {_LEX}, words AS (SELECT DISTINCT w[1] || '--' || w[2] AS word, w[1] AS head, w[2] AS tail FROM p),
whole AS (SELECT DISTINCT w[1] || '--' || w[2] AS word, '乙--' || left(p_type, 1) || '丙' AS hanlo FROM p WHERE p_size > 48),
t AS (SELECT words.*, coalesce(suf.hanzi, CASE WHEN len(one.texts) = 1 THEN one.texts[1] END) AS hz FROM words LEFT JOIN suf ON suf.kip = tail LEFT JOIN txt one ON one.kip = tail WHERE word NOT IN (SELECT word FROM whole)),
found AS (SELECT * FROM whole UNION ALL SELECT word, h || '--' || hz AS hanlo FROM (SELECT word, hz, unnest(texts) AS h FROM t JOIN txt ON txt.kip = head WHERE hz IS NOT NULL))"""


@register("fallback_join", f"WITH {_FOUND} SELECT word, hanlo FROM found")
def fallback_join(spark, sf_dir):
    """Texts of whole words where there are any, else put together from segments."""
    words, lex, rules = _light(spark, sf_dir)
    return lighttone.found_texts(words, lex, rules)


@register(
    "light_tone_entries",
    f"""WITH {_FOUND}, cnt AS (SELECT w[1] || '--' || w[2] AS word, count(*) AS n FROM p GROUP BY 1), cap AS (SELECT replace(p_name, ' ', '--') AS word, max(p_size * 9) AS plain FROM part WHERE p_size > 48 GROUP BY 1),
r AS (SELECT hanlo, replace(word, '--', '  ') AS rime_key, plain, least(1500, greatest(300, trunc(300 + log10(1 + n) * 150)::BIGINT)) AS raw FROM found JOIN cnt USING (word) LEFT JOIN cap USING (word))
SELECT DISTINCT hanlo, rime_key, (CASE WHEN plain IS NULL THEN raw ELSE greatest(300, least(raw, plain - 100)) END)::BIGINT AS weight FROM r""",
)
def light_tone_entries(spark, sf_dir):
    words, lex, rules = _light(spark, sf_dir)
    return lighttone.light_tone_entries(words, lex, rules).withColumn("weight", F.col("weight").cast("long"))


@register(
    "single_candidate_resolve",
    f"""WITH {_P}, {_RULES}, {_LEX}, s AS (SELECT DISTINCT unnest(w) AS kip FROM p)
SELECT s.kip, coalesce(suf.hanzi, CASE WHEN len(txt.texts) = 1 THEN txt.texts[1] END) AS hanzi FROM s LEFT JOIN suf USING (kip) LEFT JOIN txt USING (kip)""",
)
def single_candidate_resolve(spark, sf_dir):
    words, lex, rules = _light(spark, sf_dir)
    segments = words.select(F.explode(F.split("word", "--")).alias("kip")).distinct()
    return lighttone.resolved_segments(segments, lexicon.texts_by_code(lex), lighttone.suffix_texts(rules)).select("kip", "hanzi")


@register(
    "all_segments_resolved",
    """WITH n AS (SELECT DISTINCT replace(lower(p_name || ' ' || p_type), ' ', '--') AS word FROM part), s AS (SELECT word, unnest(string_split(word, '--')[2:]) AS kip, generate_subscripts(string_split(word, '--')[2:], 1) AS place FROM n),
suf AS (SELECT DISTINCT w AS kip, upper(w) || '字' AS hanzi FROM (SELECT unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS w FROM part) WHERE w >= 'm')
SELECT word, bool_and(hanzi IS NOT NULL) AS ok, string_agg(coalesce(hanzi, kip), '--' ORDER BY place) AS tail FROM s LEFT JOIN suf USING (kip) GROUP BY word""",
)
def all_segments_resolved(spark, sf_dir):
    """Words of three parts, by rules alone."""
    kinds = table(spark, sf_dir, "part").select(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ").alias("w"), F.col("p_partkey").alias("seq"))
    words = kinds.select(F.array_join("w", "--").alias("word")).distinct().select("word", F.split("word", "--").alias("parts"))
    rules = kinds.select("seq", F.explode("w").alias("tl")).where("tl >= 'm'").select("tl", F.concat(F.upper("tl"), F.lit("字")).alias("hanzi"), "seq")
    none = lexicon.texts_by_code(spark.createDataFrame([], "hanlo string, rime_key string"))
    return lighttone.resolved_tails(words, none, lighttone.suffix_texts(rules))


@register(
    "gloss_map_build",
    """WITH g AS (SELECT p_partkey AS seq, (p_size % 4 + 1) AS priority, replace(p_name, ' ', '-') AS kip, string_split(translate(lower(p_type || ' ' || p_name), 'abdeilnorstcghkmpu', '食飯好人大水火山口手日月木金土心石田'), ' ') AS w FROM part),
r AS (SELECT seq, priority, kip, w[1] AS hanlo, CASE WHEN seq % 2 = 0 THEN left(w[-1], 2) ELSE w[1] || '、' || w[-1] END AS hoabun FROM g),
w AS (SELECT *, list_filter(string_split(hoabun, '、'), lambda x: len(x) <= 6 AND regexp_matches(x, '[一-鿿㐀-䶿]')) AS words FROM r),
n AS (SELECT kip, priority, seq, hanlo, len(words) AS n, unnest(words) AS mandarin, generate_subscripts(words, 1) AS place FROM w),
m AS (SELECT mandarin, arg_min(replace(kip, '-', ' '), {'p': NOT (n = 1 OR mandarin = hanlo), 'f': len(string_split(kip, '-')) <> len(regexp_extract_all(mandarin, '[一-鿿㐀-䶿]')), 'w': -priority, 's': seq, 'a': place}) AS kip FROM n GROUP BY mandarin),
h AS (SELECT *, regexp_extract_all(mandarin, '[一-鿿㐀-䶿]') AS han FROM n),
c AS (SELECT unnest(han) AS mandarin, unnest(string_split(kip, '-')) AS kip, seq, place, unnest(range(len(han))) AS c FROM h WHERE len(han) = len(string_split(kip, '-')) AND len(han) >= 2),
d AS (SELECT mandarin, arg_min(kip, {'s': seq, 'a': place, 'c': c}) AS kip FROM c GROUP BY mandarin)
SELECT * FROM m UNION ALL SELECT * FROM d WHERE mandarin NOT IN (SELECT mandarin FROM m)""",
)
def gloss_map_build(spark, sf_dir):
    """The parts' types, respelled in Han, as glosses of their names: words of up to six characters, and characters of two-character words."""
    p = table(spark, sf_dir, "part")
    w = p.select(F.col("p_partkey").alias("seq"), (F.col("p_size") % 4 + 1).alias("priority"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("kip"), F.split(F.translate(F.lower(F.concat_ws(" ", "p_type", "p_name")), "abdeilnorstcghkmpu", "食飯好人大水火山口手日月木金土心石田"), " ").alias("w"))
    hoabun = F.when(F.col("seq") % 2 == 0, F.left(F.element_at("w", -1), F.lit(2))).otherwise(F.concat(F.element_at("w", 1), F.lit("、"), F.element_at("w", -1)))
    return glossmap.gloss_map(w.select("seq", "priority", "kip", F.element_at("w", 1).alias("hanlo"), hoabun.alias("hoabun")))


@register(
    "longest_suffix_match",
    """WITH p AS (SELECT p_partkey AS id, string_split(p_type || ' ' || p_name, ' ') AS s FROM part),
r AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS tail FROM part WHERE p_name >= 'l' UNION SELECT DISTINCT replace(p_name, ' ', '-') FROM part WHERE p_name < 'p'),
t AS (SELECT id, n, array_to_string(s[-n:], '-') AS tail FROM (SELECT id, list_transform(s, lambda x: lower(x)) AS s, unnest(range(1, least(3, len(s) - 1) + 1)) AS n FROM p)),
m AS (SELECT id, n, tail FROM t JOIN r USING (tail)) SELECT id, n::INTEGER AS n, tail FROM m QUALIFY n = max(n) OVER (PARTITION BY id)""",
)
def longest_suffix_match(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    codes = p.select(F.col("p_partkey").alias("id"), F.split(F.concat_ws(" ", "p_type", "p_name"), " ").alias("syllables"))
    rules = p.where("p_name >= 'l'").select(F.element_at(F.split("p_name", " "), 2).alias("tail")).unionByName(p.where("p_name < 'p'").select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("tail"))).distinct()
    return lookup.longest_suffix(codes, rules).select("id", "n", "tail")


_INPUTS = ((1, "s"), (2, "la"), (3, "smoke"), (4, "mi"), (5, "zz"), (6, "red p"))
_Q = "q(query_id, input) AS (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in _INPUTS) + ")"


@register("prefix_lookup", f"WITH {_Q} SELECT query_id::BIGINT AS query_id, pos::INTEGER AS pos, p_partkey FROM (SELECT query_id, p_partkey, row_number() OVER (PARTITION BY query_id ORDER BY p_size DESC, p_name, printf('%09d', p_partkey)) AS pos FROM q, part WHERE starts_with(p_name, input)) WHERE pos <= 100")
def prefix_lookup(spark, sf_dir):
    """The hundred weightiest entries for each input (the look-up's own limit)."""
    queries = spark.createDataFrame(list(_INPUTS), "query_id long, input string")
    lex = table(spark, sf_dir, "part").select(F.col("p_name").alias("rime_key"), F.col("p_size").alias("weight"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("hanlo"), "p_partkey")
    return lookup.prefix(queries, lex).select("query_id", "pos", "p_partkey")


@register(
    "fuzzy_lookup",
    "WITH RECURSIVE "
    + ", ".join(["s0 AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS word, split_part(p_name, ' ', 1) AS x FROM part)"] + [f"s{i + 1} AS (SELECT word, x FROM s{i} UNION SELECT word, regexp_replace(x, '{a}', '{b}', 'g') FROM s{i})" for i, (a, b) in enumerate(T.SPELLING_RULES)])
    + f" SELECT q.word AS input, s.word AS rime_key FROM (SELECT DISTINCT regexp_replace(word, 'h$', '', 'g') AS word FROM s0) q JOIN (SELECT DISTINCT word, x FROM s{len(T.SPELLING_RULES)}) s ON s.x = q.word WHERE q.word <> ''",
)
def fuzzy_lookup(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.element_at(F.split("p_name", " "), 1).alias("rime_key")).distinct()
    lex = words.select(F.col("rime_key").alias("hanlo"), "rime_key", F.lit(1).alias("weight"))
    queries = words.select(F.regexp_replace("rime_key", "h$", "").alias("input")).where("input <> ''").distinct().withColumn("query_id", F.xxhash64("input"))
    return lookup.fuzzy(queries, lookup.spellings(lex)).select("input", "rime_key")


#: Inputs with a wildcard, made of the parts' names.
_WILD = """(SELECT min(p_partkey) AS query_id, input FROM (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '?' || right(split_part(p_name, ' ', 1), 1) WHEN 1 THEN left(p_name, 1) || '?' || right(split_part(p_name, ' ', 1), 1) WHEN 2 THEN left(p_name, 1) || '?' WHEN 3 THEN left(p_name, 1) || '?n5' ELSE '?' END AS input FROM part) GROUP BY input)"""


def _wild(spark, sf_dir):
    first, end, size = F.left("p_name", F.lit(1)), F.right(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(1)), F.col("p_size") % 5
    text = F.when(size == 0, F.concat(F.lit("?"), end)).when(size == 1, F.concat(first, F.lit("?"), end)).when(size == 2, F.concat(first, F.lit("?"))).when(size == 3, F.concat(first, F.lit("?n5"))).otherwise(F.lit("?"))
    return table(spark, sf_dir, "part").groupBy(text.alias("input")).agg(F.min("p_partkey").alias("query_id"))


@register(
    "wildcard_expand",
    f"""WITH q AS {_WILD},
i AS (SELECT * FROM (VALUES {', '.join(f"('{x}', {k})" for k, x in enumerate(lookup.INITIALS))}) t(ini, a)), f AS (SELECT * FROM (VALUES {', '.join(f"('{x}', {k})" for k, x in enumerate(lookup.FINALS))}) t(fin, b)),
p AS (SELECT query_id, split_part(input, '?', 1) AS pre, split_part(input, '?', 2) AS rest, regexp_replace(split_part(input, '?', 2), '[0-9]+$', '') AS post, regexp_extract(split_part(input, '?', 2), '([0-9]*)$', 1) AS tone FROM q),
c AS (SELECT query_id, ini || rest AS code, a AS seq FROM p, i WHERE pre = '' UNION ALL
SELECT query_id, ini || fin || tone, a * {len(lookup.FINALS)} + b FROM p, i, f WHERE pre <> '' AND starts_with(pre, ini) AND starts_with(fin, substr(pre, len(ini) + 1)) AND ends_with(fin, post))
SELECT query_id::BIGINT AS query_id, code, min(seq)::INTEGER AS seq FROM c WHERE code <> '' GROUP BY ALL""",
)
def wildcard_expand(spark, sf_dir):
    return lookup.wildcard_codes(_wild(spark, sf_dir))


@register(
    "wildcard_counts",
    ORACLE["wildcard_expand"].replace("SELECT query_id::BIGINT AS query_id, code, min(seq)::INTEGER AS seq FROM c WHERE code <> '' GROUP BY ALL", """, e AS (SELECT query_id::BIGINT AS query_id, code, min(seq)::INTEGER AS seq FROM c WHERE code <> '' GROUP BY ALL),
w AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS rime_key, p_type FROM part), d AS (SELECT DISTINCT code FROM e),
r AS (SELECT d.code, w.p_type, row_number() OVER (PARTITION BY d.code ORDER BY w.rime_key, w.p_type) AS pos FROM d JOIN w ON starts_with(w.rime_key, d.code)),
k AS (SELECT code, count(DISTINCT p_type) AS n FROM r WHERE pos <= 100 GROUP BY code) SELECT query_id, code, seq, n FROM e JOIN k USING (code)"""),
)
def wildcard_counts(spark, sf_dir):
    """What each wildcard may stand for, with the distinct texts among the first hundred entries of each (the look-up's own limit)."""
    lex = table(spark, sf_dir, "part").select(F.element_at(F.split("p_name", " "), 1).alias("rime_key"), F.col("p_type").alias("hanlo")).distinct().withColumn("weight", F.lit(1))
    return lookup.wildcard(_wild(spark, sf_dir), lex)


#: Phrase inputs, made of the parts' names and types; some have no entry.
_PHRASES = "(SELECT min(p_partkey) AS query_id, input FROM (SELECT p_partkey, left(CASE WHEN p_size % 7 = 0 THEN lower(p_type) ELSE p_name END, (1 + p_size % 3)::INTEGER) AS input FROM part) GROUP BY input)"


@register(
    "phrase_lookup",
    f"""WITH q AS {_PHRASES}, w AS (SELECT split_part(p_name, ' ', 1) AS rime_key, left(p_type, 5) AS hanlo, max(p_size) AS weight FROM part GROUP BY ALL),
r AS (SELECT query_id, hanlo, rime_key, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, rime_key, hanlo) AS pos FROM q JOIN w ON starts_with(rime_key, input)),
f AS (SELECT query_id, hanlo, min(pos)::INTEGER AS pos, arg_min(rime_key, pos) AS rime_key FROM r WHERE pos <= 100 GROUP BY ALL) SELECT query_id::BIGINT AS query_id, input, hanlo, pos, rime_key FROM q LEFT JOIN f USING (query_id)""",
)
def phrase_lookup(spark, sf_dir):
    """Texts for phrase inputs, each once; an input without any has a row that says so."""
    lex = table(spark, sf_dir, "part").groupBy(F.element_at(F.split("p_name", " "), 1).alias("rime_key"), F.left("p_type", F.lit(5)).alias("hanlo")).agg(F.max("p_size").alias("weight"))
    text = F.left(F.when(F.col("p_size") % 7 == 0, F.lower("p_type")).otherwise(F.col("p_name")), 1 + F.col("p_size") % 3)
    queries = table(spark, sf_dir, "part").groupBy(F.concat(F.lit(";"), text).alias("input")).agg(F.min("p_partkey").alias("query_id"))
    return lookup.phrase(queries, lex)


@register(
    "session_states",
    """WITH e AS (SELECT user_id AS session_id, event_id AS seq, (['letter','shift_letter','tab','space','select','escape','nav','punct','apostrophe','release','digit'])[event_id % 11 + 1] AS kind, value > 20 AS composing, value > 40 AS menu, length(event_type) % 2 = 0 AS full_roman, value < 10 AS has_code,
CASE WHEN event_id % 11 = 7 THEN ([',', '.', '?'])[event_id % 3 + 1] ELSE left(event_type, (1 + event_id % 2)::INTEGER) END AS text FROM events),
s AS (SELECT *, kind IN ('space', 'select') AND composing AND menu AS commits, text IN ('.', '!', '?') AS ends, NOT composing AND NOT menu AS idle FROM e),
x AS (SELECT *, CASE WHEN kind = 'shift_letter' AND NOT composing THEN true WHEN commits AND full_roman THEN false WHEN kind = 'punct' AND full_roman AND (composing OR ends) THEN ends END AS caps,
CASE WHEN kind = 'release' THEN NULL WHEN kind = 'tab' AND menu THEN true WHEN NOT composing THEN false WHEN kind NOT IN ('nav', 'tab') THEN false END AS mode,
CASE WHEN kind = 'release' THEN NULL WHEN commits THEN CASE WHEN length(text) = 1 THEN text ELSE '' END WHEN idle AND kind = 'apostrophe' THEN CASE WHEN has_code THEN '' END WHEN idle AND kind <> 'shift_letter' AND NOT (kind = 'punct' AND full_roman) THEN '' END AS last FROM s)
SELECT session_id, seq, coalesce(last_value(caps IGNORE NULLS) OVER w, true) AS capitalise_next, coalesce(last_value(mode IGNORE NULLS) OVER w, false) AS selecting, nullif(last_value(last IGNORE NULLS) OVER w, '') AS last_text FROM x WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def session_states(spark, sf_dir):
    """Events as key events of their users: the state behind each."""
    return sessions.session_states(key_events(spark, sf_dir)).select("session_id", "seq", "capitalise_next", "selecting", "last_text")


def key_events(spark, sf_dir):
    n = F.col("event_id")
    kinds = F.array(*map(F.lit, ("letter", "shift_letter", "tab", "space", "select", "escape", "nav", "punct", "apostrophe", "release", "digit")))
    marks = F.array(*map(F.lit, (",", ".", "?")))
    at = lambda values, k: F.element_at(values, (n % k + 1).cast("int"))
    text = F.when(n % 11 == 7, at(marks, 3)).otherwise(F.left("event_type", (1 + n % 2).cast("int")))
    flags = {"composing": F.col("value") > 20, "menu": F.col("value") > 40, "full_roman": F.length("event_type") % 2 == 0, "has_code": F.col("value") < 10}
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), n.alias("seq"), at(kinds, 11).alias("kind"), *(c.alias(k) for k, c in flags.items()), text.alias("text"))


_CAND = "SELECT p_brand AS query_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS pos, p_type || repeat('字', (p_partkey % 4)::INTEGER) AS text, p_partkey FROM part"


def _candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("query_id"), F.struct("p_retailprice", "p_partkey").alias("_o"), F.concat("p_type", F.repeat(F.lit("字"), (F.col("p_partkey") % 4).cast("int"))).alias("text"), "p_partkey")
    return candidates.repositioned(rows, "_o").drop("_o")


@register(
    "long_word_reorder",
    f"""WITH c AS ({_CAND}), f AS (SELECT *, first_value(len(text)) OVER (PARTITION BY query_id ORDER BY pos) AS first_len FROM c),
e AS (SELECT *, pos >= 4 AND len(text) > first_len AND NOT regexp_matches(text, '^[\\x00-\\x7f]+$') AS ok FROM f),
s AS (SELECT *, sum(ok::INTEGER) OVER w AS so_far, sum((pos >= 4 AND NOT ok)::INTEGER) OVER w AS others FROM e WINDOW w AS (PARTITION BY query_id ORDER BY pos)),
b AS (SELECT *, CASE WHEN pos < 4 THEN 0 WHEN ok AND so_far <= 2 AND others <= 50 THEN 1 ELSE 2 END AS bucket FROM s)
SELECT query_id, p_partkey, row_number() OVER (PARTITION BY query_id ORDER BY bucket, pos)::INTEGER AS pos FROM b""",
)
def long_word_reorder(spark, sf_dir):
    return candidates.long_words_first(_candidates(spark, sf_dir)).select("query_id", "p_partkey", "pos")


@register("candidate_unique", f"SELECT query_id, text, min(pos)::INTEGER AS pos, arg_min(p_partkey, pos) AS p_partkey FROM ({_CAND}) GROUP BY query_id, text")
def candidate_unique(spark, sf_dir):
    return candidates.unique(_candidates(spark, sf_dir)).select("query_id", "text", "pos", "p_partkey")


@register("paging", f"SELECT query_id, p_partkey, ((pos - 1) // 10)::INTEGER AS page, ((pos - 1) % 10)::INTEGER AS on_page, substr('asdfghjkl;', ((pos - 1) % 10 + 1)::INTEGER, 1) AS key FROM ({_CAND})")
def paging(spark, sf_dir):
    return candidates.paged(_candidates(spark, sf_dir)).select("query_id", "p_partkey", "page", "on_page", "key")


@register(
    "candidate_light_tones",
    """WITH c AS (SELECT p_partkey AS query_id, '一二三四' AS text, string_split(p_type || ' ' || p_name, ' ') AS s FROM part), r AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS tail FROM part WHERE p_name >= 'p'),
v AS (SELECT c.query_id, left(text, len(s) - 1) || '--' || upper(tail) AS text, ' [' || array_to_string(s[:-2], ' ') || '--' || s[-1] || ']' AS comment, 2 AS pos FROM c JOIN r ON lower(s[-1]) = tail)
SELECT query_id, text, ' [' || array_to_string(s, ' ') || ']' AS comment, 1 AS pos FROM c UNION ALL SELECT query_id, text, comment, pos FROM v""",
)
def candidate_light_tones(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("query_id"), F.lit(1).alias("pos"), F.lit("一二三四").alias("text"), F.concat(F.lit(" ["), F.concat_ws(" ", "p_type", "p_name"), F.lit("]")).alias("comment"), F.lit(1.0).alias("quality"))
    tail = F.element_at(F.split("p_name", " "), 2)
    rules = p.where("p_name >= 'p'").select(tail.alias("tail"), F.upper(tail).alias("hanzi"), F.lit(0).alias("seq")).distinct()
    return candidates.with_light_tones(rows, rules).select("query_id", "text", "comment", "pos")


@register(
    "candidate_recommended",
    """WITH c AS (SELECT p_partkey, p_type AS text, ' [' || p_name || ']' AS comment FROM part), w AS (SELECT DISTINCT unnest(string_split(p_type, ' ')) AS word FROM part), t(word, kind) AS (VALUES ('E', 'lo'), ('PROMO', 'han'), ('BRASS', 'han'), ('STEEL', 'lo')),
h AS (SELECT p_partkey, bool_or(kind = 'han') AS han, bool_or(kind = 'lo') AS lo FROM c JOIN t ON contains(text, t.word) GROUP BY p_partkey)
SELECT c.p_partkey AS query_id, CASE WHEN h.p_partkey IS NULL THEN comment ELSE ' ' || (CASE WHEN han THEN '◆' ELSE '' END) || (CASE WHEN lo THEN '★' ELSE '' END) || ' ' || substr(comment, 2) END AS comment FROM c LEFT JOIN h USING (p_partkey)""",
)
def candidate_recommended(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.lit(1).alias("pos"), F.col("p_type").alias("text"), F.concat(F.lit(" ["), "p_name", F.lit("]")).alias("comment"), F.lit(1.0).alias("quality"))
    words = spark.createDataFrame([("E", "lo"), ("PROMO", "han"), ("BRASS", "han"), ("STEEL", "lo")], "word string, type string")
    return candidates.recommended(rows, words).select("query_id", "comment")


_TEXTS = "p_name || ' ' || left(p_type, 4) || p_size % 5"


@register(
    "code_chain_lookup",
    f"""WITH t AS (SELECT DISTINCT {_TEXTS} AS text FROM part), a AS (SELECT {_TEXTS} AS text, arg_min(p_type, {{'a': -p_size, 'b': p_partkey}}) AS code FROM part WHERE contains(p_type, 'BRASS') GROUP BY 1),
b AS (SELECT {_TEXTS} AS text, max(p_brand) AS code FROM part WHERE right(p_brand, 1) = '3' GROUP BY 1) SELECT text, coalesce(a.code, b.code) AS code FROM t LEFT JOIN a USING (text) LEFT JOIN b USING (text)""",
)
def code_chain_lookup(spark, sf_dir):
    """Codes of the first table, brass parts, else of the second, parts of some brands, else null."""
    p = table(spark, sf_dir, "part").withColumn("text", F.concat("p_name", F.lit(" "), F.left("p_type", F.lit(4)), (F.col("p_size") % 5).cast("string")))
    reverse = p.where("contains(p_type, 'BRASS')").select(F.col("text").alias("hanlo"), F.col("p_type").alias("rime_key"), F.col("p_size").alias("weight"), F.col("p_partkey").alias("seq"))
    glosses = p.where("right(p_brand, 1) = '3'").groupBy(F.col("text").alias("mandarin")).agg(F.max("p_brand").alias("kip"))
    return lookup.codes_of(p.select("text").distinct(), reverse, glosses).select("text", "code")


@register(
    "dict_validate",
    "SELECT l_orderkey, l_linenumber, l_partkey, 'duplicate' AS kind FROM (SELECT *, min({'a': l_partkey, 'b': l_suppkey, 'c': l_extendedprice}) OVER (PARTITION BY l_orderkey, l_linenumber) AS f FROM lineitem) WHERE {'a': l_partkey, 'b': l_suppkey, 'c': l_extendedprice} > f",
)
def dict_validate(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.struct("l_partkey", "l_suppkey", "l_extendedprice").alias("o"))
    return validate.duplicate_rows(rows, ["l_orderkey", "l_linenumber"], "o").select("l_orderkey", "l_linenumber", "l_partkey", F.lit("duplicate").alias("kind"))
