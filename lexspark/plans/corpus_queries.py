"""Queries over documents, conversations and events: counts, pairs, weights, flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators import corpus, lexicon, phrases
from lexspark.session import stored
from lexspark.sources.sinks import sentence_line

from .registry import register

#: White space that parts words, for DuckDB's patterns; Spark's side uses its Unicode class.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark, sf_dir, name="documents", key="doc_id"):
    """A table's keys and texts, over all cores."""
    return corpus.spread(table(spark, sf_dir, name).select(key, "text"), key)


def _stripped(source: str, column: str = "text") -> str:
    return f"SELECT regexp_replace(w, '^[^a-zA-Z]+|[^a-zA-Z0-9-]+$', '', 'g') AS token FROM (SELECT unnest(regexp_split_to_array({column}, '{SPACE}')) AS w FROM {source})"


_KEPT = "regexp_matches(token, '[1-9]') OR lower(token) IN ('a','e','i','o','u','m','ng')"


@register("token_freq", f"SELECT token AS word, count(*) AS cnt FROM ({_stripped('documents')}) WHERE {_KEPT} GROUP BY token")
def token_freq(spark, sf_dir):
    return corpus.token_counts(texts(spark, sf_dir), "text")


@register("token_freq_all", f"SELECT token AS word, count(*) AS cnt FROM ({_stripped('documents')}) WHERE token <> '' GROUP BY token ORDER BY cnt DESC, word")
def token_freq_all(spark, sf_dir):
    """All words by falling count."""
    counts = corpus.token_counts(texts(spark, sf_dir), "text", T.edge_stripped)
    return counts.orderBy(F.desc("cnt"), "word")


@register(
    "freq_merge",
    f"""WITH a AS (SELECT token AS word, count(*) AS cnt FROM ({_stripped('documents')}) WHERE token <> '' GROUP BY token),
b AS (SELECT token AS word, count(*) AS cnt FROM ({_stripped('conversations')}) WHERE token <> '' GROUP BY token)
SELECT word, sum(cnt)::BIGINT AS cnt FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY word""",
)
def freq_merge(spark, sf_dir):
    tables = [corpus.token_counts(texts(spark, sf_dir, *n), "text", T.edge_stripped) for n in ((), ("conversations", "conv_id"))]
    return corpus.merged_counts(*tables)


@register(
    "freq_log_weight",
    f"""SELECT token AS word, count(*) AS cnt, trunc(800 * 1.2 * pow(1.1, 0) * (1 + log10(1 + count(*)) * 0.2))::INTEGER AS weight
FROM ({_stripped('documents')}) WHERE token <> '' GROUP BY token""",
)
def freq_log_weight(spark, sf_dir):
    counts = corpus.token_counts(texts(spark, sf_dir), "text", T.edge_stripped)
    return counts.withColumn("weight", T.entry_weight(F.lit(800), F.lit(1.2), F.lit(1), F.col("cnt")))


@register(
    "freq_summary",
    f"SELECT count(*) AS unique_words, coalesce(sum(cnt), 0)::BIGINT AS total_tokens FROM (SELECT token, count(*) AS cnt FROM ({_stripped('documents')}) WHERE token <> '' GROUP BY token)",
)
def freq_summary(spark, sf_dir):
    return corpus.summary(corpus.token_counts(texts(spark, sf_dir), "text", T.edge_stripped))


@register(
    "sentence_tokens",
    f"""WITH l AS (SELECT doc_id, n, regexp_split_to_array(line, '{SPACE}') AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents)),
t AS (SELECT doc_id, n, list_filter(list_transform(w, lambda x: regexp_replace(x, '^[^a-zA-Z]+|[^a-zA-Z0-9-]+$', '', 'g')), lambda x: x <> '') AS tokens FROM l)
SELECT doc_id, n::INTEGER AS line_no, array_to_string(tokens, ' ') AS sentence, len(tokens)::INTEGER AS n_tokens FROM t WHERE len(tokens) > 0""",
)
def sentence_tokens(spark, sf_dir):
    lines = texts(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    rows = corpus.sentences(lines, "line", T.edge_stripped, ("doc_id", "line_no"))
    return rows.select("doc_id", "line_no", sentence_line().alias("sentence"), F.size("tokens").alias("n_tokens"))


_PAIRS = f"""WITH t AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '{SPACE}'), lambda x: regexp_replace(regexp_replace(x, '^[^a-zA-Z]+|[^a-zA-Z0-9-]+$', '', 'g'), '[1-9]', '', 'g')), lambda x: true) AS w FROM documents),
r AS (SELECT unnest(list_zip(w[:-2], w[2:])) AS p FROM t WHERE len(w) > 1)
SELECT p[1] AS w1, p[2] AS w2, count(*) AS cnt FROM r WHERE p[1] <> '' AND p[2] <> '' GROUP BY ALL"""


@register("bigram_count", _PAIRS.replace("GROUP BY ALL", "GROUP BY ALL HAVING count(*) >= 5"))
def bigram_count(spark, sf_dir):
    """A blank word parts its neighbours: it isn't bridged."""
    rows = texts(spark, sf_dir).select(T.slots(F.col("text")).alias("tokens"))
    return corpus.pair_counts(rows, min_count=5)


@register(
    "phrase_entries",
    f"""WITH pairs AS ({_PAIRS}),
lex AS (SELECT '字' || lower(token) AS text, token AS code, count(*) AS weight FROM ({_stripped('documents')}) WHERE token <> '' GROUP BY token),
best AS (SELECT regexp_replace(code, '[1-9]', '', 'g') AS k, arg_min(text, {{'a': -weight, 'b': code}}) AS text, arg_min(code, {{'a': -weight, 'b': code}}) AS code FROM lex GROUP BY 1)
SELECT a.text || b.text AS hanlo, a.code || ' ' || b.code AS rime_key, max(trunc(500 * (1 + log10(1 + cnt) * 0.3)))::INTEGER AS weight
FROM pairs JOIN best a ON a.k = replace(w1, '-', ' ') JOIN best b ON b.k = replace(w2, '-', ' ') WHERE cnt >= 5 AND NOT EXISTS (SELECT 1 FROM lex WHERE lex.text = a.text || b.text AND lex.code = a.code || ' ' || b.code) GROUP BY 1, 2""",
)
def phrase_entries(spark, sf_dir):
    """Pairs of documents' words, with the documents' own words as lexicon. Texts are parted into words once, and the lexicon, which the operator reads three times, is made of these once."""
    slots = stored(texts(spark, sf_dir).select(T.slots(F.col("text")).alias("tokens")), "slots")
    pairs = corpus.pair_counts(slots, min_count=5)
    words = corpus.slot_counts(slots)
    lex = stored(words.select(F.concat(F.lit("字"), F.lower("word")).alias("hanlo"), F.col("word").alias("rime_key"), F.col("cnt").alias("weight"), F.col("word").alias("seq")), "lexicon")
    return phrases.phrase_entries(pairs, lex, match="toneless")


@register(
    "lighttone_weight",
    f"""WITH c AS (SELECT token AS word, count(*) AS cnt FROM ({_stripped('documents')}) WHERE token <> '' GROUP BY token),
r AS (SELECT word, cnt, CASE WHEN cnt % 3 = 0 THEN NULL ELSE 200 + cnt % 900 END AS plain, least(1500, greatest(300, trunc(300 + log10(1 + cnt) * 150)::BIGINT)) AS raw FROM c)
SELECT word, cnt, (CASE WHEN plain IS NULL THEN raw ELSE greatest(300, least(raw, plain - 100)) END)::BIGINT AS weight FROM r""",
)
def lighttone_weight(spark, sf_dir):
    counts = corpus.token_counts(texts(spark, sf_dir), "text", T.edge_stripped)
    plain = F.when(F.col("cnt") % 3 == 0, F.lit(None).cast("long")).otherwise(200 + F.col("cnt") % 900)
    return counts.select("word", "cnt", T.light_tone_weight(F.col("cnt"), plain).cast("long").alias("weight"))


_WORDS = (("the", "lo"), ("que", "lo"), ("tion", "han"), ("ung", "han"), ("é", "lo"))


@register(
    "contains_flags",
    "WITH w(word, kind) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _WORDS) + ") SELECT doc_id, coalesce(bool_or(contains(text, word) AND kind = 'han'), false) AS has_han, coalesce(bool_or(contains(text, word) AND kind = 'lo'), false) AS has_lo FROM documents, w GROUP BY doc_id",
)
def contains_flags(spark, sf_dir):
    """Flags by words of a fixed short list; as expressions over the row, so nothing is joined or shuffled."""
    has = lambda kind: F.coalesce(F.array_max(F.array(*(F.contains("text", F.lit(w)) for w, k in _WORDS if k == kind))), F.lit(False))
    return table(spark, sf_dir, "documents").select("doc_id", has("han").alias("has_han"), has("lo").alias("has_lo"))


@register("last_wins_map", "SELECT user_id, arg_max(event_type, {'a': ts, 'b': event_id}) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def last_wins_map(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", F.struct("ts", "event_id").alias("seq"))
    return lexicon.last_wins(rows, ["user_id"]).select("user_id", "event_type", "ts")


@register(
    "input_route",
    """WITH e AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN '?' || event_type WHEN 1 THEN ';' || event_type WHEN 2 THEN '~' || event_type WHEN 3 THEN 'vvjit' WHEN 4 THEN chr(96) || 'a' WHEN 5 THEN 'ab?c1' ELSE event_type END AS input FROM events)
SELECT CASE WHEN input IN ('vvh','vvjit','vvsp') THEN 'command' WHEN regexp_matches(input, '^[a-z]*\\?[a-z0-9]*$') THEN 'wildcard' WHEN regexp_matches(input, '^;[a-z0-9]*$') THEN 'phrase' WHEN starts_with(input, '~') THEN 'reverse' WHEN starts_with(input, chr(96)) THEN 'symbol' ELSE 'plain' END AS route, count(*) AS cnt FROM e GROUP BY 1""",
)
def input_route(spark, sf_dir):
    from lexspark.operators.lookup import route

    kind = F.col("event_id") % 7
    text = F.when(kind == 0, F.concat(F.lit("?"), "event_type")).when(kind == 1, F.concat(F.lit(";"), "event_type")).when(kind == 2, F.concat(F.lit("~"), "event_type")).when(kind == 3, F.lit("vvjit")).when(kind == 4, F.lit("`a")).when(kind == 5, F.lit("ab?c1")).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").groupBy(route(text).alias("route")).agg(F.count(F.lit(1)).alias("cnt"))
