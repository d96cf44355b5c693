"""Token and pair counts over corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import text as T


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by a key where it comes in fewer parts than there are cores, such as a small file of one row group; larger tables stay as they lie, so nothing of them is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def token_rows(lines: DataFrame, column: str = "line", tokens=T.tokens) -> DataFrame:
    """(token): one row per token of a text column. Words are exploded first and chosen as plain columns, which compiles; a lambda over an array doesn't."""
    if tokens is not T.tokens:
        return lines.select(F.explode(tokens(F.col(column))).alias("token"))
    return lines.select(F.explode(T.edge_stripped(F.col(column))).alias("token")).where(T.is_token(F.col("token")))


def token_counts(lines: DataFrame, column: str = "line", tokens=T.tokens) -> DataFrame:
    """(word, cnt); partial counts are made before the shuffle, so frequent words don't weigh on one task."""
    return token_rows(lines, column, tokens).groupBy(F.col("token").alias("word")).agg(F.count(F.lit(1)).alias("cnt"))


def slot_counts(slots: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(word, cnt) of arrays of slots: token_counts of all words with a letter, without parting the texts again."""
    rows = slots.select(F.explode(tokens).alias("word")).where("word <> ''")
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


def merged_counts(*tables: DataFrame) -> DataFrame:
    """(word, cnt) summed over frequency tables."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("word").agg(F.sum("cnt").alias("cnt"))


def sentences(lines: DataFrame, column: str = "line", tokens=T.tokens, keep: tuple[str, ...] = ()) -> DataFrame:
    """(tokens), behind the columns to keep, of lines that have any. A condition on a generated column isn't pushed below it, so tokens are made once."""
    rows = lines.where(F.col(column).rlike("[a-zA-Z]")) if tokens in (T.tokens, T.edge_stripped) else lines
    if tokens is T.edge_stripped:  # a letter makes a word
        return rows.select(*keep, tokens(F.col(column)).alias("tokens"))
    return rows.select(*keep, F.explode(F.array(tokens(F.col(column)))).alias("tokens")).where("size(tokens) > 0")


def pair_counts(sentences_: DataFrame, tokens: str = "tokens", min_count: int = 1) -> DataFrame:
    """(w1, w2, cnt) of neighbouring tokens, tones dropped; a blank token parts its neighbours and pairs with none.

    Tones are dropped from all tokens of a row at once, put together by a line break, which no token holds; each array is then paired with itself, one place on, so nothing is shuffled but the counts.
    """
    joined = F.translate(F.array_join(tokens, "\n", ""), "123456789", "")
    t = sentences_.select(F.split(joined, "\n", -1).alias("t"))
    rows = t.select(F.explode(F.arrays_zip(F.expr("slice(t, 1, greatest(size(t) - 1, 0))").alias("w1"), F.expr("slice(t, 2, greatest(size(t) - 1, 0))").alias("w2"))).alias("p"))
    rows = rows.select("p.w1", "p.w2").where("w1 <> '' AND w2 <> ''")
    return rows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") >= min_count)


def pairs_by_position(rows: DataFrame, key: str, position: str, token: str) -> DataFrame:
    """(w1, w2) from one row per token: the same pairs by a window, for tokens that aren't in arrays."""
    after = F.lead(token).over(Window.partitionBy(key).orderBy(position))
    return rows.select(F.col(token).alias("w1"), after.alias("w2")).where("w1 <> '' AND w2 <> ''")


def summary(counts: DataFrame) -> DataFrame:
    """(unique_words, total_tokens)."""
    return counts.agg(F.count(F.lit(1)).alias("unique_words"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("total_tokens"))
