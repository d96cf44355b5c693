import random
import time

from pyspark.sql import functions as F

from lexspark.operators import candidates, contains


def brute(texts, words):
    return {(i, t): sorted({w for w in words if w and t and w in t}) for i, t in texts}


def test_words_that_texts_contain(spark, monkeypatch):
    rng = random.Random(1)
    words = ["".join(rng.choice("ab食é😀") for _ in range(rng.randint(1, 5))) for _ in range(300)] + ["", None, "aa", "aa", "a--b"]
    texts = [(i, "".join(rng.choice("abc食é😀-") for _ in range(rng.randint(0, 40)))) for i in range(80)] + [(80, None), (81, ""), (82, "ab食" * 5000)]
    df = spark.createDataFrame(texts, "id int, text string")
    table = spark.createDataFrame([(w, "odd" if w and len(w) % 2 else None) for w in words], "word string, kind string")
    want = brute(texts, words)
    for limit in (1 << 20, 50):  # one automaton, and several
        monkeypatch.setattr(contains, "WORDS", limit)
        found = contains.WordList(table, "word", "kind")
        assert (len(found.parts) == 1) == (limit > 300)
        rows = df.select("id", "text", found.found(F.col("text")).alias("w"), found.tags(F.col("text")).alias("t")).collect()
        assert {(r.id, r.text): r.w for r in rows} == want
        assert all(r.t == (["odd"] if any(len(w) % 2 for w in r.w) else []) for r in rows)
        joined = contains.contains_join(df, table).groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()
        assert {r.id: r.n for r in joined} == {i: len(w) for (i, _), w in want.items() if w}
    assert df.select(contains.WordList(table.where("false")).found(F.col("text")).alias("w")).where("size(w) > 0").count() == 0


def test_ten_thousand_words_over_documents(spark, small="/root/testdata/sf0.01"):
    """Time follows the text, not the number of words."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    tokens = docs.select(F.explode(F.split("text", r"\s+")).alias("word")).where("length(word) > 5").distinct().orderBy(F.xxhash64("word")).limit(10_000)
    words = [r.word for r in tokens.collect()]
    took = {}
    for n in (100, len(words)):
        table = spark.createDataFrame([(w,) for w in words[:n]], "word string")
        began = time.perf_counter()
        got = {r.doc_id: r.w for r in docs.select("doc_id", contains.WordList(table).found(F.col("text")).alias("w")).collect()}
        took[n] = time.perf_counter() - began
    assert len(words) == 10_000 and took[len(words)] < 20 * took[100] + 20
    for r in docs.where("doc_id % 97 = 0").collect():
        assert got[r.doc_id] == sorted({w for w in words if w in (r.text or "")})


def test_rule_hits_hold_the_segments_alone(spark):
    rng = random.Random(2)
    words = spark.createDataFrame([("".join(rng.choice("甲乙丙丁") for _ in range(rng.randint(1, 3))),) for _ in range(40)] + [("食飯",), ("食",)], "word string")
    texts = spark.createDataFrame([("食飯",), ("食飯",), ("甲--乙丙",), ("",), (None,), ("none",), ("好食--飯",)], "text string")
    known = {r.word for r in words.collect()}
    got = {r.text: set(r._lo) for r in candidates.rule_hits(texts, words).collect()}
    for text in ("食飯", "甲--乙丙", "好食--飯", "none"):
        parts = {text.replace("--", ""), *text.split("--"), *text.replace("--", "")}
        assert got.get(text, set()) == parts & known
    plan = candidates.rewritten(texts.selectExpr("1 AS query_id", "1 AS pos", "text", "' [a b]' AS comment", "1.0D AS quality"), words)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
