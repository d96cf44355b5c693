import random

from pyspark.sql import functions as F

from lexspark.operators import snapshots

DDL = "word string, source string, cnt long"


def weights(df):
    return df.groupBy("word").agg(F.sum("cnt").alias("cnt"), F.count_distinct("source").alias("sources"), F.min("source").alias("first"))


def made(rng, n):
    return [(f"w{rng.randrange(n // 4)}", rng.choice("abc"), rng.randrange(50)) for _ in range(n)]


def test_a_rebuild_of_changed_buckets_equals_a_full_build(spark, tmp_path):
    rng = random.Random(1)
    rows = made(rng, 2000)
    at = lambda name: f"file://{tmp_path}/{name}"
    like = spark.createDataFrame([], DDL)
    snapshots.write(spark.createDataFrame(rows, DDL), at("s1"), ["word"], 64)
    first = snapshots.rebuild(like, at("none"), at("s1"), at("out"), weights, ["word"], 64)
    want = lambda r: sorted(map(tuple, weights(spark.createDataFrame(r, DDL)).collect()))
    assert sorted(map(tuple, first.collect())) == want(rows)
    words = sorted({r[0] for r in rows})
    gone, changed = set(words[:2]), set(words[5:8])
    later = [r for r in rows if r[0] not in gone] + [(w, "d", 7) for w in changed] + [("new", "a", 1)]
    random.Random(2).shuffle(later)
    snapshots.write(spark.createDataFrame(later, DDL), at("s2"), ["word"], 64)
    found = snapshots.differing(spark, at("s1"), at("s2"))
    touched = {r["_bucket"] for r in snapshots.bucketed(spark.createDataFrame([(w,) for w in gone | changed | {"new"}], "word string"), ["word"], 64).collect()}
    assert set(found) == touched and len(found) <= 6
    kept = {p.name: [f.name for f in p.iterdir()] for p in (tmp_path / "out").glob("_bucket=*") if int(p.name.split("=")[1]) not in touched}
    second = snapshots.rebuild(like, at("s1"), at("s2"), at("out"), weights, ["word"], 64)
    assert sorted(map(tuple, second.collect())) == want(later)
    assert kept == {n: [f.name for f in (tmp_path / "out" / n).iterdir()] for n in kept}  # other buckets weren't touched
    plan = weights(snapshots.rows(spark, at("s2"), like).where(F.col("_bucket").isin(found)).drop("_bucket"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_bucket" in plan


def test_nothing_changed_and_everything_gone(spark, tmp_path):
    at = lambda name: f"file://{tmp_path}/{name}"
    like = spark.createDataFrame([], DDL)
    rows = [("a", "x", 1), ("a", "x", 1), ("b", None, None), (None, "y", 2)]
    snapshots.write(spark.createDataFrame(rows, DDL), at("s1"), ["word"], 8)
    snapshots.write(spark.createDataFrame(rows[::-1], DDL), at("s2"), ["word"], 8)
    assert snapshots.differing(spark, at("s1"), at("s2")) == []
    assert snapshots.differing(spark, at("none"), at("s1")) != []
    out = snapshots.rebuild(like, at("none"), at("s1"), at("out"), weights, ["word"], 8)
    assert out.count() == 3
    snapshots.write(like, at("s3"), ["word"], 8)
    assert snapshots.rebuild(like, at("s1"), at("s3"), at("out"), weights, ["word"], 8).count() == 0


def test_a_repeated_row_is_a_difference(spark, tmp_path):
    at = lambda name: f"file://{tmp_path}/{name}"
    snapshots.write(spark.createDataFrame([("a", "x", 1)], DDL), at("s1"), ["word"], 8)
    snapshots.write(spark.createDataFrame([("a", "x", 1)] * 2, DDL), at("s2"), ["word"], 8)
    assert len(snapshots.differing(spark, at("s1"), at("s2"))) == 1
