import random

from lexspark.operators import lookup, prefix_index


def test_index_equals_the_ranked_slices(spark, tmp_path):
    rng = random.Random(4)
    rows = [("".join(rng.choice("ab é食") for _ in range(rng.randint(0, 6))), f"t{i}", rng.randint(0, 9), i) for i in range(700)]
    lexicon = spark.createDataFrame(rows, "rime_key string, hanlo string, weight int, more int")
    path = f"file://{tmp_path}/index"
    assert prefix_index.build(lexicon, path, 20) == 6
    inputs = sorted({r[0][:n] for r in rows for n in range(1, 7) if r[0][:n]})[:200] + ["zz", "aaaaaaaaa"]
    queries = spark.createDataFrame(list(enumerate(inputs)), "query_id long, input string")
    pick = lambda df: sorted((r.query_id, r.pos, r.rime_key, r.hanlo, r.weight, r.more) for r in df.collect())
    got = pick(prefix_index.look_up(queries, path))
    assert got == pick(lookup.prefix(queries, lexicon, 20)) and len(got) > 400
    assert prefix_index.look_up(queries.where("input = 'zz'"), path).count() == 0


def test_a_one_letter_look_up_reads_its_rows_alone(spark, tmp_path):
    lexicon = spark.range(5000).selectExpr("concat(char(97 + id % 26), lpad(id, 5, '0')) AS rime_key", "cast(id AS string) AS hanlo", "id % 1000 AS weight")
    path = f"file://{tmp_path}/index"
    prefix_index.build(lexicon, path)
    one = prefix_index.entries(spark, path, ["k"])
    assert one.count() == 100
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(len" in plan and "PushedFilters: [" in plan and "EqualTo(prefix,k)" in plan
    assert spark.read.parquet(f"{path}/prefixes/len=1").count() == 26 * 100


def test_empty_lexicon(spark, tmp_path):
    lexicon = spark.createDataFrame([], "rime_key string, hanlo string, weight int")
    assert prefix_index.build(lexicon, f"file://{tmp_path}/none") == 0
