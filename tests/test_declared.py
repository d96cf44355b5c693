import pytest
from pyspark.sql import functions as F

from lexspark.operators import candidates
from lexspark.plans import declared

SCHEMA = """
name: x
engine:
  processors:
    - lua_processor@*any_input
  translators:
    - echo_translator
    - script_translator
    - reverse_lookup_translator   # by ~
    - table_translator@custom
    - lua_translator@*any_help
    - lua_translator@*any_date
    - lua_translator@*any_symbols
    - lua_translator@*any_wildcard
    - lua_translator@*any_phrase
    - lua_translator@*any_speedup
  filters:
    - lua_filter@*any_lighttone
    - lua_filter@*any_filter
    - lua_filter@*any_lookup
    - lua_filter@*any_recommend
    - lua_filter@*any_synonym
    - lua_filter@*any_long_word
    - reverse_lookup_filter@any_reverse_lookup
    - lua_filter@*any_reverse_format
    - simplifier@emoji
    - uniquifier
speller:
  filters:
    - uniquifier
"""


@pytest.fixture(scope="module")
def tables(spark):
    lexicon = spark.createDataFrame([("食", "tsiah8", 900), ("食飯", "tsiah8 png7", 700), ("飯", "png7", 500), ("好", "ho2", 400), ("豪", "ho5", 100)], "hanlo string, rime_key string, weight int")
    reverse = spark.createDataFrame([("吃", "chi", "tsiah8", 500), ("痴", "chi", "tshi1", 300), ("飯", "fan", "png7", 300)], "hanlo string, rime_key string, reading string, weight int")
    rules = spark.createDataFrame([("lai", "來", 1)], "tail string, hanzi string, seq int")
    words = spark.createDataFrame([("食", "han"), ("beh", "lo")], "word string, type string")
    return {"lexicon": lexicon, "reverse": reverse, "light_rules": rules, "lo_words": spark.createDataFrame([("好",)], "word string"), "recommended": words}


def test_the_schema_gives_the_chain_in_its_order(spark, tables, tmp_path):
    (tmp_path / "s.yaml").write_text(SCHEMA)
    chain = declared.read_schema(spark, f"file://{tmp_path}/s.yaml")
    assert chain.translators == ["script_translator", "reverse_lookup_translator", "help", "date", "symbols", "wildcard", "phrase", "speedup"]
    assert chain.filters == ["lighttone", "filter", "lookup", "recommend", "synonym", "long_word", "reverse_format", "uniquifier"]
    assert chain.unknown == ["echo_translator", "table_translator@custom", "reverse_lookup_filter@any_reverse_lookup", "simplifier@emoji"]
    data = [(1, 1, "食", " [tsiah8]", 1.0), (1, 2, "轉來", " [tng2 lai5]", 1.0), (1, 3, "食", " [tsiah8]", 0.5), (1, 4, "好食", " [ho2 tsiah8]", 1.0), (1, 5, "長詞語", " [a b c]", 1.0)]
    df = spark.createDataFrame(data, "query_id int, pos int, text string, comment string, quality double")
    for mode in (0, 1):
        context = declared.Context(tables, {"mode": mode})
        got = sorted(map(tuple, declared.filtered(chain, context, df).collect()))
        want = sorted(map(tuple, candidates.chain(df, tables["light_rules"], tables["lo_words"], tables["recommended"], mode).collect()))
        assert got == want and len(got) > 4


def test_inputs_go_to_their_translators(spark, tables):
    chain = declared.declared(SCHEMA.splitlines())
    inputs = [(1, "tsiah8"), (2, "tsiah"), (3, "~chi"), (4, "vvh"), (5, "`"), (6, ";png"), (7, "vvjit"), (8, "nothing"), (9, "~none"), (10, ";zz")]
    queries = spark.createDataFrame(inputs, "query_id int, input string")
    got = {}
    for r in declared.composed(declared.Declared(chain.translators, ["uniquifier"], []), declared.Context(tables, {"day": "2024-05-06"}), queries).orderBy("query_id", "pos").collect():
        got.setdefault(r.query_id, []).append((r.text, r.comment))
    assert got[1] == [("食", " [tsiah8]")] and got[2] == [("食", " [tsiah8]")]
    assert got[3] == [("吃", " [tsiah8]"), ("痴", " [tshi1]")]
    assert len(got[4]) == 12 and len(got[5]) == 21 and got[6][0][0] == "飯" and got[10] == [("", "")]
    assert any("2024-05-06" in t for t, _ in got[7]) and 8 not in got and 9 not in got


def test_a_filter_of_the_users_own(spark, tables):
    name = "shout"
    try:
        declared.filter_(name)(lambda context, df: df.withColumn("text", F.concat("text", F.lit("!"))))
        chain = declared.declared(["engine:", "  translators:", "    - script_translator", "  filters:", f"    - lua_filter@*my_{name}"])
        queries = spark.createDataFrame([(1, "ho2")], "query_id int, input string")
        assert [r.text for r in declared.composed(chain, declared.Context(tables), queries).collect()] == ["好!"]
        with pytest.raises(ValueError):
            declared.filter_(name)(lambda context, df: df)
    finally:
        declared.FILTERS.pop(name, None)
    with pytest.raises(ValueError):
        declared.composed(chain, declared.Context(tables), queries)


def test_look_ups_in_sql(spark, tables):
    declared.sql_functions(spark, tables["lexicon"], tables["reverse"])
    assert [r.hanlo for r in spark.sql("SELECT * FROM code_entries('ho2')").collect()] == ["好"]
    spark.createDataFrame([("tsiah",), ("ho",), ("zz",)], "input string").createOrReplaceTempView("asked")
    joined = spark.sql("SELECT input, hanlo FROM asked, LATERAL spelling_entries(input)")
    assert sorted(map(tuple, joined.collect())) == [("ho", "好"), ("ho", "豪"), ("tsiah", "食")]
    assert {tuple(r) for r in spark.sql("SELECT hanlo, reading FROM reverse_entries('chi')").collect()} == {("吃", "tsiah8"), ("痴", "tshi1")}
    assert "CartesianProduct" not in joined._jdf.queryExecution().executedPlan().toString()
