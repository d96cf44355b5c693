"""Operators and functions on rows with known answers."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators import candidates, corpus, glossmap, lexicon, lighttone, lookup, phrases
from lexspark.plans import registry
from lexspark.streaming import counts, sessions


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def nfd(x):
    import unicodedata

    return None if x is None else unicodedata.normalize("NFD", x)


@pytest.mark.parametrize(
    ("function", "given", "expected"),
    [
        (T.implicit_tone, "sian7-neh", "sian7-neh4"),
        (T.strip_final_tones, "tua7-lang5", "tua-lang"),
        (T.strip_all_tones, "tsiah8-png7", "tsiah-png"),
        (T.code_to_key, "to3-tng2--lai5", "to3 tng2  lai5"),
        (T.key_to_code, "to3 tng2  lai5", "to3-tng2--lai5"),
        (T.numbered, "tām-po̍h-á", "tam7-poh8-a2"),
        (T.numbered, "tsi", "tsi"),
        (T.numbered_all, "kan-na", "kan1-na1"),
        (T.numbered_all, "Guá  beh, khì.", "gua2 beh1, khi3."),
        (T.marks_to_digits, "lâng", "la5ng"),
        (T.tl_to_poj_words, "tshit sing sik kua kue", "chhit seng sek koa koe"),
        (T.tl_to_poj, "sing5", "seng5"),
        (T.tl_to_poj_words, "sing5", "sing5"),
        (T.poj_to_tl, "Chit siⁿ o͘ kou chiah-png", "tsit sinn oo koo tsiah-png"),
        (T.marked, "gua2", "guá"),
        (T.marked, "ui7", "uī"),
        (T.marked, "nng7", "nn̄g"),
        (T.marked, "tng2--lai5", "tńg--lâi"),
        (T.poj_marks, "goā", "gōa"),
        (T.poj_marks, "koán", "koán"),
        (T.capitalised, "gua2", "Gua2"),
        (T.capitalised, "ê", "ê"),
        (T.abbreviation, "tshit8", "tsh"),
        (T.bracketed, " [a b] [c]", "a b"),
        (T.half_width, "「食。」！", '"食."!'),
        (T.rule_type, "ā好", "han"),
        (T.rule_type, "beh", "lo"),
        (T.first_code, "tsit8(替)/it4", "tsit8"),
        (T.first_code, "Tsit8", None),
        (T.strip_tones_before_breaks, "tsiah8-png7 a1b", "tsiah-png a1b"),
        (T.strip_marks, "tām-ı", "tam-i"),
    ],
)
def test_text_functions(spark, function, given, expected):
    given = nfd(given) if function in (T.poj_marks, T.strip_marks) else given  # these know decomposed letters alone
    assert nfd(one(spark, function(F.lit(given)))) == nfd(expected)


@pytest.mark.parametrize(
    ("function", "given", "expected"),
    [
        (T.code_variants, "tsit8(替)/it4", ["tsit8", "it4"]),
        (T.code_variants, "kong2--e5", ["kong2--e5"]),
        (T.code_variants, "  ", []),
        (T.tokens, "gua2, beh4.", ["gua2", "beh4"]),
        (T.tokens, "(gua2) beh M 漢a2字 --x3-", ["gua2", "M", "a2", "x3-"]),
        (T.edge_stripped, " 12 ab1! .c-　d", ["ab1", "c-", "d"]),
        (T.slots, "a 12 b! -- c", ["a", "", "b", "", "c"]),
        (T.slots, "", []),
        (T.marked_tokens, "Guá beh khì.", ["Guá", "khì"]),
        (T.marked_tokens, "gua2 khì", ["gua2"]),
        (T.gloss_words, "吃飯、用餐(文)", ["吃飯", "用餐"]),
    ],
)
def test_array_functions(spark, function, given, expected):
    assert [nfd(x) for x in one(spark, function(F.lit(given)))] == [nfd(x) for x in expected]


def test_weights(spark):
    assert [one(spark, T.length_modifier(F.lit(x))) for x in ("食", "食飯", "食飯啊", "食飯啊啊啊", "ā好", "beh")] == [0.8, 1.2, 1.2, 0.6, 0.8, 1.0]
    assert [one(spark, T.source_weight(F.lit(x))) for x in ("moe", "itaigi", "taihoa", "taijit", "unknown")] == [1000, 800, 500, 200, 100]
    assert one(spark, T.phrase_weight(F.lit(10))) == int(500 * (1 + math.log10(11) * 0.3))
    assert [one(spark, T.light_tone_weight(F.lit(c), F.lit(p).cast("int"))) for c, p in ((10000, 500), (10000, 350), (100, None))] == [400, 300, 600]


def test_light_marks_in_texts(spark):
    for text, n, expected in (("倒轉來", 2, "倒轉--來"), ("食飽", 1, "食--飽"), ("起來去", 1, "起--來去"), ("beh去", 1, "beh去"), ("beh-去", 1, "beh---去"), ("食", 3, "食")):
        assert one(spark, T.with_light_mark(F.lit(text), F.lit(n))) == expected, text
    syllables = F.array(F.lit("tng2"), F.lit("lai5"), F.lit("khi3"))
    assert one(spark, T.marked_key(syllables, F.lit(2))) == "tng2--lai5 khi3" and one(spark, T.marked_key(syllables, F.lit(3))) is None
    assert one(spark, T.marked_after(F.lit("食飯"), F.lit(1))) == "食--飯" and one(spark, T.marked_after(F.lit("食飯"), F.lit(2))) is None


def test_display(spark):
    both = nfd(one(spark, T.both_spellings(F.lit("tsia̍h-pn̄g"))))
    assert both == nfd("[TL:tsia̍h-pn̄g POJ:chia̍h-pn̄g]") and one(spark, T.both_spellings(F.lit("lâi"))) == "[lâi]"
    assert nfd(one(spark, T.roman_of(F.lit(" [tsiah8 png7]"), False))) == nfd("tsia̍h-pn̄g")
    assert nfd(one(spark, T.roman_of(F.lit(" [tsiah8 png7]"), True))) == nfd("chia̍h-pn̄g")
    assert nfd(one(spark, T.roman_of(F.lit("[TL:gua2 POJ:goa2]"), True))) == nfd("goá")
    assert nfd(one(spark, T.readings(F.lit("gua2(note) beh4"), False))) == nfd("guá(note) beh") and one(spark, T.readings(F.lit("no digits"), False)) == "no digits"
    day = F.lit(datetime.date(2024, 3, 9))
    assert (one(spark, T.date_han(day)), one(spark, T.weekday_roman(day))) == ("2024年3月9日 拜六", "Pài-la̍k")


def rows(spark, data, ddl):
    return spark.createDataFrame(data, ddl)


def test_pairs_and_phrases(spark):
    lines = rows(spark, [("gua2 beh4 khi3",)], "line string")
    pairs = corpus.pair_counts(corpus.sentences(lines))
    assert {(r.w1, r.w2): r.cnt for r in pairs.collect()} == {("gua", "beh"): 1, ("beh", "khi"): 1}
    flat = rows(spark, [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "d")], "k int, at int, t string")
    assert sorted(tuple(r) for r in corpus.pairs_by_position(flat, "k", "at", "t").collect()) == [("a", "b"), ("b", "c")]
    lex = rows(spark, [("我", "gua", 500, 1), ("挖", "gua", 900, 2), ("欲", "beh", 300, 3), ("挖欲", "gua beh", 1, 4)], "hanlo string, rime_key string, weight int, seq int")
    many = rows(spark, [("gua", "beh", 10), ("beh", "gua", 10), ("beh", "beh", 3), ("gua", "none", 50)], "w1 string, w2 string, cnt long")
    got = [tuple(r) for r in phrases.phrase_entries(many, lex).collect()]
    assert got == [("欲挖", "beh gua", int(500 * (1 + math.log10(11) * 0.3)))]
    toned = rows(spark, [("我", "gua2", 500, 1), ("欲", "beh4", 300, 2)], "hanlo string, rime_key string, weight int, seq int")
    assert phrases.phrase_entries(many, toned).collect() == []
    assert {r.rime_key for r in phrases.phrase_entries(many, toned, match="toneless").collect()} == {"gua2 beh4", "beh4 gua2"}


def test_lexicon_merges_sources(spark):
    entries = rows(spark, [("食飯", "tsiah8-png7", "tsiah8 png7", "", "taihoa", 2), ("食飯", "tsiah8-png7", "tsiah8 png7", "x", "itaigi", 5), ("食飯", "tsiah8-png7", "tsiah8 png7", "", "itaigi", 9)], "hanlo string, kip_input string, rime_key string, hoabun string, source string, seq int")
    assert [(r.weight, r.source, r.seq) for r in lexicon.weighted(entries).collect()] == [(1056, "itaigi", 5)]
    assert [(r.weight, r.seq) for r in lexicon.weighted(entries.where("source = 'itaigi'")).collect()] == [(960, 5)]
    lex = rows(spark, [("a", "k", 500, 1), ("b", "k", 800, 2), ("c", "k", 300, 3)], "hanlo string, rime_key string, weight int, seq int")
    assert [e.weight for e in lexicon.reverse_index(lex).first().entries] == [800, 500, 300]


def test_light_words_and_entries(spark):
    words = rows(spark, [("Tng2--lai5", 3), ("tng2--lai5", 2), ("a--", 1), ("b(c--d", 1), ("a2--lai5--a2", 9), ("x--y--z", 4)], "word string, cnt long")
    found = lighttone.ordered_light_words(words)
    assert [tuple(r) for r in found.collect()] == [("a2--lai5--a2", 9), ("tng2--lai5", 5), ("x--y--z", 4)]
    lex = rows(spark, [("轉來", "tng2 lai5", 700), ("仔", "a2", 100)], "hanlo string, rime_key string, weight int")
    rules = rows(spark, [("lâi", "來", "補語", 1), ("lâi", "別", "補語", 2)], "tl string, hanzi string, rule string, seq int")
    assert sorted(tuple(r) for r in lighttone.found_texts(found, lex, rules).collect()) == [("a2--lai5--a2", "仔--來--仔"), ("tng2--lai5", "轉--來")]
    got = {r.hanlo: (r.rime_key, r.weight) for r in lighttone.light_tone_entries(words, lex, rules).collect()}
    assert got == {"轉--來": ("tng2  lai5", int(300 + math.log10(6) * 150)), "仔--來--仔": ("a2  lai5  a2", int(300 + math.log10(10) * 150))}
    there = lex.unionByName(rows(spark, [("轉--來", "tng2  lai5", 1)], "hanlo string, rime_key string, weight int"))
    assert {r.hanlo for r in lighttone.light_tone_entries(words, there, rules).collect()} == {"仔--來--仔"}
    long_word = "--".join(["a2"] * 150)
    assert lighttone.found_texts(rows(spark, [(long_word, 1)], "word string, cnt long"), lex, rules).first().hanlo == "--".join(["仔"] * 150)


def test_gloss_map(spark):
    data = [("吃飯", "tsiah8-png7", 2, "食飯", 1), ("用餐、吃飯", "iong7-tshan1", 3, "用餐", 2), ("吃", "tsiah8", 3, "食", 3)]
    got = {r.mandarin: r.kip for r in glossmap.gloss_map(rows(spark, data, "hoabun string, kip string, priority int, hanlo string, seq int")).collect()}
    assert got == {"吃飯": "tsiah8 png7", "用餐": "iong7 tshan1", "吃": "tsiah8", "飯": "png7", "用": "iong7", "餐": "tshan1"}


def test_lookups(spark):
    lex = rows(spark, [("食", "tsiah8", 9, 1), ("石", "tsioh8", 5, 2), ("食飯", "tsiah8 png7", 7, 3), ("即", "tsiah4", 1, 4)], "hanlo string, rime_key string, weight int, seq int")
    ask = lambda *x: rows(spark, list(enumerate(x)), "query_id int, input string")
    assert [(r.hanlo, r.pos) for r in lookup.exact(ask("tsiah8", "no"), lex).collect()] == [("食", 1)]
    assert [r.hanlo for r in lookup.prefix(ask("t"), lex).orderBy("pos").collect()] == ["食", "食飯", "石", "即"]
    assert {r.hanlo for r in lookup.fuzzy(ask("chiah"), lookup.spellings(lex)).collect()} == {"食", "即"}
    assert [r.hanlo for r in lookup.fuzzy(ask("tsiah png"), lookup.spellings(lex)).collect()] == ["食飯"]
    assert {(r.input, r.hanlo) for r in lookup.phrase(ask(";tsi", ";zz", "tsi"), lex).collect()} == {("tsi", "食"), ("tsi", "石"), ("tsi", "即"), ("zz", None)}
    glosses = rows(spark, [("吃", "tsiah8"), ("食", "x")], "mandarin string, kip string")
    coded = lookup.codes_of(rows(spark, [("食",), ("吃",), ("無",)], "text string"), lex, glosses)
    assert {r.text: r.code for r in coded.collect()} == {"食": "tsiah8", "吃": "tsiah8", "無": None}
    assert [(r.text, r.hanlo) for r in lookup.homophones(rows(spark, [("吃",), ("食",)], "text string"), lex, glosses, lex).collect()] == [("吃", "食")]
    static = {}
    for r in lookup.static_rows(ask("vvh", "vvsp", "`", "`x", "vv")).orderBy("query_id", "seq").collect():
        static.setdefault(r.query_id, []).append((r.text, r.comment))
    assert {k: len(v) for k, v in static.items()} == {0: 12, 1: 21, 2: 21, 3: 21}
    assert static[1][0] == ("p-", "p   → 波 (p)") and static[1][13] == ("tsh-", "tsh → 出 (tsh/chh)") and static[0][9] == ("vvh", "本說明") and static[2][0] == ("á", "第二聲 (TL)")
    dates = lookup.dates(ask("vvjit", "x"), F.lit(datetime.date(2024, 3, 9))).orderBy("seq").collect()
    assert [r.text for r in dates] == ["2024年3月9日 拜六", "Pài-la̍k", "2024-03-09"]
    rules = rows(spark, [("lâi", "來", "補語", 1), ("khì", "去", "不處理", 2), ("tit", "得", "分", 3)], "tl string, hanzi string, rule string, seq int")
    assert {r.tail for r in lookup.toneless_rules(rules, fixed=True).collect()} == {"lai", "tit"}
    assert "tit" in {r.tail for r in lookup.toneless_rules(rules).collect()}


CANDIDATE = "query_id int, pos int, text string, comment string, quality double"


def test_core_filter(spark):
    data = [(1, 1, "食飯", " [tsiah8 png7]", 1.0), (1, 2, "ê", " [e5]", 1.0), (1, 3, "我欲去", " [gua2 beh4 khi3]", 1.0), (1, 4, "plain", None, 1.0), (1, 5, "轉--來", " [tng2 lai5]", 1.0)]
    df = rows(spark, data, CANDIDATE)
    by = lambda d: {r.pos: (nfd(r.text), nfd(r.comment), round(r.quality, 3)) for r in d.collect()}
    rules = rows(spark, [("ê", "lo"), ("欲", "lo"), ("食", "han")], "word string, type string")
    for lo in (["ê", "欲"], candidates.lo_words_of(rules)):
        got = by(candidates.rewritten(df, lo))
        assert got[1] == ("食飯", nfd(" [tsia̍h-pn̄g]"), 1.5)
        assert got[2] == (nfd("ê"), nfd(" [ê]"), 6.5)  # a mark is a character of its own
        assert got[3] == (nfd("我beh去"), nfd(" [guá-beh-khì]"), 7.0)
        assert got[4] == ("plain", None, 2.0)
        assert got[5] == (nfd("轉--來"), nfd(" [tńg--lâi]"), 1.5)
    full = by(candidates.rewritten(df, ["ê", "欲"], 2))
    assert full[3][2] == 2.0 and full[1][2] == 1.5 and full[2][2] == 1.0 and full[4][2] == 1.0
    assert by(candidates.rewritten(df, [], 1))[1][1] == nfd(" [chia̍h-pn̄g]")


def test_filter_chain(spark):
    data = [(1, 1, "食", " [tsiah8]", 1.0), (1, 2, "轉來", " [tng2 lai5]", 1.0), (1, 3, "食", " [tsiah8]", 0.5), (1, 4, "好食", " [ho2 tsiah8]", 1.0), (1, 5, "長詞語", " [a b c]", 1.0), (1, 6, "乙", " [it4]", 1.0)]
    df = rows(spark, data, CANDIDATE)
    rules = rows(spark, [("lai", "來", 1)], "tail string, hanzi string, seq int")
    words = rows(spark, [("食", "han"), ("beh", "lo")], "word string, type string")
    got = candidates.chain(df, rules, [], words).orderBy("pos").collect()
    texts = [r.text for r in got]
    assert len(texts) == len(set(texts)) == 6 and texts[:3] == ["食", "轉來", "轉--來"]
    assert "◆" in got[0].comment and {r.text for r in got if "◆" in (r.comment or "")} == {"食", "好食"}
    assert candidates.synonyms(df) is df and candidates.recommended(df, words, enabled=False) is df
    both = {r.pos: nfd(r.comment) for r in candidates.with_both_spellings(rows(spark, [(1, 1, "x", " [tsiah]", 1.0), (1, 2, "y", "no", 1.0)], CANDIDATE)).collect()}
    assert both == {1: " [TL:tsiah POJ:chiah]", 2: "no"}
    shown = candidates.formatted_readings(rows(spark, [(1, 1, "x", "gua2 beh4", 1.0)], CANDIDATE)).first()
    assert nfd(shown.comment) == nfd("guá beh")
    merged = candidates.merged(rows(spark, [(1, 1, "b", "", 1.0)], CANDIDATE), rows(spark, [(1, 1, "a", "", 1.0), (1, 2, "c", "", 1.0)], CANDIDATE)).orderBy("pos")
    assert [(r.text, r.pos) for r in merged.collect()] == [("b", 1), ("a", 2), ("c", 3)]


EVENTS = "session_id long, seq long, kind string, composing boolean, menu boolean, full_roman boolean, has_code boolean, text string"
TYPED = [
    (1, 1, "letter", True, True, True, False, "食", (True, False, None)),
    (1, 2, "space", True, True, True, False, "食", (False, False, "食")),
    (1, 3, "apostrophe", False, False, True, False, "", (False, False, "食")),
    (1, 4, "apostrophe", False, False, True, True, "", (False, False, None)),
    (1, 5, "tab", True, True, True, False, "", (False, True, None)),
    (1, 6, "nav", True, True, True, False, "", (False, True, None)),
    (1, 7, "release", True, True, True, False, "", (False, True, None)),
    (1, 8, "select", True, True, True, False, "食飯", (False, False, None)),
    (1, 9, "punct", False, False, True, False, ".", (True, False, None)),
    (1, 10, "punct", True, True, True, False, ",", (False, False, None)),
    (1, 11, "shift_letter", False, False, False, False, "", (True, False, None)),
    (2, 1, "select", True, True, False, False, "人", (True, False, "人")),
    (2, 2, "other", False, False, False, False, "", (True, False, None)),
]


def test_session_states_and_stream(spark, tmp_path):
    df = rows(spark, [r[:-1] for r in TYPED], EVENTS)
    want = {r[:2]: r[-1] for r in TYPED}
    got = {(r.session_id, r.seq): (r.capitalise_next, r.selecting, r.last_text) for r in sessions.session_states(df).collect()}
    assert got == want
    for k, part in enumerate((df.where("seq < 6"), df.where("seq >= 6"))):  # the state is kept between micro-batches
        part.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/events/{k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/events")
    run = sessions.session_stream(stream).writeStream.format("memory").queryName("session_states").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(r.session_id, r.seq): (r.capitalise_next, r.selecting, r.last_text) for r in spark.table("session_states").collect()}
    assert got == want


def test_counts_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    for i, text in enumerate(("gua2 beh4\n", "gua2 khi3 beh\n")):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.txt").write_text(text)
    run = counts.token_counts(counts.line_stream(spark, f"file://{tmp_path}/in", 1)).writeStream.format("memory").queryName("running").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {r.word: r.cnt for r in spark.table("running").collect()} == {"gua2": 2, "beh4": 1, "khi3": 1}


def test_phrases_part_the_texts_once(spark, tmp_path):
    """The query's plan reads stored words, the table of documents isn't read again by it; slots give the counts of edge_stripped."""
    texts = ["Gua2 beh4-khi3, (Tai5-uan5) 12 x", "", " a1 ... 字b字 c--", None, "beh4　khi3 x "]
    docs = rows(spark, [(i, t) for i, t in enumerate(texts * 5)], "doc_id long, text string")
    want = {tuple(r) for r in corpus.token_counts(docs, "text", T.edge_stripped).collect()}
    assert {tuple(r) for r in corpus.slot_counts(docs.select(T.slots(F.col("text")).alias("tokens"))).collect()} == want and want
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    found = registry.queries()["phrase_entries"](spark, f"file://{tmp_path}")
    assert not [x for x in found.inputFiles() if "documents.parquet" in x]
    assert found.count() > 0
