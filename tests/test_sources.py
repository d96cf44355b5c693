"""Readers and exports on tiny files of the shapes that dictionaries and corpora have."""

import json

import pytest
from pyspark.sql import functions as F

from lexspark.operators import corpus, validate
from lexspark.plans import build
from lexspark.sources import readers, sinks

ITAIGI = "﻿DictWordID,PojUnicode,PojInput,KipUnicode,KipInput,HanLoTaibunPoj,HanLoTaibunKip,HoaBun,DataProvidedBy\n1,chia̍h-pn̄g,chiah8-png7,tsia̍h-pn̄g,tsiah8-png7,食飯,食飯,吃飯,x\n2,,,,tsit8(替)/it4,,一,一,x\n3,,,,kua,,,歌,x\n"
TAIHOA = "﻿DictWordID,PojUnicode,PojUnicodeOthers,PojInput,PojInputOthers,HanLoTaibunPoj,KipUnicode,KipUnicodeOthers,KipInput,KipInputOthers,HanLoTaibunKip,HoaBun\n7,,,,,,,,tsiah8-png7,tsiah8/png7,食飯,用餐、吃飯\n8,,,,,,,,tng2--lai5,,倒轉來,回來\n"
GENERIC = 'PojInput,HanLoTaibunPoj,HoaBun\nsian7-neh,善,"two\nlines"\n,無碼,x\n'


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return f"file://{path}"


@pytest.fixture
def dictionaries(tmp_path):
    for name, text in (("iTaigiHoataiTuichiautian", ITAIGI), ("TaihoaSoanntengTuichiautian", TAIHOA), ("KamJitian", GENERIC)):
        put(tmp_path / "d" / f"ChhoeTaigi_{name}.csv", text)
    put(tmp_path / "d" / "other.csv", "a\n1\n")
    return f"file://{tmp_path}/d"


def values(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]


def test_dictionaries_by_source_order(spark, dictionaries):
    files = readers.dictionary_files(spark, dictionaries)
    assert [s for _, s in files] == ["kamjitian", "taihoa", "itaigi"] and readers.dictionary_files(spark, dictionaries + "/none") == []
    rows = values(readers.dictionary_entries(spark, dictionaries).orderBy("seq"), "hanlo", "kip_input", "rime_key", "hoabun", "source")
    assert rows == [
        ("食飯", "tsiah8-png7", "tsiah8 png7", "吃飯", "itaigi"),
        ("一", "tsit8", "tsit8", "一", "itaigi"),
        ("一", "it4", "it4", "一", "itaigi"),
        ("食飯", "tsiah8-png7", "tsiah8 png7", "用餐、吃飯", "taihoa"),
        ("食飯", "tsiah8", "tsiah8", "用餐、吃飯", "taihoa"),
        ("食飯", "png7", "png7", "用餐、吃飯", "taihoa"),
        ("倒轉來", "tng2--lai5", "tng2  lai5", "回來", "taihoa"),
        ("善", "sian7-neh4", "sian7 neh4", "two\nlines", "kamjitian"),
    ]
    glosses = values(readers.gloss_rows(spark, dictionaries).orderBy("priority", "seq"), "hoabun", "kip", "priority", "hanlo")
    assert glosses == [("用餐、吃飯", "tsiah8-png7", 2, "食飯"), ("回來", "tng2--lai5", 2, "倒轉來"), ("吃飯", "tsiah8-png7", 3, "食飯"), ("一", "tsit8", 3, "一"), ("歌", "kua", 3, "")]
    assert readers.source_of(F.lit("x")) is not None
    assert spark.range(1).select(readers.source_of(F.lit("ChhoeTaigi_EmbreeTaiengSutian.csv")).alias("s"), readers.source_of(F.lit("zz")).alias("n")).first().asDict() == {"s": "embree", "n": None}
    with pytest.raises(ValueError):
        readers.dictionary_entries(spark, dictionaries + "/none")


def test_cells_of_absent_and_blank_columns(spark):
    df = spark.createDataFrame([(" a ", None), ("", "b")], "x string, y string")
    got = df.select(readers.either(readers.cell(df, "x"), readers.cell(df, "z"), readers.cell(df, "y")).alias("v"), readers.cell(df, "z").alias("z"))
    assert values(got, "v", "z") == [("a", ""), ("b", "")]


def test_corpora(spark, tmp_path):
    lines = lambda df: sorted(values(df, "line"))
    folder = put(tmp_path / "t" / "a.txt", "gua2 beh4\n\nlai5\n").rpartition("/")[0]
    put(tmp_path / "t" / "deep" / "b.tbk", "khi3\n")
    put(tmp_path / "t" / "c.md", "no\n")
    assert lines(readers.line_corpus(spark, folder, "*.{tbk,txt}").where("line <> ''")) == ["gua2 beh4", "khi3", "lai5"]
    chapters = {"作者": "x", "資料": [{"篇名": "a", "段": [["漢", "gua2\nbeh4"], ["short"], ["漢", " "]]}, {"篇名": "b", "段": [["漢", "khi3"]]}]}
    one = put(tmp_path / "c" / "x" / "1.json", json.dumps(chapters, ensure_ascii=False)).rpartition("/x/")[0]
    put(tmp_path / "c" / "broken.json", '{"資料": [')
    assert lines(readers.chapter_corpus(spark, one)) == ["beh4", "gua2", "khi3"]
    assert lines(readers.textbook_corpus(spark, one + "/none", one)) == ["beh4", "gua2", "khi3"]
    with pytest.raises(ValueError):
        readers.textbook_corpus(spark, one + "/none")
    works = put(tmp_path / "w" / "1.json", json.dumps([{"資料": [["漢", "gua2"], ["漢", ""], ["one"]]}, {"other": 1}], ensure_ascii=False)).rpartition("/")[0]
    put(tmp_path / "w" / "x.txt", "text line\n")
    assert lines(readers.works_corpus(spark, works)) == ["gua2"]
    assert lines(readers.literary_corpus(spark, works)) == ["gua2"]  # JSON first
    assert lines(readers.literary_corpus(spark, folder)) == ["gua2 beh4", "khi3", "lai5"]
    poj = put(tmp_path / "p" / "1.json", json.dumps([{"tailo": ["chiah8 png7", " "]}, {"x": 1}])).rpartition("/")[0]
    put(tmp_path / "p" / "a.txt", "goa2\n")
    assert lines(readers.poj_corpus(spark, poj)) == ["tsiah8 png7"]
    put(tmp_path / "q" / "1.json", json.dumps([{"tailo": []}]))
    put(tmp_path / "q" / "deep" / "a.txt", "goa2 seng1\n\n")
    assert lines(readers.poj_corpus(spark, f"file://{tmp_path}/q")) == ["gua2 seng1"]  # a tone digit is no end of a word
    leku = put(tmp_path / "m" / "m.json", json.dumps({"1": {"詞條臺羅": "tām-po̍h", "例句臺羅": "Guá beh khì."}, "2": {"例句臺羅": "x"}}, ensure_ascii=False))
    assert sorted(values(readers.map_corpus(spark, leku), "id", "head", "example")) == [("1", "tām-po̍h", "Guá beh khì."), ("2", "", "x")]
    reading = spark.createDataFrame([("gua2", None, "", "guan2")], "`羅馬字` string, `又唸作` string, `合音唸作` string, `俗唸作` string")
    assert lines(readers.readings_corpus(reading)) == ["gua2", "guan2"]


def test_reverse_vocabulary_and_rules(spark, tmp_path):
    kip = put(tmp_path / "k.csv", '詞目id,詞目類型,漢字,羅馬字,解說\n1,主詞目,食,tsia̍h,"a\nb"\n2,附錄,食,si̍t,c\n3,主詞目,,x,y\n4,附錄,人,lâng,z\n')
    rows = readers.reverse_rows(readers.csv(spark, kip))
    assert sorted(values(sinks.reverse_first(rows), "word", "roman", "weight")) == [("人", "lâng", 300), ("食", "tsia̍h", 500)]
    voc = put(tmp_path / "v.csv", "主編碼,屬性,詞目,音讀,文白屬性,部首\n1,1,食,tsia̍h,0,食\n2,1,食,si̍t,1,食\n3,1,,x,0,x\n")
    got = sinks.vocabulary_reverse(readers.vocabulary_rows(readers.csv(spark, voc)))
    assert sorted(values(got, "hanlo", "rime_key", "reading", "weight")) == [("食", "食", "si̍t", 300), ("食", "食", "tsia̍h", 500)]
    defs = put(tmp_path / "e.csv", "釋義總序號,主編碼,釋義順序,詞性代號,釋義\n1,7,1,1,first\n2,7,2,1,second\n3,8,1,1,\n")
    assert values(readers.definitions(readers.csv(spark, defs)), "moe_id", "definitions") == [("7", ["first", "second"])]
    tsv = put(tmp_path / "h.tsv", "建議用字\t音讀\t數字版音讀\t對應華語\n食飯\ttsia̍h\ttsiah8\t吃飯\nê\tê\t\t的\n\tx\tx\tx\n食飯\ty\ttsiah4\t用餐\n")
    com = put(tmp_path / "h.csv", "建議用字,音讀\n佇,tī\n")
    assert (readers.sniffed_separator(spark, tsv), readers.sniffed_separator(spark, com)) == ("\t", ",")
    rules = readers.writing_rules(readers.csv(spark, tsv, "\t"))
    assert values(rules.orderBy("seq"), "word", "type", "kip", "hoabun") == [("食飯", "han", "tsiah8", "吃飯"), ("ê", "lo", "ê", "的"), ("食飯", "han", "tsiah4", "用餐")]
    sinks.write_rules(rules, f"file://{tmp_path}/rules")
    back = readers.writing_rules_yaml(spark, f"file://{tmp_path}/rules")
    assert values(back.orderBy("seq"), "word", "type", "kip", "hoabun") == [("食飯", "han", "tsiah4", "用餐"), ("ê", "lo", "ê", "的")]
    light = put(tmp_path / "l.csv", "臺羅,漢字,分連不處理\nlâi,來,分\n,x,y\n")
    lt = readers.light_tone_rules(readers.csv(spark, light))
    assert values(lt, "tl", "hanzi", "rule") == [("lâi", "來", "分")]
    more = lt.unionByName(lt.withColumns({"tl": F.lit("khì"), "seq": F.struct(F.lit("z").alias("file"), F.lit(9).cast("long").alias("row"))}))
    sinks.write_rules_json(more, f"file://{tmp_path}/lj")
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "lj").glob("part-*")))
    assert json.loads(text) == [{"tl": "lâi", "hanzi": "來", "rule": "分"}, {"tl": "khì", "hanzi": "來", "rule": "分"}]
    js = put(tmp_path / "j.json", text)
    assert values(readers.light_tone_rules_json(spark, js).orderBy("seq"), "tl", "hanzi", "rule") == [("lâi", "來", "分"), ("khì", "來", "分")]
    words = readers.word_list(readers.csv(spark, tsv, "\t"))
    sinks.write_words(words, f"file://{tmp_path}/words")
    assert sorted(values(readers.word_list_yaml(spark, f"file://{tmp_path}/words"), "word", "n_chars")) == [("ê", 1), ("食飯", 2)]


def test_yaml_of_other_makers(spark, tmp_path):
    path = put(tmp_path / "r.yaml", "# note\n\nê:\n  type: lo\n  kip: 'e5'\n  hoabun: ''\n食飯:\n  type: han\n  kip: tsiah8-png7\n  hoabun: 吃飯\nê:\n  type: han\n")
    assert values(readers.writing_rules_yaml(spark, path).orderBy("seq"), "word", "type", "kip", "hoabun") == [("食飯", "han", "tsiah8-png7", "吃飯"), ("ê", "han", "", "")]
    path = put(tmp_path / "w.yaml", "# note\n- '佇'\n- 食飯\n\n- 佇\nno\n")
    assert sorted(values(readers.word_list_yaml(spark, path), "word", "n_chars")) == [("佇", 1), ("食飯", 2)]


def test_frequencies_lexicons_and_maps(spark, tmp_path):
    a, b = put(tmp_path / "f" / "a.tsv", "gua2\t3\nbeh4\tx\n\ngua2\t5\nbad\n"), put(tmp_path / "f" / "b.tsv", "gua2\t2\nlai5\t1\n")
    assert sorted(values(readers.frequencies(spark, [a, b]), "word", "cnt")) == [("gua2", 7), ("lai5", 1)]
    counts = spark.createDataFrame([("b", 1), ("a", 1), ("c", 9)], "word string, cnt long")
    sinks.write_frequencies(counts, f"file://{tmp_path}/fo")
    assert "".join(p.read_text() for p in sorted((tmp_path / "fo").glob("part-*"))) == "c\t9\na\t1\nb\t1\n"
    lex = spark.createDataFrame([(f"字{i:03}", f"a{i % 40:02}", i) for i in range(300)] + [("一", "a00", 5000)], "hanlo string, rime_key string, weight int")
    sinks.write_lexicon(lex, f"file://{tmp_path}/lex", "test", "1.0")
    text = "".join(p.read_text() for p in sorted((tmp_path / "lex").glob("part-*")))
    head, _, body = text.partition("...\n")
    assert head == '# lexicon\n---\nname: test\nversion: "1.0"\nsort: by_weight\nuse_preset_vocabulary: false\n'
    rows = [tuple(x.split("\t")) for x in body.splitlines()]
    assert rows == sorted(rows, key=lambda r: (r[1], -int(r[2]), r[0])) and len(rows) == 301 and rows[0] == ("一", "a00", "5000")
    whole = put(tmp_path / "one.yaml", text + "# note\n短\n乙\tb01\tx\n")
    back = readers.lexicon(spark, whole)
    assert sorted(values(back, "hanlo", "rime_key", "weight")) == sorted([(a, b, int(c)) for a, b, c in rows] + [("乙", "b01", 0)])
    assert readers.lexicon(spark, whole, None).count() == 301
    assert [r[:2] for r in values(back.orderBy("seq"), "hanlo", "rime_key")][:2] == [rows[0][:2], rows[1][:2]]
    glosses = spark.createDataFrame([("食", "tsiah8"), ("一", "tsit8")], "mandarin string, kip string")
    sinks.write_gloss_map(glosses, f"file://{tmp_path}/g")
    assert values(readers.gloss_map(spark, f"file://{tmp_path}/g"), "mandarin", "kip") == [("一", "tsit8"), ("食", "tsiah8")]
    sentences = spark.createDataFrame([(["gua2", "beh4"],), ([],)], "tokens array<string>")
    sinks.write_sentences(sentences, f"file://{tmp_path}/s")
    assert values(readers.line_corpus(spark, f"file://{tmp_path}/s"), "line") == ["gua2 beh4"]


def test_lines_are_numbered_over_ranges(spark, tmp_path):
    texts = {"a": [f"line {i}" * (i % 7) for i in range(500)], "b": ["x", "", "y"]}
    for name, lines in texts.items():
        put(tmp_path / "n" / name, "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = readers.numbered_lines(spark, f"file://{tmp_path}/n")
        assert got.rdd.getNumPartitions() > 1
        found = {}
        for f, n, v in sorted(values(got, "file", "line_no", "value")):
            found.setdefault(f[-1], []).append((n, v))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 128 << 20)
        spark.conf.set("spark.sql.files.openCostInBytes", 4 << 20)
    assert found == {k: list(enumerate(v)) for k, v in texts.items()}


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("---\nname: x\n...\n食\ttsiah8\t1\n飯\tpng7\n", []),
        ("name: x\n...\n食\ttsiah8\t1\n", ["header"]),
        ("---\n食\ttsiah8\t1\n", ["terminator"]),
        ("---\n...\n食 tsiah8 1\n# note\n\n", ["format"]),
        ("---\n...\n食\ttsiah8\t1\n飯\tpng7\t1\n食\ttsiah8\t2\n食\ttsiah8\t3\n", ["duplicate", "duplicate"]),
    ],
)
def test_violations(spark, tmp_path, text, kinds):
    found = validate.violations(spark, put(tmp_path / "x.yaml", text))
    assert values(found, "kind") == kinds and validate.exit_code(found) == bool(kinds)


def test_paths(spark, tmp_path):
    for day, name in (("2024-01-01", "x.csv"), ("2024-02-01", "x.csv"), ("2024-03-01", "y.csv")):
        put(tmp_path / "snap" / day / name, "a\n")
    root = f"file://{tmp_path}/snap"
    assert readers.latest(spark, root, "x.csv").endswith("2024-02-01/x.csv") and readers.latest(spark, root, "z.csv") is None
    assert readers.first_present(spark, root + "/none", root + "/2024-03-01") == root + "/2024-03-01" and readers.first_present(spark, root + "/none") is None


def test_build_joins_all_parts(spark, dictionaries, tmp_path):
    lines = spark.createDataFrame([("tsiah8-png7 tsit8 tsiah8-png7 tsit8",)] * 3 + [("tng2--lai5 a",)], "line string")
    rules = spark.createDataFrame([("lâi", "來", "補語", 1)], "tl string, hanzi string, rule string, seq int")
    out = f"file://{tmp_path}/out"
    got = {(r.hanlo, r.rime_key): r.weight for r in build.build(spark, dictionaries, lines, rules, out, match="toneless", min_count=3).collect()}
    assert got["食飯", "tsiah8 png7"] == int(800 * 1.2 * 1.1 * (1 + 0.2 * __import__("math").log10(7)))
    assert ("一食飯", "tsit8 tsiah8 png7") in got and ("食飯一", "tsiah8 png7 tsit8") in got
    assert ("倒轉來", "tng2  lai5") in got
    assert sorted(values(corpus.summary(readers.frequencies(spark, out + "/frequencies.txt")), "unique_words", "total_tokens")) == [(4, 14)]
    assert readers.gloss_map(spark, out + "/glosses.txt").where("mandarin = '吃飯'").first().kip == "tsiah8 png7"


def test_build_counts_while_it_writes_and_runs_from_the_command_line(spark, dictionaries, tmp_path, capsys):
    import json

    (tmp_path / "corpus").mkdir()
    (tmp_path / "corpus" / "a.txt").write_text("tsiah8-png7 tsit8 tsiah8-png7 tsit8\n" * 3 + "tng2--lai5 a\n\nno numbers here\n")
    (tmp_path / "rules.csv").write_text("臺羅,漢字,分連不處理\nlâi,來,補語\n")
    (tmp_path / "reverse.csv").write_text('漢字,羅馬字,詞目類型\n食,tsiah8,主詞目\n食,sit8,附錄\n"飯",png7,附錄\n')
    (tmp_path / "voc.csv").write_text("詞目,音讀,主編碼,文白屬性\n食,tsiah8,1,0\n食,sit8,2,1\n")
    (tmp_path / "write.csv").write_text("建議用字,數字版音讀,音讀,對應華語\nê,e5,,的\n食飯,,tsiah8-png7,吃飯\n")
    out = f"file://{tmp_path}/out"
    arguments = ["--dictionaries", dictionaries, "--corpus", f"file://{tmp_path}/corpus", "--rules", f"file://{tmp_path}/rules.csv", "--output", out, "--match", "toneless", "--min-count", "3"]
    build.main([*arguments, "--reverse", f"file://{tmp_path}/reverse.csv", "--vocabulary", f"file://{tmp_path}/voc.csv", "--writing-rules", f"file://{tmp_path}/write.csv"], spark)
    told = json.loads(capsys.readouterr().out.splitlines()[-1])
    report = json.loads(spark.read.text(f"{out}/report.json").first().value)
    whole = spark.read.parquet(f"{out}/lexicon")
    assert told["entries"] == report["entries"] == whole.count() and report["violations"] == 0
    assert report["heaviest"] == whole.agg({"weight": "max"}).first()[0]
    assert (report["unique_words"], report["total_tokens"]) == (4, 14) and report["sentences"] == 4 and report["sentence_tokens"] == 14
    assert {(r.hanlo, r.rime_key, r.weight) for r in readers.lexicon(spark, f"{out}/reverse.txt").collect()} == {("食", "tsiah8", 500), ("飯", "png7", 300)}
    assert readers.lexicon(spark, f"{out}/vocabulary.txt").count() == 2
    assert {(r.word, r.type) for r in readers.writing_rules_yaml(spark, f"{out}/writing_rules.yaml").collect()} == {("ê", "lo"), ("食飯", "han")}
    assert {r.word for r in readers.word_list_yaml(spark, f"{out}/words.yaml").collect()} == {"ê", "食飯"}
    assert readers.light_tone_rules_json(spark, f"{out}/light_tones.json").count() == 1


def test_rules_json_in_several_parts(spark, tmp_path):
    """Each part is a piece of the array, and rules may share their seq or have none."""
    data = [(f"a--{i}", f'x"],[{{{i}\n', None if i % 5 == 0 else "], [", None if i % 7 == 0 else i // 2) for i in range(3000)]
    rules = spark.createDataFrame([*data, data[0], data[0]], "tl string, hanzi string, rule string, seq int")
    path = f"file://{tmp_path}/rules"
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_rules_json(rules, path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    parts = sorted((tmp_path / "rules").glob("part-*"))
    assert sum(p.stat().st_size > 0 for p in parts) > 1
    assert len(json.loads("".join(p.read_text() for p in parts))) == 3002
    back = readers.light_tone_rules_json(spark, path)
    want = [r[:3] for r in sorted([*data, data[0], data[0]], key=lambda r: (r[3] is not None, r[3] or 0, r[0]))]
    assert values(back.orderBy("seq"), "tl", "hanzi", "rule") == want
    (tmp_path / "rules" / "part-99999").write_text('{"tl": "cut')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.light_tone_rules_json(spark, path).collect()
