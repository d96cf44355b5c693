import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexspark.llm import packing, tokens

TEXTS = ["", " ", "  a  b\n\n c\t d  ", "it's we'll DON'T 'S can't", "naïve ½ ² x² ª", "İstanbul ǅ ŉ ß ſ", "<|endoftext|> a <|startoftext|>", "don't'll're '' !! 12345 3.14 a1b2", " \n \n x \r\n y   ", "ΣΑΣ 漢字 😀", "x y z\x1c\x85"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_whole_texts(spark, small, name, monkeypatch):
    encoder, whole = tokens.Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    assert encoder.by_words
    monkeypatch.setattr(tokens, "TOGETHER", 3000)
    texts = TEXTS + [" ".join(TEXTS), "".join(TEXTS[:6]) * 700, "word " * 3000] + [r[0] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for places, kept in ((7, 200), (20, 1 << 20)):  # words that share places, and tables let go
        monkeypatch.setattr(tokens, "PLACES", 1 << places)
        monkeypatch.setattr(tokens, "KEPT", kept)
        encoder._forget()
        for t, ids in zip(texts, want, strict=True):
            assert encoder.encode(t) == ids, t[:80]
        assert list(encoder.encode_all([t.encode() for t in texts])) == want


def test_words_that_collide_under_sums_of_powers_keep_their_ids():
    one = "a"
    while len(one) < 1024:
        one += one.translate(str.maketrans("ab", "ba"))
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encoder, whole = tokens.Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
        for t in (one, one.translate(str.maketrans("ab", "ba"))):
            assert encoder.encode(t) == np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_random_texts_have_the_ids_of_whole_texts():
    """White space of all kinds, contractions, marks that join with letters, and special tokens' strings in any order."""
    rng = np.random.default_rng(1)
    bits = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\u00a0", "\u2003", "\u3000", "\x85", "\x00", "'s", "'ll", "'", "a", "Word", "é", "e\u0301", "\u0301", "ß", "İ", "Σ", "12", "½", "漢", "“", "😀", ".", "--", "<|endoftext|>", "<|start"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encoder, whole = tokens.Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
        for _ in range(1500):
            t = "".join(rng.choice(bits, rng.integers(1, 12)))
            assert encoder.encode(t) == np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_files_round_trip(spark, odd_docs, no_docs, tmp_path, encoding):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    tokens.write_tokens(tokens.token_lists(tokens.in_order(docs), path, 2), f"file://{tmp_path}/t", encoding, row_group=1 << 20, page=4096)
    whole = Tokenizer.from_file(path)
    want, at = {}, 0
    for r in docs.orderBy("doc_id").collect():
        ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, 2]
        want[r.doc_id] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    crcs = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in tokens.ids_crc32(tokens.read_tokens(spark, f"file://{tmp_path}/t")).collect()}
    starts = {r.doc_id: r.start for r in tokens.starts(spark, f"file://{tmp_path}/t").collect()}
    assert {d: (starts[d], *crcs[d]) for d in crcs} == want
    files = sorted(str(p) for p in (tmp_path / "t").glob("*.parquet"))
    used = {e for f in files if pq.read_metadata(f).num_row_groups for i in range(2) for e in pq.read_metadata(f).row_group(0).column(i).encodings}
    assert ("DELTA_BINARY_PACKED" in used) == (encoding == "delta") and bool({"PLAIN_DICTIONARY", "RLE_DICTIONARY"} & used) == (encoding == "dictionary")
    tokens.write_tokens(tokens.token_lists(tokens.in_order(no_docs), path, 2), f"file://{tmp_path}/e")
    assert tokens.starts(spark, f"file://{tmp_path}/e").collect() == []


def test_page_indexes_let_readers_skip(spark, tmp_path):
    """Row groups and pages are as asked for, in order of doc_id, so a filter reads few of them."""
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of text "), "id").alias("text"))
    tokens.write_tokens(tokens.token_lists(tokens.in_order(docs), public_tokenizers.path("word_bpe_49k.json"), 2), f"file://{tmp_path}/t", row_group=1 << 13, page=1 << 11)
    last = -1
    for f in sorted((tmp_path / "t").glob("*.parquet")):
        meta = pq.read_metadata(f)
        assert meta.num_row_groups > 1
        for g in range(meta.num_row_groups):
            column = meta.row_group(g).column(0)
            assert column.has_column_index and column.has_offset_index
            assert column.statistics.min > last
            last = column.statistics.max
    assert last == 29_999
    plan = tokens.read_tokens(spark, f"file://{tmp_path}/t", ("doc_id", "n_tokens")).where("doc_id = 7")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,7)" in plan and "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan


def test_null_and_repeated_ids_are_whole(spark, odd_docs, no_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    docs = odd_docs.unionByName(odd_docs.where("doc_id is null").withColumn("text", F.lit("another"))).unionByName(odd_docs.where("doc_id = 2").withColumn("text", F.lit("A")))
    want, at = [], 0
    for d, t in sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, tokens.token_table(docs).collect()), key=lambda r: r[1]) == want
    assert tokens.token_table(no_docs).collect() == []


def test_packed_ids_of_null_and_repeated_documents_are_whole(odd_docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    want = Counter()
    for r in odd_docs.collect():
        ids, at = np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for n in packing.cuts(len(ids), 1024):
            want[r.doc_id, at, n, zlib.crc32(ids[at : at + n].tobytes())] += 1
            at += n
    rows = packing.pack(packing.token_pieces(odd_docs, path, 0), ["doc_id", "start"]).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_patterns_hold_the_histogram_with_little_padding():
    rng = np.random.default_rng(5)
    for n in (1, 40, 5000):
        lengths = [k for x in rng.lognormal(6, 1, n).astype(int) + 1 for k in packing.cuts(int(x), 1024)]
        want = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
        got, sequences = {}, 0
        for pattern, times in packing.cutting_stock(want):
            assert times > 0 and sum(k * m for k, m in pattern.items()) <= 1024
            sequences += times
            for k, m in pattern.items():
                got[k] = got.get(k, 0) + m * times
        assert got == want
        assert sequences <= sum(lengths) / 1024 * 1.01 + 1


def test_column_generation_improves_a_poor_start():
    # 400 + 340 + 284 fill a sequence; best fit by length pairs 400 + 400 first
    assert sum(t for _, t in packing.cutting_stock({400: 30, 340: 30, 284: 30})) <= 32


def test_knapsack_equals_brute_force():
    value = np.zeros(21)
    value[[3, 5, 7]] = [3.1, 5.5, 7.2]
    best = max(a * 3.1 + b * 5.5 + c * 7.2 for a in range(7) for b in range(5) for c in range(3) if 3 * a + 5 * b + 7 * c <= 20)
    got, pattern = packing.knapsack(value, 20)
    assert abs(got - best) < 1e-9 and sum(k * n for k, n in pattern.items()) <= 20


def check_packed(rows, docs):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in places.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 1024
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for d, text in docs.items():
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(pieces.pop(d), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert not pieces
    return sum(r.length for r in rows) / 1024 / len(places)


def test_packing_query(spark, small, odd_docs, no_docs):
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    assert check_packed(packing.query(spark, small).collect(), docs) > 0.97
    path = public_tokenizers.path("byte_bpe_50k.json")
    odd = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_packed(packing.pack(packing.token_pieces(odd, path, 0), ["doc_id", "start"]).collect(), {r.doc_id: r.text for r in odd.collect()})
    assert len(packing.pack(packing.token_pieces(odd_docs, path, 0), ["doc_id", "start"]).collect()) >= odd_docs.count()
    assert packing.pack(packing.token_pieces(no_docs, path, 0), ["doc_id", "start"]).collect() == []
    with_ids = packing.token_pieces(odd, path, 0, with_ids=True).collect()
    assert all(len(r.ids) == r.length for r in with_ids)


def test_column_generation_prices_patterns_of_the_real_histogram():
    """Patterns come from pricing, not from the start alone; the packing lies between Farley's bound and one sequence a length more."""
    encoder, h = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for ids in encoder.encode_all([(t or "").encode() for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]):
        h.update(packing.cuts(len(ids) // 4 + 1, 1024))
    full = h.pop(1024, 0)
    lengths = sorted(h)
    need = np.array([h[k] for k in lengths], float)
    solved = packing.linear_program(lengths, need, 1024, 1e-4)
    assert solved.rounds > 50
    held = Counter()
    for pattern, times in zip(solved.patterns, solved.uses, strict=True):
        assert sum(k * n for k, n in pattern.items()) <= 1024
        for k, n in pattern.items():
            held[k] += n * times
    assert all(abs(held[k] - h[k]) < 1e-6 * h[k] for k in lengths)
    assert solved.bound <= solved.uses.sum() <= solved.bound * (1 + 1e-4)
    used = packing.cutting_stock({**h, 1024: full})
    n = sum(times for _, times in used) - full
    assert solved.bound <= n <= solved.bound + len(lengths)


def test_linear_program_reaches_the_optimum_of_all_patterns():
    """The classic instance: lengths 45, 36, 31, 14 of a roll of 100; the optimum over all patterns is 452.25."""
    solved = packing.linear_program([14, 31, 36, 45], np.array([211.0, 395, 610, 97]), 100, 1e-9)
    assert abs(solved.uses.sum() - 452.25) < 1e-6 and solved.rounds > 0
