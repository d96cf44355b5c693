import random

import numpy as np
import pytest

from lexspark.llm import decontaminate

from . import brute


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string"), spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")


def test_edited_passages_equal_brute_force(spark):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(500)}"
    items = [(i, " ".join(word() for _ in range(rng.choice((2, 4, 5, 6, 12, 30, 60))))) for i in range(25)] + [(90, None), (91, ""), (92, "the the the the the the the the the the")]
    docs = []
    for d in range(120):
        w = [word() for _ in range(rng.randrange(1, 120))]
        if d % 2 and (p := items[rng.randrange(25)][1].split()):
            for _ in range(rng.randrange(3)):
                p[rng.randrange(len(p))] = word()
            at = rng.randrange(len(w))
            w[at:at] = p
        docs.append((d, " ".join(w)))
    docs += [(500, None), (501, ""), (502, "the " * 40), (503, items[3][1].upper()), (504, items[5][1])]
    d, i = frames(spark, docs, items)
    want = brute.leaks(docs, items)
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, i).collect()}
    assert len(want) > 20 and got == want
    assert {r.doc_id for r in decontaminate.without_leaks(d, i).collect()} == {x for x, _ in docs} - {x for x, _ in want}


def test_parts_of_a_large_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART", 3)
    items = [(i, f"alpha{i} beta{i} gamma{i} delta{i} eps{i} zeta{i} eta{i}") for i in range(10)]
    d, i = frames(spark, [(1, "x y " + items[4][1] + " z"), (2, items[9][1])], items)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, i).collect()} == {(1, 4), (2, 9)}


@pytest.mark.parametrize("n", [80, 300, 1500])
def test_index_finds_all_within_the_radius(n):
    rng = np.random.default_rng(0)
    prints = rng.integers(0, 256, (n, decontaminate.BITS // 8), dtype=np.uint8)
    wanted = np.concatenate([prints[:80] ^ np.packbits(rng.random((80, decontaminate.BITS)) < 0.23, axis=1), rng.integers(0, 256, (300, decontaminate.BITS // 8), dtype=np.uint8)])
    rows, items = decontaminate.Index(prints, decontaminate.held_values(prints)).within(wanted)
    apart = np.bitwise_count(wanted[:, None] ^ prints[None]).sum(axis=2)
    want = set(zip(*np.nonzero(apart <= decontaminate.RADIUS), strict=True))
    assert set(zip(rows, items, strict=True)) == want and 20 < len(want) < 85
    empty = decontaminate.Index(prints, decontaminate.held_values(prints)).within(prints[:0])
    assert [len(x) for x in empty] == [0, 0]


def test_blocks_leave_most_items_out():
    """Of items with other fingerprints, the share that has a block as near is what chance gives: about a sixth."""
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 16, (2000, decontaminate.BLOCKS), dtype=np.uint16) for _ in range(2))
    passed = (np.bitwise_count(a ^ b) <= decontaminate.RADIUS // decontaminate.BLOCKS).any(axis=1).mean()
    assert passed < 0.2


def test_fingerprints_of_similar_windows_lie_within_the_radius():
    """Recall of the radius at the least similarity: 60 of 80 shingles shared."""
    rng = np.random.default_rng(2)
    found = 0
    for _ in range(500):
        x = rng.integers(0, 2**64, 70, dtype=np.uint64)
        y = np.concatenate([x[:60], rng.integers(0, 2**64, 10, dtype=np.uint64)])
        a, b = (decontaminate.packed(decontaminate.fingerprint_bits(v).sum(axis=0, dtype=np.int64)) for v in (x, y))
        found += int(np.bitwise_count(a ^ b).sum()) <= decontaminate.RADIUS
    assert found >= 495


def test_windows_and_items_with_repeated_shingles_equal_brute_force(spark):
    words = lambda x, n: [f"{x}{i}" for i in range(n)]
    items, docs = [], []
    for j in range(12):
        passage = words(f"w{j}x", 104)
        cut_off, filler = passage[14 - j % 6 :], ["um"] * 30
        items.append((j, " ".join(passage if j % 2 else [*passage[:92], *["um"] * 12])))
        docs += [(10 * j, " ".join(cut_off + filler)), (10 * j + 1, " ".join(filler + passage[:91] + filler)), (10 * j + 2, " ".join(passage[:60] + filler[:4] + passage[60:]))]
    d, i = frames(spark, docs, items)
    want = brute.leaks(docs, items)
    assert len(want) > 12 and {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, i).collect()} == want


def test_rows_without_id_are_decided_by_their_text(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART", 1)
    d, i = frames(spark, [(None, "one two three four five six"), (None, "clean"), (5, "x one two three four five six"), (5, "clean too")], [(1, "one two three four five six"), (2, "seven eight nine ten eleven")])
    assert sorted(r.text for r in decontaminate.without_leaks(d, i).collect()) == ["clean", "clean too"]


def test_odd_and_empty(spark, odd_docs, no_docs):
    _, i = frames(spark, [(1, "x")], [(7, "The cat sat on the mat by the door."), (8, "alpha beta gamma delta")])
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(odd_docs, i).collect()} == {(1, 7), (2, 7), (5, 8)}
    assert decontaminate.leaks(no_docs, i).collect() == []
    assert decontaminate.leaks(odd_docs, i.where("false")).collect() == []
    assert decontaminate.without_leaks(odd_docs, i.where("false")).count() == odd_docs.count()
