import random

import duckdb
import pandas as pd
import pytest

from lexspark.llm import conversations as C

STATES = {0: (("", 0, 0), ("I", 2, 2), ("II", 3, 4)), 1: (("", 1, 0), ("I", 2, 2), ("II", 3, 4)), 2: (("", 2, 0), ("I", 3, 2)), 3: (("", 3, 0), ("I", 2, 2))}
DDL = "conv_id long, turn long, role string, text string, gone string, audit int"


def cheapest(codes):
    """Brute force: the best way to each state of the grammar, row by row."""
    best = {0: (0, "")}
    for code in codes:
        new, cut, letter = {}, code.isupper(), code.lower()
        for state, (cost, audit) in best.items():
            for before, z, more in STATES[state]:
                ways = [("D", z, 3)]
                if code not in "BD":
                    ways.append(("R", 3 if z == 2 else 2, 2 + cut))
                    ways += [("K", to, cut) for a, initial, to in ((0, "s", 1), (0, "u", 2), (1, "u", 2), (3, "u", 2), (2, "a", 3)) if a == z and initial == letter]
                for edit, to, price in ways:
                    found = (cost + more + price, audit + before + edit)
                    new[to] = min(found, new.get(to, found))
        best = new
    return min((cost + more, audit + before) for state, (cost, audit) in best.items() for before, z, more in STATES[state] if z in (0, 3))


@pytest.mark.parametrize("part", [512, 1, 2, 3, 5])
def test_alignment_equals_brute_force(monkeypatch, part):
    monkeypatch.setattr(C, "PART", part)
    rng = random.Random(part)
    for _ in range(1500):
        codes = "".join(rng.choice(rng.choice(["uaUA", "suaoSUAOBD", "ua", "uaBD", "sB"])) for _ in range(rng.randint(0, 14)))
        assert C._repair(codes) == cheapest(codes), codes


def test_long_conversations_are_put_together_from_parts():
    rng = random.Random(7)
    codes = "".join(rng.choice("usaoUA") if rng.random() < 0.1 else rng.choice("BD") if rng.random() < 0.1 else "ua"[i % 2] for i in range(3000))
    assert C.repair(codes) == cheapest(codes)


def test_band_holds_the_incumbent():
    table = C.Table([("u", False, False), ("a", False, False)] * 200, "u")
    assert table.width == 4 and all(len(line) == 9 for line in table.lines)  # clean turns need no wide table
    assert C.greedy([("u", False, False), ("u", False, True), ("o", False, False)], "u") == (4, "u")


def odd_rows():
    rng = random.Random(3)
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, None, None, None), (2, 5, "system", "Be brief."), (2, 5, "user", "Two."), (2, 5, "user", "Two."), (None, 1, "user", "No id!"), (None, None, "assistant", None), (None, 2, "tool", "x" * 70000 + "?\t\n "), (3, 7, "", ""), (3, 8, "user", " \x0b\x1c"), (3, 8, "user", "\u00a0"), (4, -(1 << 62), "user", "a."), (4, 1 << 62, "user", "a."), (4, 2, "assistant", "naïve 😀.")]
    for conv in range(5, 300):
        for turn in range(rng.randint(1, 12)):
            rows.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant"] * 4 + ["system", None, "tool", "agent"]), rng.choice(["Fine.", "Well", "", "Really?", "a\nb", None, f"t{turn}!"])))
    return rows + rows[20:30]


def by_sql(rows, path):
    con = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64", "role": "object", "text": "object"})
    frame.to_parquet(path)
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}')")
    got = con.execute(C.ORACLE)
    return [c[0] for c in got.description], got.fetchall()


def test_odd_rows_equal_sql(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "HELD", 50)
    rows = [r for r in odd_rows() if r[1] is None or abs(r[1]) < 1 << 61]
    columns, want = by_sql(rows, tmp_path / "t.parquet")
    got = C.audits(C.damaged(spark.createDataFrame([(*r, "x", 1) for r in rows], DDL)), "gone")
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want, key=str)


def test_whole_range_of_turns(spark):
    got = C.audits(spark.createDataFrame([(*r, "x", 1) for r in odd_rows() if r[0] == 4], DDL)).collect()
    assert [(r.gaps, r.audit) for r in got] == [((1 << 63) - 2, "KKD")]


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two? Three!") for c in range(40) for t in range(5)]
    got = C.damaged(spark.createDataFrame([(*r, "x", 1) for r in rows], DDL)).collect()
    assert {(r.role, r.text, r.gone) for r in got} == {("assistant", "One. Two? Three!", False), ("assistant", "", True), ("assistant", "", False), ("assistant", "One Two Three", False), ("user", "One. Two? Three!", False)}
    assert len(got) > len(rows)


def test_repaired_turns_keep_the_grammar(spark):
    turns = spark.createDataFrame([(*r, "x", 1) for r in odd_rows()], DDL)
    whole = {}
    for r in C.repaired_turns(turns).orderBy("conv_id", "place").collect():
        whole.setdefault(r.conv_id, []).append(r)
    for rows in whole.values():
        letters = "".join(r.role[:1] for r in rows)
        letters = letters[1:] if letters[:1] == "s" else letters
        assert letters and letters == "ua" * (len(letters) // 2)
        assert [r.place for r in rows] == list(range(len(rows))) and all((r.text == "" and r.turn is None) == (r.edit == "I") for r in rows if r.edit == "I")


def test_empty_table_and_conversations_without_rows(spark):
    assert C.audits(spark.createDataFrame([], DDL)).collect() == []
    turns = spark.createDataFrame([(1, 1, "user", "a.", "x", 1)], DDL).selectExpr("*", "true AS lost")
    row = C.audits(turns, "lost").collect()[0]
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")


def test_query_equals_its_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{small}/conversations.parquet')")
    want = con.execute(C.ORACLE)
    columns = [c[0] for c in want.description]
    got = C.query(spark, small)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)
