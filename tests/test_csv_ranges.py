import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.sources import csv_ranges


def whole(spark, path):
    """Spark's own reader, which takes a file in one task."""
    return [tuple(r) for r in spark.read.options(header=True, multiLine=True, escape='"', mode="PERMISSIVE").csv(path).collect()]


@pytest.fixture
def ranged(spark):
    """Ranges of so many bytes at most."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {k: spark.conf.get(k, None) for k in keys}

    def put(size):
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], "1")
        spark.conf.set(keys[2], "1")

    yield put
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def field(rng):
    if rng.random() < 0.35:
        return rng.choice(["", "ab é漢", 'x"y', " a", "0"])
    return '"' + "".join(rng.choice(["a", ",", "\n", "\r\n", '""', "漢", " ", "\t"]) for _ in range(rng.randint(0, 9))) + '"'


def write(path, rng, rows, end="\n", mark=""):
    lines = [f"{mark}one,two,三 x"] + [",".join(field(rng) for _ in range(rng.choice([3, 3, 2, 4]))) for _ in range(rows)]
    path.write_bytes((end.join(lines) + rng.choice(["", end])).encode())


@pytest.mark.parametrize("size", [150, 1000, 1 << 20])
def test_equals_the_reader_of_whole_files(spark, tmp_path, ranged, size):
    ranged(size)
    for i, (end, mark) in enumerate((("\n", ""), ("\r\n", "﻿"))):
        write(tmp_path / f"f{i}.csv", random.Random(i), 120, end, mark)
    df = csv_ranges.read_csv(spark, str(tmp_path))
    assert df.columns == ["one", "two", "三 x", "_file", "_row"]
    got = df.orderBy("_file", "_row").collect()
    for i in (0, 1):
        own = [r for r in got if r._file == f"f{i}.csv"]
        assert [tuple(r)[:3] for r in own] == whole(spark, str(tmp_path / f"f{i}.csv"))
        assert [r._row for r in own] == sorted(r._row for r in own)
    if size < 1 << 20:
        assert csv_ranges._lines(spark, str(tmp_path), ",").rdd.getNumPartitions() > 3


def test_a_record_over_many_ranges(spark, tmp_path, ranged):
    ranged(100)
    body = "line of the field\n" * 80
    (tmp_path / "a.csv").write_text(f'k,v\n1,"{body}"\n2,x\n3,"{body}""end"""\n4,"never closed\n5,y\n')
    got = {r.k: r.v for r in csv_ranges.read_csv(spark, str(tmp_path / "a.csv")).collect()}
    assert (got["1"], got["2"], got["3"]) == (body, "x", body + '"end"')
    assert set(got) == {"1", "2", "3", "4"} and "never closed\n5,y" in got["4"]


def test_ranges_beyond_the_broadcast_limit(spark, tmp_path, ranged, monkeypatch):
    ranged(200)
    monkeypatch.setattr(csv_ranges, "BROADCAST", 2)
    write(tmp_path / "f.csv", random.Random(9), 80)
    rows = csv_ranges.read_csv(spark, str(tmp_path / "f.csv"))
    assert [tuple(r)[:3] for r in rows.orderBy("_row").collect()] == whole(spark, str(tmp_path / "f.csv"))


def test_header_alone_and_other_separators(spark, tmp_path):
    (tmp_path / "h.csv").write_text("a,b\n")
    assert csv_ranges.read_csv(spark, str(tmp_path / "h.csv")).count() == 0
    (tmp_path / "t.tsv").write_text('a\tb\nx,"y\t"z\n,"\nq\n')
    assert [tuple(r)[:2] for r in csv_ranges.read_csv(spark, str(tmp_path / "t.tsv"), "\t").orderBy("_row").collect()] == [('x,"y', "z\n,"), ("q", None)]


def test_steps_of_lines(spark):
    cases = {"plain": 2, 'a,"b': 3, 'b",c': 1, '"a","b"': 0, 'x"y': 0, '""': 1, '"': 1, 'a"': 0, ",": 2, '"a""': 3}
    rows = spark.createDataFrame([(k,) for k in cases], "line string")
    got = {r.line: r.s for r in rows.select("line", csv_ranges.line_step(F.col("line")).alias("s")).collect()}

    def run(line, inside):
        state, i = (2 if inside else 0), 0
        while i < len(line):
            c = line[i]
            if state == 2:
                if c == '"':
                    if line[i + 1 : i + 2] == '"':
                        i += 1
                    else:
                        state = 1
            elif c == '"' and state == 0:
                state = 2
            else:
                state = 0 if c == "," else 1
            i += 1
        return state == 2

    assert got == {k: run(k, False) + 2 * run(k, True) for k in cases}


def test_states_follow_the_steps():
    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 200):
        steps = rng.integers(0, 4, n)
        for start in (0, 1):
            want, s = [], start
            for k in steps.tolist():
                want.append(s)
                s = (k >> s) & 1
            before, after = csv_ranges.states_before(steps, start)
            assert before.tolist() == want and after == s
