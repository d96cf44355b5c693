import hashlib

from lexspark.llm import warc

TRAP = "x" * 150 + "\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + "y" * 50
ROWS = [(1, "http://a.example/x", "<p>" + "a" * 200), (2, "http://a.example/y", "<p>" + "a" * 200), (3, None, "<p>" + "a" * 200), (4, "u\r\nv", "short"), (5, "http://b.example", "short"), (6, "http://b.example/1", None), (7, "http://b.example/2", ""), (8, "http://b.example/3", TRAP), (9, "http://b.example/3", TRAP), (10, "", "é" * 50), (11, "", "é" * 50), (12, "", "é" * 49 + "a"), (13, "", "\n\n\r\n")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, type string, refers_to int")


def test_round_trip_with_traps(spark, tmp_path):
    warc.write_warc(frame(spark), f"file://{tmp_path}/w")
    got = {r.page_id: r for r in warc.records(f"file://{tmp_path}/w", spark).collect()}
    first = {}
    for p, _, h in ROWS:
        raw = (h or "").encode()
        big = len(raw) >= 100
        to = first.setdefault(raw, p) if big else p
        r = got.pop(p)
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if to == p else ("revisit", to))
    assert not got


def test_chains_over_many_blocks(spark, tmp_path):
    """Several tasks read one file by ranges of bytes, however the ranges lie in records and magics."""
    rows = [(i, f"u{i}", TRAP * (1 + i % 3) + str(i)) for i in range(40)]
    warc.write_warc(frame(spark, rows).coalesce(1), f"file://{tmp_path}/w")
    want = {i: hashlib.sha256(h.encode()).hexdigest() for i, _, h in rows}
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    for size in (97, 300, 1000, 1 << 20):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        try:
            raw = warc._parts(f"file://{tmp_path}/w", spark, "WARC/1.0\r\n")
            assert raw.rdd.getNumPartitions() > (20 if size < 1000 else 0)
            assert any(b"urn:page:999" in r.value for r in raw.collect())
            kept = {r.page_id: r.payload_digest for r in warc.read_warc(f"file://{tmp_path}/w", spark).collect()}
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", 128 << 20)
            spark.conf.set("spark.sql.files.openCostInBytes", cost)
        assert kept == want


def test_broken_files_keep_what_lies_before(spark, tmp_path):
    warc.write_warc(frame(spark, [(i, "u", f"page {i}") for i in range(6)]).coalesce(1), f"file://{tmp_path}/w")
    content = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("*.txt")))
    starts = [i for i in range(len(content)) if content.startswith(b"WARC/1.0", i)]
    for name, raw, n in (("cut", content[:-7], 5), ("gap", content[: starts[3]] + b"?" + content[starts[3] :], 2), ("late", b"?" + content, 0), ("none", b"", 0)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.warc").write_bytes(raw)
        assert warc.read_warc(f"file://{tmp_path}/{name}", spark).count() == n, name


def test_long_ids_and_ids_with_several_payloads(spark, tmp_path):
    big = 1 << 60
    a, b = "<p>" + "a" * 200, "<p>" + "b" * 200
    rows = [(big + 1, "u", a), (big + 4, "u", a), (7, "u", a), (7, "u", b), (8, "u", b), (9, None, a)]
    warc.write_warc(frame(spark, rows[:2]), f"file://{tmp_path}/l")
    got = {r.page_id: (r.payload_bytes, r.refers_to) for r in warc.records(f"file://{tmp_path}/l", spark).collect()}
    assert got == {big + 1: (203, None), big + 4: (203, big + 1)}
    warc.write_warc(frame(spark, rows), f"file://{tmp_path}/w")
    digest = {h: hashlib.sha256(h.encode()).hexdigest() for h in (a, b)}
    got = sorted((tuple(r) for r in warc.records(f"file://{tmp_path}/w", spark).collect()), key=str)
    want = [(p, 203, digest[h], "response" if p == 7 else "revisit", None if p == 7 else 7) for p, _, h in rows]
    assert got == sorted(want, key=str)


def test_many_revisits_are_joined_by_a_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    warc.write_warc(frame(spark), f"file://{tmp_path}/w")
    got = warc.records(f"file://{tmp_path}/w", spark).collect()
    assert sorted(r.page_id for r in got) == [r[0] for r in ROWS] and {r.refers_to for r in got} == {None, 1, 8, 10}


def test_headers_of_any_length(spark, tmp_path):
    rows = [(i, f"http://a.example/{i}?" + ("q" * 200_000 if i == 1 else "WARC/1.0\r\n" * 3), f"<p>page {i}") for i in range(5)]
    warc.write_warc(frame(spark, rows).coalesce(1), f"file://{tmp_path}/w")
    got = {r.page_id: r.payload_digest for r in warc.records(f"file://{tmp_path}/w", spark).collect()}
    assert got == {p: hashlib.sha256(h.encode()).hexdigest() for p, _, h in rows}


def test_repeated_and_no_pages(spark, tmp_path):
    warc.write_warc(frame(spark, ROWS + ROWS), f"file://{tmp_path}/w")
    assert warc.records(f"file://{tmp_path}/w", spark).count() == 2 * len(ROWS)
    warc.write_warc(frame(spark).where("false"), f"file://{tmp_path}/e")
    assert warc.records(f"file://{tmp_path}/e", spark).collect() == []
