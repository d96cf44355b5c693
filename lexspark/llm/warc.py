"""WARC archives: writing with revisit records, and reading by boundary-chain verification."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, scratch

#: Payloads of fewer bytes are never told by a revisit.
LEAST = 100
#: Rows of a small side that are broadcast at most; beyond, Spark shuffles both sides.
BROADCAST_ROWS = 100_000

_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, _digest, refers_to): pages whose payload of LEAST bytes or more equals that of a page with a smaller page_id. Pages without page_id are never among them."""
    slim = cut(pages.where(F.octet_length("html") >= LEAST).select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("_digest")))
    first = slim.groupBy("_digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return slim.join(first, "_digest").where(F.col("page_id") != F.col("refers_to")).select("page_id", "_digest", "refers_to").distinct()


def write_warc(pages: DataFrame, path: str) -> None:
    """One record per page as plain WARC 1.0 files, which readers can part by ranges of bytes; null html is empty, a null url is left out, line breaks in urls become spaces.

    Spark's text sink writes the records: each ends in two line ends, the last line feed of which is the sink's own separator. So any store that Spark can write to will do. Pages are written where they are read; only if there are more than BROADCAST_ROWS revisits, the join shuffles them.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    again = cut(revisits(pages))
    small = F.broadcast if again.count() <= BROADCAST_ROWS else lambda df: df
    rows = pages.select("page_id", "url", html.alias("html")).withColumn("_digest", F.sha2(F.col("html").cast("binary"), 256)).join(small(again), ["page_id", "_digest"], "left")
    digest = F.col("_digest")
    again = F.col("refers_to").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:page:"), c, F.lit(">"))
    body = F.concat(F.lit(_HTTP), F.when(again, F.lit("")).otherwise(F.col("html")))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name(F.coalesce(F.col("page_id").cast("string"), F.lit("none")))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")), F.lit("")),
        F.when(again, F.concat(line("WARC-Refers-To", name(F.col("refers_to").cast("string"))), F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\n"))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
    )
    rows.select(F.concat(head, body, F.lit("\r\n\r")).alias("value")).write.text(path, lineSep="\n")


_FIELDS = [("file", pa.string()), ("block", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("next", pa.int64()), ("exit", pa.int64()), ("type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("declared", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
_DDL = "file string, block long, offset long, size long, next long, exit long, type string, page_id long, refers_to long, declared string, payload_bytes long, payload_digest string"


def _number(value: bytes) -> int | None:
    m = re.search(rb"urn:page:(-?\d+)", value)
    return int(m[1]) if m else None


def _payload(body: bytes) -> bytes:
    return body.partition(b"\r\n\r\n")[2]


def _header(part: bytes) -> tuple[int, int, dict[bytes, bytes]] | None:
    """Where the body starts and where the whole record would end, counted from behind the magic, and the header's fields; None if there is no header with a length."""
    end = part.find(b"\r\n\r\n") if part[:2] != b"\r\n" else -1
    if end < 0:
        return None
    fields = dict(x.split(b": ", 1) for x in part[:end].split(b"\r\n") if b": " in x)
    size = fields.get(b"Content-Length", b"")
    return (end + 4, end + 8 + int(size), fields) if size.isdigit() else None


def candidate(part: bytes) -> dict:
    """What may be a record, from the bytes between two magics: where it would end, and its payload's digest if that is just at this part's end. A record with magic in its payload ends in a later part, and has no digest here."""
    row = dict.fromkeys(("next", "exit", "type", "page_id", "refers_to", "declared", "payload_bytes", "payload_digest"))
    found = _header(part)
    if not found or found[1] < len(part) or found[1] == len(part) and part[-4:] != b"\r\n\r\n":
        return row
    body, end, head = found
    row |= {"next": end, "type": head.get(b"WARC-Type", b"").decode(), "page_id": _number(head.get(b"WARC-Record-ID", b"")), "refers_to": _number(head.get(b"WARC-Refers-To", b"")), "declared": head.get(b"WARC-Payload-Digest", b"").decode().rpartition(":")[2]}
    if end == len(part):
        payload = _payload(part[body : end - 4])
        row |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}
    return row


def _parts(path: str, spark, magic: str) -> DataFrame:
    """(file, block, value): the bytes between magics of all files below a path. Files are read by ranges of bytes, the blocks, each by a task of its own; those compressed by gzip in one."""
    return spark.read.text(path, lineSep=magic).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), (x.as_py() for x in batch.column(2)), strict=True)


def chain_rows(path: str, spark, magic: str) -> DataFrame:
    """Candidates of all files: offset, successor (null if the candidate can't be a record) and exit, where the chain leaves the candidate's block. What a file has before its first magic is a row without successor.

    A task knows places within its block only; the blocks' own places follow from the sizes of those before them.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), parts in groupby(_in_blocks(batches), key=lambda x: x[:2]):
            rows, at = [], 0
            for _, _, part in parts:
                row = candidate(part) if block or at else candidate(b"")  # before a file's first magic there is no record
                row |= {"file": file, "block": block, "offset": at - len(magic), "size": len(part) + len(magic)}
                row["next"] = None if row["next"] is None else at + row["next"]
                at += row["size"]
                rows.append(row)
            exits: dict[int, int | None] = {}
            for row in reversed(rows):
                row["exit"] = exits[row["offset"]] = exits.get(row["next"], row["next"])
            for lo in range(0, len(rows), 10_000):
                yield pa.record_batch([pa.array([r[k] for r in rows[lo : lo + 10_000]], t) for k, t in _FIELDS], schema=pa.schema(_FIELDS))

    return _placed(cut(_parts(path, spark, magic).mapInArrow(scan, _DDL)), ("offset", "next", "exit"))


def _bases(rows: DataFrame) -> DataFrame:
    """(file, block, _base): the place of each block's first part, from the sizes of those before it; a row for each range of bytes that a task reads."""
    sums = rows.groupBy("file", "block").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("file", "block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))


def _placed(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return rows.join(_bases(rows), ["file", "block"]).withColumns({c: F.col(c) + F.col("_base") for c in columns}).drop("_base")


def reachable(rows: DataFrame) -> DataFrame:
    """(file, offset) of the block entries that the chain from the file's start reaches, by pointer jumping.

    Each round joins the reached entries with jumps of double length, so the rounds grow with the logarithm of the blocks of a file.
    """
    start = rows.where("offset = 0").select("file", "offset")
    entries = rows.where("exit is not null").select("file", F.col("exit").alias("offset")).unionByName(start).distinct()
    jumps = cut(rows.select("file", "offset", "exit").join(entries, ["file", "offset"], "left_semi"))
    reached, count = start, 0
    while True:
        reached = cut(reached.unionByName(reached.join(jumps, ["file", "offset"]).where("exit is not null").select("file", F.col("exit").alias("offset"))).distinct())
        now = reached.count()
        if now == count:
            return reached
        count = now
        far = jumps.select("file", F.col("offset").alias("exit"), F.col("exit").alias("_to"))
        jumps = cut(jumps.join(far, ["file", "exit"]).where("_to is not null").select("file", "offset", F.col("_to").alias("exit")))


def _follow(table: pa.Table) -> pa.Table:
    """The candidates of one block that are met from its entries."""
    to = dict(zip(table["offset"].to_pylist(), table["next"].to_pylist(), strict=True))
    on: set[int] = set()
    for at in table.filter(table["entry"])["offset"].to_pylist():
        while at in to and at not in on:
            on.add(at)
            at = to[at]
    return table.filter(pa.array([x in on for x in table["offset"].to_pylist()], pa.bool_())).drop_columns(["entry"])


def read_warc(path: str, spark, version: str = "1.0") -> DataFrame:
    """The records of all files, in no order: only those on the chain of boundaries from the start of their file, so magic within payloads is no record. What a broken file holds from its first wrong boundary on is left out."""
    magic = f"WARC/{version}\r\n"
    rows = cut(chain_rows(path, spark, magic))
    marked = rows.join(reachable(rows).withColumn("_entry", F.lit(True)), ["file", "offset"], "left").select(*rows.columns, F.coalesce("_entry", F.lit(False)).alias("entry"))
    found = cut(marked.groupBy("file", "block").applyInArrow(_follow, rows.schema).where("next is not null").drop("block", "size", "exit"))
    whole, torn = found.where("payload_digest is not null"), found.where("payload_digest is null")
    n = torn.count()
    if not n:
        return whole
    return whole.unionByName(_mended(path, spark, magic, rows, torn, F.broadcast if n <= BROADCAST_ROWS else lambda df: df).select(whole.columns))


def _mended(path: str, spark, magic: str, rows: DataFrame, torn: DataFrame, small) -> DataFrame:
    """Records with magic in their payload, with payload_bytes and payload_digest: their parts are read again and joined, record by record. Records that their file cuts short are left out."""

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), parts in groupby(_in_blocks(batches), key=lambda x: x[:2]):
            at = 0
            for _, _, part in parts:
                yield pa.record_batch([pa.array([file]), pa.array([block], pa.int64()), pa.array([at - len(magic)], pa.int64()), pa.array([part], pa.binary())], names=["file", "block", "place", "part"])
                at += len(part) + len(magic)

    files = small(torn.select("file").distinct())
    parts = _parts(path, spark, magic).mapInArrow(lay, "file string, block long, place long, part binary").join(files, "file", "left_semi")
    bases = cut(_bases(rows))  # a row for each range of bytes
    parts = parts.join(F.broadcast(bases) if bases.count() <= BROADCAST_ROWS else bases, ["file", "block"]).withColumn("place", F.col("place") + F.col("_base"))
    held = parts.join(small(torn.select("file", "offset", "next")), "file").where("place >= offset and place < next").select("file", "offset", "place", "part")

    def joined(table: pa.Table) -> pa.Table:
        order = table.sort_by("place")
        record = magic.encode().join(x.as_py() for x in order["part"])
        found = _header(record)
        keys = [order["file"][:1], order["offset"][:1]]
        if not found or found[1] != len(record) or record[-4:] != b"\r\n\r\n":
            return pa.table([*keys, pa.array([None], pa.int64()), pa.array([None], pa.string())], names=["file", "offset", "_bytes", "_digest"])
        payload = _payload(record[found[0] : found[1] - 4])
        return pa.table([*keys, pa.array([len(payload)], pa.int64()), pa.array([hashlib.sha256(payload).hexdigest()])], names=["file", "offset", "_bytes", "_digest"])

    done = held.groupBy("file", "offset").applyInArrow(joined, "file string, offset long, _bytes long, _digest string").where("_digest is not null")
    return torn.drop("payload_bytes", "payload_digest").join(done, ["file", "offset"]).withColumnsRenamed({"_bytes": "payload_bytes", "_digest": "payload_digest"})


def records(path: str, spark) -> DataFrame:
    """One row per record: (page_id, payload_bytes, payload_digest, record_type, refers_to), of the full payload also for revisits, which take it from the record they name."""
    rows = cut(read_warc(path, spark))
    whole = rows.where("type = 'response'").select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    source = whole.groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("declared")).agg(F.max("payload_bytes").alias("_bytes"))
    again = rows.where("type = 'revisit'").select("page_id", "refers_to", "declared").join(source, ["refers_to", "declared"], "left")
    return whole.unionByName(again.select("page_id", F.col("_bytes").alias("payload_bytes"), F.col("declared").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    path = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return records(path, spark).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
