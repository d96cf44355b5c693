"""Token ids: encoding with public tokenizers, and Parquet token files with list columns."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, cut, piece_hashes, scratch, utf8

#: Bytes of texts that are encoded at a time, at least.
TOGETHER = 1 << 18
#: Places for words whose ids are kept, and kept ids beyond which all are let go.
PLACES, KEPT = 1 << 21, 1 << 23

#: Bytes by class: 1 for white space, 2 for the mark between texts, 0 for all others.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 10, 13, 32]] = 1
_CLASS[0] = 2
#: Bytes that are, or may start, white space or controls of other kinds.
_ODD = np.zeros(256, bool)
_ODD[[*range(9), 11, 12, *range(14, 32), 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: The white space among them, in UTF-8: U+0085, U+00A0, U+1680, U+2000-U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
_SPACES = frozenset(chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
_PROBES = ("", "a", " a", "  a", "a  b", "a \n b", "\n\na\tb \r\n", "it's we'll DON'T 'S can't ''", "x1 22 3.14 (a-b) c", "éÀ ß ſ İ ǅ Σας 漢字 😀 “q”", "\t\t a \t ", "a\nb \n", " 's 'll a's", "e\u0301 \u0301e")


def _plain(text: bytes) -> bool:
    """Whether a text has no white space but tabs, line ends and spaces, and no controls."""
    raw = np.frombuffer(text, np.uint8)
    for at in np.flatnonzero(_ODD[raw]).tolist():
        if raw[at] < 32 or text[at : at + 2] in _SPACES or text[at : at + 3] in _SPACES:
            return False
    return True


def _parts(text: bytes) -> list[bytes]:
    """A long text cut before single spaces between words, where no piece of it ends but all that end there."""
    out, at = [], 0
    while len(text) - at > 2 * TOGETHER:
        m = _BETWEEN.search(text, at + TOGETHER)
        if not m:
            break
        out.append(text[at : m.start() + 1])
        at = m.start() + 1
    return [*out, text[at:]]


_BETWEEN = re.compile(rb"[^ \t\r\n] [^ \t\r\n]")


class Encoder:
    """Ids of whole texts by a tokenizers file.

    Texts repeat their words. So a text is cut into words, each with the space before it, and runs of further white space; arrays of their 64-bit hashes are looked up in a table of PLACES words with their ids, and only words that aren't there go through the tokenizer. Tokenizers that cut at white space this way, or drop it, give each word the same ids as in its text; whether this one does is tried on samples when it is loaded. If not, and for texts with other white space, controls or special tokens' strings, whole texts go through it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.key = int.from_bytes(os.urandom(8), "little")  # no text can be made so that two of its words share a hash
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.blank = bool(self._ids([" \n "])[0])  # whether white space has ids
        capital, small = self._ids(["A Bc"]), self._ids(["a bc"])
        self.lower = capital == small  # whether it lowers letters itself, so words may be lowered before
        self._forget()
        self.by_words = True
        self.by_words = list(self.encode_all([t.encode() for t in _PROBES])) == [array("I", x).tobytes() for x in self._ids(list(_PROBES))]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        self.keys, self.at, self.count = np.zeros(PLACES, np.uint64), np.zeros(PLACES, np.int32), np.zeros(PLACES, np.int32)
        self.kept, self.used = np.zeros(1 << 20, np.uint32), 0

    def _new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces and how many each has. Words with a space before them go through the tokenizer as one text, which is cut again by the ids' places in it; all others one by one."""
        spaced = [x[0] == " " and len(x) > 1 and x[1] not in " \t\r\n" if self.blank else True for x in pieces]
        together = [x for x, ok in zip(pieces, spaced, strict=True) if ok]
        found = self.tokenizer.encode(("" if self.blank else " ").join(together), add_special_tokens=False)
        bounds = np.cumsum([len(x) + (not self.blank) for x in together])
        ids = np.array(found.ids, np.uint32)
        count = np.bincount(np.searchsorted(bounds, np.array([a for a, _ in found.offsets], np.int64), "right"), minlength=len(together))
        if len(count) > len(together) or (len(together) and count.min() == 0):  # places that don't tell
            spaced = [False] * len(pieces)
            together, ids, count = [], ids[:0], count[:0]
        alone = self._ids([x for x, ok in zip(pieces, spaced, strict=True) if not ok])
        if not alone:
            return ids, count
        each, sizes = iter(alone), iter(count.tolist())
        counts = np.array([next(sizes) if ok else len(next(each)) for ok in spaced], np.int64)
        out = np.empty(int(counts.sum()), np.uint32)
        of = np.repeat(np.array(spaced), counts)
        out[of] = ids
        out[~of] = [x for one in alone for x in one]
        return out, counts

    def _keep(self, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Where the ids of new words lie from now on."""
        total = len(ids)
        if self.used + total > len(self.kept):
            grown = np.zeros(2 * (self.used + total), np.uint32)
            grown[: self.used] = self.kept[: self.used]
            self.kept = grown
        self.kept[self.used : self.used + total] = ids
        at = self.used + np.cumsum(count) - count
        self.used += total
        return at

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of plain texts."""
        joined = b"\0".join([b"", *texts, b""])
        if self.lower:
            joined = joined.translate(LOWER)
        raw = np.frombuffer(joined, np.uint8)
        kind = _CLASS[raw]
        edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        start, end, of = edge[:-1], edge[1:], kind[edge[:-1]]
        word = of == 0
        first = start[word]
        first = first - (self.blank & (raw[first - 1] == 32))
        starts, ends = [first], [end[word]]
        if self.blank:
            white = of == 1
            a, b = start[white], end[white]
            last = (raw[b] == 0) | (b - a < 1)  # at a text's end the run is one piece
            inner = np.where(last, b, b - 1)
            some = inner > a
            alone = ~last & (raw[b - 1] != 32)
            starts += [a[some], b[alone] - 1]
            ends += [inner[some], b[alone]]
        start, end = np.concatenate(starts), np.concatenate(ends)
        order = np.argsort(start, kind="stable")
        start, end = start[order], end[order]
        hashes = piece_hashes(raw, start, end, self.key)
        slot = (hashes & np.uint64(PLACES - 1)).astype(np.int64)
        at, count = self.at[slot], self.count[slot]
        new = np.flatnonzero(self.keys[slot] != hashes)
        if len(new):
            _, where, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            where = new[where]
            pieces = [joined[a:b].decode() for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)]
            new_ids, new_count = self._new(pieces)
            new_at = self._keep(new_ids, new_count)
            at[new], count[new] = new_at[back], new_count[back]
            places = slot[where]
            self.keys[places] = hashes[where]  # of words with one place, numpy writes the same one last in each array
            self.at[places], self.count[places] = new_at, new_count
        total = np.cumsum(count)
        ids = self.kept[np.repeat(at - total + count, count) + np.arange(int(total[-1]) if len(total) else 0)]
        marks = np.cumsum([1, *(len(t) + 1 for t in texts)])
        cuts = np.concatenate([[0], total])[np.searchsorted(start, marks)].tolist()
        if self.used > KEPT:
            self._forget()
        out = ids.astype("<u4").tobytes()
        return [out[4 * a : 4 * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _group(self, texts: list[bytes]) -> list[bytes]:
        plain = [self.by_words and not any(s in t for s in self.special) and _plain(t) for t in texts]
        if max(map(len, texts)) > 2 * TOGETHER:
            by_words = iter([b"".join(self._encode([p])[0] for p in _parts(t)) for t, ok in zip(texts, plain, strict=True) if ok])
        else:
            by_words = iter(self._encode([t for t, ok in zip(texts, plain, strict=True) if ok]))
        whole = iter(self._ids([t.decode() for t, ok in zip(texts, plain, strict=True) if not ok]))
        return [next(by_words) if ok else array("I", next(whole)).tobytes() for ok in plain]

    def encode_all(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; about TOGETHER bytes of texts are held in pieces at a time."""
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= TOGETHER:
                yield from self._group(held)
                held, size = [], 0
        if held:
            yield from self._group(held)

    def encode(self, text: str) -> bytes:
        return self._group([text.encode()])[0]


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One encoder a Python worker: the words it keeps serve its later tasks too."""
    return Encoder(path)


def encoded(docs: DataFrame, path: str, end: int, rows: Callable, schema: pa.Schema, ddl: str) -> DataFrame:
    """docs through an Encoder: rows(doc_id, ids as bytes with the end id) yields tuples of the schema. Null texts are empty."""
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                ids = encoder.encode_all(utf8(part.column(1)))
                out = [r for d, b in zip(part.column(0).to_pylist(), ids, strict=True) for r in rows(d, b + tail)]
                yield pa.record_batch([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def token_lists(docs: DataFrame, path: str, end: int) -> DataFrame:
    """(doc_id, ids): the ids of each whole text, with the end id."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return encoded(docs, path, end, lambda d, b: [(d, np.frombuffer(b, np.int32))], schema, "doc_id long, ids array<int>")


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text) dealt by ranges of doc_id and sorted, null first, and repeated ids by text; done before encoding, as texts take less room than their ids (568 against 799 MB shuffled for 0.51 GB) and are encoded and written without a further stage."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")


def write_tokens(tokens: DataFrame, path: str, encoding: str = "dictionary", row_group: int = 16 << 20, page: int = 256 << 10) -> None:
    """Token files in the order of a (doc_id, ids) table: Parquet list columns beside their lengths.

    encoding: "dictionary", or "delta" (binary-packed differences, format version 2). Row groups and pages hold about so many bytes; the page index that the writer adds lets readers skip pages by doc_id.
    """
    options = {"parquet.block.size": str(row_group), "parquet.page.size": str(page), "parquet.enable.dictionary": str(encoding == "dictionary").lower(), "parquet.writer.version": "v1" if encoding == "dictionary" else "v2", "compression": "zstd"}
    tokens.withColumn("n_tokens", F.size("ids").cast("long")).write.options(**options).parquet(path)


def read_tokens(spark, path: str, columns: tuple[str, ...] = ("doc_id", "ids")) -> DataFrame:
    """The token files; only the columns asked for are read, so metadata reads don't touch the ids."""
    return spark.read.parquet(path).select(*columns)


def starts(spark, path: str) -> DataFrame:
    """(doc_id, start): the ids of all documents before each, from the lengths alone; one row for each row of the files."""
    return with_starts(placed(read_tokens(spark, path, ("doc_id", "n_tokens", "_metadata")))).select("doc_id", "start")


def placed(tokens: DataFrame) -> DataFrame:
    """Rows of token files with their file and place in it, the row's key, in place of `_metadata`."""
    return tokens.withColumns({"_file": F.col("_metadata.file_name"), "_at": F.col("_metadata.row_index")}).drop("_metadata")


def with_starts(rows: DataFrame) -> DataFrame:
    """Placed rows with `start`, the ids of all rows before each in the files' order: rows without doc_id are first, and rows that share a doc_id (or have none) follow each other. No row is lost or told twice.

    Files hold ranges of doc_ids in the order of their part numbers; each is cumulated by itself and shifted by those before it, of which there is a row a file.
    """
    part = F.regexp_extract("_file", r"part-(\d+)", 1).cast("long")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    shifts = rows.groupBy("_file").agg(F.sum("n_tokens").alias("_n")).select("_file", F.coalesce(F.sum("_n").over(earlier(Window.orderBy(part, "_file"))), F.lit(0)).alias("_before"))
    inner = F.coalesce(F.sum("n_tokens").over(earlier(Window.partitionBy("_file").orderBy("_at"))), F.lit(0))
    return rows.withColumn("_in", inner).join(shifts, "_file").withColumn("start", F.col("_before") + F.col("_in")).drop("_before", "_in")


def ids_crc32(tokens: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32) of a (doc_id, ids) table, over the ids as little-endian unsigned 32-bit integers; a placed table keeps its row keys."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    keys = [c for c in ("_file", "_at") if c in tokens.columns]
    schema = pa.schema([*schema, *(f for f in (pa.field("_file", pa.string()), pa.field("_at", pa.int64())) if f.name in keys)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, ends = np.asarray(lists.values).astype("<u4"), np.asarray(lists.offsets)
            crcs = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.array(crcs, pa.int64()), *batch.columns[2:]], schema=schema)

    ddl = "doc_id long, n_tokens long, ids_crc32 long" + "".join({"_file": ", _file string", "_at": ", _at long"}[c] for c in keys)
    return tokens.select("doc_id", "ids", *keys).mapInArrow(run, ddl)


def token_table(docs: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) through token files: one row for each row of docs, also where doc_id is null or repeated. Starts go by doc_id, null first, and text."""
    import public_tokenizers

    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write_tokens(token_lists(in_order(docs), public_tokenizers.path("word_bpe_49k.json"), 2), path)
    rows = cut(ids_crc32(placed(read_tokens(spark, path, ("doc_id", "ids", "_metadata")))))
    return with_starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return token_table(table(spark, sf_dir, "documents"))
