"""Benchmark decontamination: SimHash windows, multi-index Hamming search and exact weighted-shingle similarity."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, grams, mixed, utf8, word_hashes

WORDS = 5
SIMILARITY = 0.75
#: Bits of a fingerprint, and the radius: at similarity 0.75 fingerprints of different shingles differ in 44 bits with a deviation of 6.1. Repeated shingles outweigh the others, so windows and items with such are compared without fingerprints.
BITS, RADIUS = 256, 63
#: Blocks of 16 bits; within the radius one block differs in RADIUS // BLOCKS bits at most.
BLOCKS = 16
#: Benchmark items, and bytes of them, that one index holds; larger benchmarks are gone through in as many parts as needed, one after the other.
PART, PART_BYTES = 20_000, 16 << 20
#: Places of a text that are fingerprinted at once, at most, besides a window's length.
SPAN = 2048
#: All values of a block within RADIUS // BLOCKS bits of 0.
_NEAR = np.array([v for v in range(1 << 16) if v.bit_count() <= RADIUS // BLOCKS], np.uint16)


def fingerprint_bits(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 per bit of each hash."""
    both = np.stack([mixed(hashes + np.uint64(i * 0x5851F42D4C957F2D % (1 << 64))) for i in range(BITS // 64)], axis=1)
    return (np.unpackbits(both.view(np.uint8), axis=1).astype(np.int8) << 1) - 1


def packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints from summed bits, as rows of bytes."""
    return np.packbits(sums > 0, axis=-1)


def held_values(prints: np.ndarray) -> np.ndarray:
    """For each block, which of its 2^16 values some fingerprint has."""
    out = np.zeros((BLOCKS, 1 << 16), bool)
    out[np.arange(BLOCKS), np.ascontiguousarray(prints).view(np.uint16)] = True
    return out


class Index:
    """Items' fingerprints by blocks of 16 bits: all within RADIUS of a fingerprint are found, as one of its blocks lies within RADIUS // BLOCKS bits.

    Each block has its items sorted by its value; a fingerprint probes all values that near which some item has (`held`). With fewer items than such values, the blocks themselves are held against each other, which finds the same. Of items with other fingerprints one in six shares such a block, and only these are compared in full.
    """

    def __init__(self, prints: np.ndarray, held: np.ndarray):
        self.prints, self.held = prints, held
        blocks = np.ascontiguousarray(prints).view(np.uint16)
        self.order = [np.argsort(blocks[:, b], kind="stable") for b in range(BLOCKS)]
        self.sorted = [blocks[o, b] for b, o in enumerate(self.order)]

    def within(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of wanted, item) of all pairs within RADIUS."""
        n, pairs = len(self.prints), []
        if n <= len(_NEAR):
            own, step = np.ascontiguousarray(self.prints).view(np.uint16), max(1, (1 << 18) // (n * BLOCKS))
            for at in range(0, len(wanted), step):
                apart = np.bitwise_count(np.ascontiguousarray(wanted[at : at + step]).view(np.uint16)[:, None] ^ own)
                rows, items = np.nonzero((apart <= RADIUS // BLOCKS).any(axis=2))
                pairs.append((at + rows) * n + items)
        for at in range(0, len(wanted) if n > len(_NEAR) else 0, 256):
            probes = np.ascontiguousarray(wanted[at : at + 256]).view(np.uint16)[:, :, None] ^ _NEAR
            for b in range(BLOCKS):
                rows, which = np.nonzero(self.held[b][probes[:, b]])
                values = probes[rows, b, which]
                low, high = np.searchsorted(self.sorted[b], values), np.searchsorted(self.sorted[b], values, "right")
                count = high - low
                places = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
                pairs.append(np.repeat(at + rows, count) * n + self.order[b][places])
        rows, items = np.divmod(np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64), n)
        near = np.bitwise_count(self.prints[items] ^ wanted[rows]).sum(axis=1) <= RADIUS
        return rows[near], items[near]


class Benchmark:
    """Items with their shingles, fingerprints by length, and the set of all their shingles."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.ids, self.shingles, self.sizes, prints = [], [], [], []
        self.by_shape: dict[tuple[int, int], list[int]] = defaultdict(list)
        for item, text in items:
            words = word_hashes(text)
            if not len(words):
                continue  # an item without words is in no document
            k = min(WORDS, len(words))
            found = grams(words, k)
            self.by_shape[(len(words), k)].append(len(self.ids))
            self.ids.append(item)
            self.shingles.append(np.unique(found, return_counts=True))
            self.sizes.append(len(found))
            prints.append(packed(fingerprint_bits(found).sum(axis=0, dtype=np.int64)))
        self.repeats = np.array([len(x) < n for (x, _), n in zip(self.shingles, self.sizes, strict=True)], bool)
        self.postings: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        held = held_values(np.stack(prints)) if prints else None
        self.index = {shape: Index(np.stack([prints[i] for i in at]), held) for shape, at in self.by_shape.items()}
        self.known = {k: np.unique(np.concatenate([self.shingles[i][0] for (_, kk), at in self.by_shape.items() if kk == k for i in at])) for k in {k for _, k in self.by_shape}}
        self.filter = {}
        for k, v in self.known.items():
            self.filter[k] = np.zeros(1 << 18, bool)
            self.filter[k][(v >> np.uint64(46)).astype(np.int64)] = True

    def sharing(self, shape: tuple[int, int], window: np.ndarray, least: int) -> list[int]:
        """Items of a shape that share `least` shingles with the window at least, as often as the window holds them."""
        if shape not in self.postings:
            at = self.by_shape[shape]
            of = np.concatenate([self.shingles[i][0] for i in at])
            order = np.argsort(of, kind="stable")
            self.postings[shape] = of[order], np.repeat(np.array(at), [len(self.shingles[i][0]) for i in at])[order]
        of, items = self.postings[shape]
        x, n = np.unique(window, return_counts=True)
        low, high = np.searchsorted(of, x), np.searchsorted(of, x, "right")
        held = high > low
        if not held.any():
            return []
        found = np.concatenate([items[a:b] for a, b in zip(low[held], high[held], strict=True)])
        which, place = np.unique(found, return_inverse=True)
        return which[np.bincount(place, np.repeat(n[held], (high - low)[held])) >= least].tolist()

    def leaks(self, text: bytes) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, similarity) of each item that the text holds nearly, by its most similar window.

        Only windows with enough benchmark shingles are fingerprinted: fewer can't reach the similarity with any item.
        """
        words = word_hashes(text)
        best: dict[int, tuple[float, int, int]] = {}
        found: dict[int, tuple] = {}
        for k, known in self.known.items():
            s = grams(words, k)
            at = np.flatnonzero(self.filter[k][(s >> np.uint64(46)).astype(np.int64)]) if len(s) else np.zeros(0, np.int64)
            if len(at):
                at = at[known[np.minimum(np.searchsorted(known, s[at]), len(known) - 1)] == s[at]]
            if len(at):
                hit = np.zeros(len(s) + 1, np.int64)
                hit[at + 1] = 1
                _, same = np.unique(s, return_inverse=True)
                order = np.argsort(same, kind="stable")
                last = np.full(len(s), -1)
                last[order[1:]] = np.where(same[order[1:]] == same[order[:-1]], order[:-1], -1)
                found[k] = s, at, np.cumsum(hit), np.maximum.accumulate(last)  # a window repeats a shingle if that lies in it
        for (n, k), index in self.index.items():
            if k not in found:
                continue
            s, at, hits, last = found[k]
            m = n - k + 1  # shingles of a window
            size = min(m, len(s))
            low, high = max(0, int(at[0]) - size + 1), min(int(at[-1]), len(s) - size) + 1
            if size * 4 < m * 3 or low >= high:
                continue
            # the least overlap of two sets of these sizes that are similar enough
            enough = int(np.ceil(SIMILARITY * (m + size) / (1 + SIMILARITY) - 1e-9))
            starts = full = low + np.flatnonzero(hits[low + size : high + size] - hits[low:high] >= enough)
            if not len(starts):
                continue
            again = last[full + size - 1] >= full
            seen: set[bytes] = set()
            if not self.repeats[self.by_shape[(n, k)]].any():
                full, again = full[again], again[again]
            for start, own in zip(full.tolist(), again.tolist(), strict=True):
                window = s[start : start + size]
                if own and (key := window.tobytes()) in seen:
                    continue  # an equal window lies before
                elif own:
                    seen.add(key)
                for i in self.sharing((n, k), window, enough):
                    if own or self.repeats[i]:
                        score = self.similarity(i, window)
                        if score >= SIMILARITY and score > best.get(i, (0.0,))[0]:
                            best[i] = score, start, size + k - 1
            for part in np.split(starts, np.flatnonzero(np.diff((starts - starts[0]) // SPAN)) + 1):
                bits = np.zeros((part[-1] + size - part[0] + 1, BITS), np.int32)
                np.cumsum(fingerprint_bits(s[part[0] : part[-1] + size]), axis=0, out=bits[1:])
                prints = packed(bits[part - part[0] + size] - bits[part - part[0]])
                for row, place in zip(*index.within(prints), strict=True):
                    i, start = self.by_shape[(n, k)][place], int(part[row])
                    score = self.similarity(i, s[start : start + size])
                    if score >= SIMILARITY and score > best.get(i, (0.0,))[0]:
                        best[i] = score, start, size + k - 1
        return [(self.ids[i], start, n, score) for i, (score, start, n) in sorted(best.items())]

    def similarity(self, i: int, window: np.ndarray) -> float:
        """Weighted Jaccard similarity: shingles weigh as often as they occur."""
        x, wx = self.shingles[i]
        y, wy = np.unique(window, return_counts=True)
        _, a, b = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        both = np.minimum(wx[a], wy[b]).sum()
        return float(both / (wx.sum() + wy.sum() - both))


_LEAKS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())])


class _Part:
    """Items of a benchmark, and their index, which a Python worker builds once."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.items, self.built = items, None

    def index(self) -> Benchmark:
        if self.built is None:
            self.built = Benchmark(self.items)
        return self.built


def _parts(benchmark: DataFrame) -> Iterator[tuple[_Part, bool]]:
    """The benchmark in parts of about PART items and PART_BYTES, each by itself, and whether there are several. Items and bytes bound what the driver and a broadcast hold; one item alone may be longer."""
    rows = benchmark.where("text is not null").select("item_id", "text")
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(-(-n // PART), -(-size // PART_BYTES))
    for i in range(parts):
        yield _Part([(r[0], r[1].encode()) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i).orderBy("item_id").collect()]), parts > 1


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity): each benchmark item that a document holds with weighted-shingle similarity 0.75 or more, by its best window of the item's length.

    Documents are read where they lie, once for each part of the benchmark; of several parts, each one's leaks are written before the next is broadcast. Null texts and items hold nothing. Items of fewer than five words are one shingle. Each row of docs is decided by its own text, so rows that share a doc_id have rows of their own.
    """
    ddl, out = "doc_id long, item_id long, first_word long, n_words long, similarity double", None
    for part, several in _parts(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bench = shared.value.index()
            for batch in batches:
                rows = [(d, *x) for d, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True) for x in bench.leaks(t)]
                yield pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_LEAKS)], schema=_LEAKS)

        found = docs.select("doc_id", "text").mapInArrow(run, ddl)
        if several:
            found = cut(found)
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], ddl)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark item. Each row is decided by its own text, whether its doc_id is null, repeated or neither."""
    at = docs.columns.index("text")
    for part, several in _parts(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bench = shared.value.index()
            for batch in batches:
                yield batch.filter(pa.array([not bench.leaks(t) for t in utf8(batch.column(at))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if several:
            docs = cut(docs)
            shared.destroy()
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
