"""Text quality by a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

#: Chunks are two neighbouring halves of so many bytes, so each overlaps the next by half.
HALF = 256
#: Learned filters, bytes that each sees, and lags at which a byte counts as an echo.
FILTERS, WIDTH, LAGS = 16, 5, 32
#: Bytes 0 before, between and after texts, so that neither filters nor echoes reach from one text into another.
GAP = 48
#: Labelled documents used for fitting at most, and bytes of their whole texts at most.
SAMPLE, SAMPLE_BYTES = 2000, 8 << 20
#: STEPS is the least number of batches.
EPOCHS, STEPS, BATCH, RATE = 12, 400, 64, 0.01
#: Places whose filter values are held at once in scoring.
AT_ONCE = 1 << 17
#: A document is good from this score on.
THRESHOLD = 0.3


@dataclass
class Network:
    """Filters as tables (WIDTH, 512, FILTERS) over bytes and echoing bytes, and weights of the pooled values: the largest and the mean chunk mean of each filter."""

    tables: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    bias: float


def symbols(raw: np.ndarray) -> np.ndarray:
    """Bytes as 0-255, or 256 more where the eight bytes that end there stood just the same up to LAGS bytes before: an echo."""
    out = raw.astype(np.uint16)
    n = len(raw)
    if n > 10:
        eights = np.ndarray((n - 7,), np.uint64, raw.tobytes(), strides=(1,))
        echo = np.zeros(n - 7, bool)
        for k in range(2, min(LAGS, n - 8) + 1):
            echo[k:] |= eights[k:] == eights[:-k]
        out[7:] += echo.astype(np.uint16) << 8
    return out


def batched(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' symbols in one array with GAP bytes 0 around each; the starts and ends of the halves; how many halves each text has (none if empty)."""
    gap = b"\0" * GAP
    parts, starts, ends, counts, at = [gap], [], [], [], GAP
    for t in texts:
        n = -(-len(t) // HALF)
        counts.append(n)
        starts.append(at + HALF * np.arange(n))
        ends.append(np.minimum(starts[-1] + HALF, at + len(t)))
        parts += [t, gap]
        at += len(t) + GAP
    whole = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return symbols(np.frombuffer(b"".join(parts), np.uint8)), whole(starts), whole(ends), np.array(counts, np.int64)


def convolved(net: Network, s: np.ndarray) -> np.ndarray:
    """Rectified filter values at every place, for float32 speed by table look-up."""
    n = len(s)
    out = np.empty((n, FILTERS), np.float32)
    out[:] = net.shift
    for j in range(WIDTH):
        out[: n - j] += net.tables[j].take(s[j:], axis=0)
    return np.maximum(out, 0, out=out)


def half_sums(net: Network, s: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of filter values over each half, AT_ONCE places at a time; they don't depend on where the parts are cut."""
    out, lo = np.zeros((len(starts), FILTERS), np.float32), 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + AT_ONCE, "right")))
        first = int(starts[lo])
        values = convolved(net, s[first : int(ends[hi - 1]) + WIDTH])
        out[lo:hi] = np.add.reduceat(values, np.stack([starts[lo:hi], ends[lo:hi]], axis=1).reshape(-1) - first, axis=0)[::2]  # what lies between the texts is in the odd rows
        lo = hi
    return out


def pooled(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text and filter: the largest chunk mean, the mean of all halves, and the first half of the largest chunk; and the halves' lengths. sums: of filter values over each half."""
    texts = len(counts)
    top, mean, where = (np.zeros((texts, FILTERS), np.float32) for _ in range(3))
    lengths = (ends - starts).astype(np.float32)
    if not len(starts):
        return top, mean, where.astype(np.int64), lengths
    some = np.flatnonzero(counts)
    first = np.cumsum(counts[some]) - counts[some]
    pair_sum, pair_len = sums.copy(), lengths.copy()
    joined = np.ones(len(starts), bool)
    joined[first + counts[some] - 1] = False  # the last half of a text has no next one
    inner = np.flatnonzero(joined)
    pair_sum[inner] += sums[inner + 1]
    pair_len[inner] += lengths[inner + 1]
    lone = ~joined  # a lone last half is part of the chunk before, if there is one
    lone[first[counts[some] == 1]] = False
    chunk = pair_sum / pair_len[:, None]
    chunk[lone] = -1
    top[some] = np.maximum.reduceat(chunk, first, axis=0)
    mean[some] = np.add.reduceat(sums.astype(np.float64), first, axis=0) / np.add.reduceat(lengths.astype(np.float64), first)[:, None]
    same = chunk == np.repeat(top[some], counts[some], axis=0)
    places = np.where(same, np.arange(len(starts))[:, None], len(starts))
    where[some] = np.minimum.reduceat(places, first, axis=0)
    return top, mean, where.astype(np.int64), lengths


def scores(net: Network, texts: list[bytes]) -> np.ndarray:
    """One probability per text, from all its chunks; the same whichever texts it lies between."""
    s, starts, ends, counts = batched(texts)
    top, mean, _, _ = pooled(half_sums(net, s, starts, ends), starts, ends, counts)
    z = (np.concatenate([top, mean], axis=1) * net.weights).sum(axis=1) + net.bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def gradients(net: Network, s: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean log loss of some texts: by the tables, the shift, the weights and the bias; back-propagated through both pools."""
    values = convolved(net, s)
    sums = np.add.reduceat(values, np.stack([starts, ends], axis=1).reshape(-1), axis=0)[::2] if len(starts) else np.zeros((0, FILTERS), np.float32)
    top, mean, where, lengths = pooled(sums, starts, ends, counts)
    z = np.concatenate([top, mean], axis=1)
    p = 1 / (1 + np.exp(-np.clip(z @ net.weights + net.bias, -30, 30)))
    g = (p - y) / len(y)
    gz = g[:, None] * net.weights
    owner = np.repeat(np.arange(len(y)), counts)
    total = np.bincount(owner, lengths, len(y))
    per_half = gz[owner, FILTERS:] / total[owner][:, None]
    some = np.flatnonzero(counts)
    h, f, share = where[some], np.arange(FILTERS)[None, :], gz[some, :FILTERS]
    ahead = np.minimum(h + 1, max(len(owner) - 1, 0))
    two = (h + 1 < len(owner)) & (owner[ahead] == some[:, None])  # whether the largest chunk has a second half
    share = share / (lengths[h] + np.where(two, lengths[ahead], 0))
    np.add.at(per_half, (h, np.broadcast_to(f, h.shape)), share)
    np.add.at(per_half, (ahead, np.broadcast_to(f, h.shape)), np.where(two, share, 0))
    flow = np.zeros_like(values)
    for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        flow[a:b] = per_half[k]
    flow *= values > 0
    tables = np.empty_like(net.tables)
    for j in range(WIDTH):
        part = flow[: len(s) - j]
        for f in range(FILTERS):
            tables[j, :, f] = np.bincount(s[j:], weights=part[:, f], minlength=512)
    return [tables, flow.sum(axis=0), z.T @ g, np.array(g.sum())]


def fitted(texts: list[bytes], labels: list[int], seed: int = 7) -> Network:
    """A network fitted by Adam to whole texts; without labels of both kinds it scores all texts alike."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.25, (WIDTH, 512, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32), 0.0)
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        net.weights[:] = 0
        net.bias = 3.0 if labels and labels[0] else -3.0 if labels else 0.0
        return net
    net.bias = float(np.log(y.mean() / (1 - y.mean())))
    ready = [batched([t]) for t in texts]
    params = [net.tables, net.shift, net.weights, np.array(net.bias, np.float32)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(texts)))):  # few documents are gone through more often
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            take = order[at : at + BATCH]
            s = np.concatenate([ready[i][0] for i in take])
            counts = np.concatenate([ready[i][3] for i in take])
            shifts = np.cumsum([0, *(len(ready[i][0]) for i in take[:-1])])
            starts, ends = (np.concatenate([ready[i][k] + d for i, d in zip(take, shifts, strict=True)]).astype(np.int64) for k in (1, 2))
            grads = gradients(net, s, starts, ends, counts, y[take])
            grads[2] += 1e-3 * net.weights
            step += 1
            for p_, g_, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g_ - m)
                v += 0.001 * (g_ * g_ - v)
                p_ -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            net.bias = float(params[3])
    return net


def held_out(doc_id):
    """Whether a document's label is kept from fitting: crc32 of its id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, size: int) -> list[tuple[int, bytes, int]]:
    """(doc_id, text, quality) of labelled documents that aren't held out: the bounded part of the corpus that the driver gathers for fitting.

    Documents are taken by the least hash of their id, at most `rows`, and as many whole texts as `size` bytes hold; a text that doesn't fit is passed over. Rows without label or text are left out; of texts that share an id the least counts, of its labels the least.
    """
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").where(F.octet_length("text") > 0)
    sizes = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("doc_id", "quality", F.octet_length("text").alias("size"))
    taken, total = [], 0
    for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if total + r.size <= size:
            taken.append((r.doc_id, r.quality))
            total += r.size
    few = docs.sparkSession.createDataFrame(taken, "doc_id long, quality int")
    found = texts.join(F.broadcast(few), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    return sorted((r.doc_id, r.text.encode(), r.quality) for r in found)


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    """A network from whole texts of at most SAMPLE labelled documents and SAMPLE_BYTES."""
    rows = labelled_sample(docs, labels, SAMPLE, SAMPLE_BYTES)
    return fitted([r[1] for r in rows], [r[2] for r in rows])


def scored(docs: DataFrame, net: Network, columns: list[str], name: str = "score") -> DataFrame:
    """`columns` of docs and a further one, `name`: the probability that a text (null: empty) is good, from every chunk of the whole text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(net)
    at = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, texts = [], utf8(batch.column(at))
            k = 0
            while k < len(texts):  # about 256 KB of text at a time bound the memory
                n, size = k, 0
                while n < len(texts) and (n == k or size + len(texts[n]) <= 1 << 18):
                    size += len(texts[n])
                    n += 1
                out.append(scores(shared.value, texts[k:n]))
                k = n
            yield pa.record_batch([*batch.columns[:at], pa.array(np.concatenate(out) if out else [], pa.float64())], names=[*columns, name])

    schema = docs.select(*columns).schema.add(name, "double")
    return docs.select(*columns, F.col("text").alias("_text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """docs without those scored below THRESHOLD; fitted on `source` (docs if not given)."""
    net = fit(source or docs, labels)
    name = "_score"
    while name in docs.columns:
        name += "_"
    return scored(docs, net, docs.columns, name).where(F.col(name) >= THRESHOLD).drop(name)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    net = fit(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, net, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
