"""Near-duplicate groups by SetSketch registers, banding, joint likelihood and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mixed, shingles, utf8

WORDS = 5
#: Documents are linked from this similarity on, in hundredths.
PERCENT = 75
#: Bands and registers in each: at similarity 0.75 two documents share no band with probability 5e-6.
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: Base of the register scale: values are floor(1 - log_base of the least exponential variate).
BASE = 1.005
#: Log-likelihood by which 0.75 may be less likely than the best estimate before a pair is left out (about 5.5 standard deviations).
SLACK = 15.0
#: Equal registers that a pair has at least to be looked at: two of similarity 0.75 have fewer with probability 1e-8, and nearly all that have fewer fall to the likelihood too, which costs far more.
EQUAL = 67
#: Members, and shingles of all members, of a block in which a mixed bucket is compared; larger buckets are dealt in pairs of blocks.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 21
#: Pairs whose registers are compared at once.
AT_ONCE = 1 << 15

_SEEDS = mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def registers(distinct: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes (not empty). The registers of a union are the maxima of the parts' registers."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max)
    for at in range(0, len(distinct), 512):
        part = distinct[at : at + 512]
        np.minimum(least, (part[:, None] * _SEEDS).min(axis=0), out=least)
    # the least of n uniform variates, as an exponential one; the scale is cut off at both ends
    u = (least.astype(np.float64) + 1.0) * 2.0**-64
    h = -np.log1p(-np.minimum(u, 1 - 2.0**-53))
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, 65535).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of each row of registers; its last five bits are the band's number."""
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), (len(regs), BANDS))
    of = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    for i in range(ROWS):
        h = mixed(h * np.uint64(0xD6E8FEB86659FD93) + of[:, :, i])
    return (h & ~np.uint64(BANDS - 1)) | np.arange(BANDS, dtype=np.uint64)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def estimated(n_a: np.ndarray, n_b: np.ndarray, above: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The likeliest similarity of pairs, or -1 where they can hardly reach the one asked for: from set sizes, and from how many registers of the first are above and below the second's.

    The joint likelihood is taken over a grid from 0 to the largest similarity that the sizes allow; a pair stays unless its best above the similarity asked for is much less likely than its best of all. Pairs with fewer than EQUAL equal registers are left out without it.
    """
    some = REGISTERS - above - below >= EQUAL
    if not some.all():
        out = np.full(len(some), -1.0)
        if some.any():
            out[some] = estimated(n_a[some], n_b[some], above[some], below[some])
        return out
    u = n_a / (n_a + n_b)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    need = PERCENT / 100
    even = REGISTERS - above - below
    best, reach, at = np.full(len(u), -np.inf), np.full(len(u), -np.inf), np.zeros(len(u))
    for j in [*np.linspace(0, 1, 41), need, top]:
        hi, lo = _p(np.maximum(u - v * j, 0)), _p(np.maximum(v - u * j, 0))
        like = above * np.log(np.maximum(hi, 1e-9)) + below * np.log(np.maximum(lo, 1e-9)) + even * np.log(np.maximum(1 - hi - lo, 1e-9))
        like = np.where(j <= top + 1e-12, like, -np.inf)
        at = np.where(like > best, j, at)
        best = np.maximum(best, like)
        reach = np.where(j >= need - 1e-12, np.maximum(reach, like), reach)
    return np.where((top >= need - 1e-12) & (reach >= best - SLACK), at, -1.0)


_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key_a", pa.int64()), ("key_b", pa.int64()), ("regs", pa.binary())])
_SKETCH_DDL = "doc_id long, n_shingles long, key_a long, key_b long, regs binary"


def sketches(docs: DataFrame) -> DataFrame:
    """Set size, a digest of the whole shingle set and the registers of each document; registers are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                found = np.unique(shingles(text, WORDS))
                if len(found):
                    keys = [int(mixed(found + np.uint64(s)).sum(dtype=np.uint64).astype(np.int64)) for s in (1, 2)]
                    out.append((doc, len(found), *keys, registers(found).tobytes()))
                else:
                    out.append((doc, 0, 0, 0, None))
            yield pa.record_batch([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_SKETCH)], schema=_SKETCH)

    return docs.select("doc_id", "text").mapInArrow(run, _SKETCH_DDL)


def _registers(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, REGISTERS)


def band_rows(classes: DataFrame) -> DataFrame:
    """(id, n_shingles, key): a row for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                keys = band_keys(_registers(batch.column(2).to_pylist())).astype(np.int64).reshape(-1)
                take = np.repeat(np.arange(len(batch)), BANDS)
                yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), pa.array(keys)], names=["id", "n_shingles", "key"])

    return classes.select("id", "n_shingles", "regs").mapInArrow(run, "id long, n_shingles long, key long")


def hub_links(classes: DataFrame, buckets: DataFrame) -> DataFrame:
    """(a, b): for each class the hub that it is likeliest to be near, of those of its buckets. A hub is the smallest id of its bucket, so b < a.

    buckets: (id, key, hub). Pairs that the registers rule out are left out.
    """
    pairs = buckets.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("regs").alias(f"r_{x}"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                a, b, na, nb, ra, rb = (batch.column(i) for i in range(6))
                x, y = _registers(ra.to_pylist()), _registers(rb.to_pylist())
                score = estimated(np.asarray(na, float), np.asarray(nb, float), (x > y).sum(axis=1), (x < y).sum(axis=1))
                yield pa.record_batch([a, b, pa.array(score)], names=["a", "b", "score"]).filter(pa.array(score >= 0))

    scored = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(keep, "a long, b long, score double")
    return scored.groupBy("a").agg(F.max_by("b", F.struct("score", -F.col("b"))).alias("b"))


class _Groups:
    """Union-find over the groups that a task meets."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.root(x)] = self.root(y)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets, as sorted arrays without repeats, reach the similarity."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < PERCENT * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _block_links(group: pd.DataFrame) -> pd.DataFrame:
    """Links between members of two blocks (or within one) of a bucket that lie in different groups; those likeliest to be near are looked at first, and no pair whose groups are joined by then."""
    left, right = np.flatnonzero(group["_left"]), np.flatnonzero(group["_right"])
    out = []
    if len(left) and len(right):
        ids, labels, sizes = (group[c].to_numpy() for c in ("id", "label", "n_shingles"))
        regs = _registers(group["regs"])
        columns = np.ascontiguousarray(regs.T)
        keys = band_keys(regs)
        band = int(group["key"].iloc[0]) & (BANDS - 1)
        same = group["_lo"].iloc[0] == group["_hi"].iloc[0]
        groups, sets, raw = _Groups(), {}, group["set"].to_numpy()
        step = max(1, AT_ONCE // len(right))
        for lo in range(0, len(left), step):
            part = left[lo : lo + step]
            m, n = sizes[part][:, None], sizes[right][None, :]
            ok = (labels[part][:, None] != labels[right][None, :]) & (np.minimum(m, n) * 100 >= PERCENT * np.maximum(m, n))
            if same:
                ok &= ids[part][:, None] < ids[right][None, :]
            if 8 * np.count_nonzero(ok) > ok.size:  # most pairs: register by register, which gathers no rows
                even = np.zeros(ok.shape, np.uint8)
                for r in columns:
                    even += r[part][:, None] == r[right][None, :]
                ok &= even >= EQUAL
                at = np.nonzero(ok)
                i, j = part[at[0]], right[at[1]]
            else:
                at = np.nonzero(ok)
                i, j = part[at[0]], right[at[1]]
                enough = np.count_nonzero(regs[i] == regs[j], axis=1) >= EQUAL
                i, j = i[enough], j[enough]
            first = ~(keys[i, :band] == keys[j, :band]).any(axis=1)  # else an earlier band's bucket holds both
            i, j = i[first], j[first]
            score = estimated(sizes[i].astype(float), sizes[j].astype(float), (regs[i] > regs[j]).sum(axis=1), (regs[i] < regs[j]).sum(axis=1))
            for k in np.argsort(-score, kind="stable")[: int((score >= 0).sum())]:
                a, b = int(i[k]), int(j[k])
                x, y = groups.root(int(labels[a])), groups.root(int(labels[b]))
                if x != y:
                    for n in (a, b):
                        if n not in sets:
                            sets[n] = np.frombuffer(raw[n], np.uint64)
                    if similar(sets[a], sets[b]):
                        groups.join(x, y)
                        out.append((x, y))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def rest_links(classes: DataFrame, buckets: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between the groups of a bucket's members; each pair of members is looked at in the first band it shares.

    Only buckets that hold several groups are looked at. One of more than BLOCK members or BLOCK_SHINGLES shingles is dealt in pairs of blocks, so no task holds a whole hot bucket and yet every pair of its members meets: the size of a bucket decides how it is dealt, not what is found. Its largest group has blocks of its own, which are held against the others' only, so a large group with few others costs in proportion to its members. A task gives back links alone, and only such as join groups that its earlier links haven't.
    """
    named = buckets.join(labels, "id", "left").select("id", "n_shingles", "key", F.coalesce("label", "id").alias("label"))
    of = lambda n, s: F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(s) / BLOCK_SHINGLES)).cast("int")
    kinds = named.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.count(F.lit(1)).alias("_n"), F.sum("n_shingles").alias("_s")).where("_low <> _high")
    rows = cut(named.join(kinds.select("key", of("_n", "_s").alias("_k")), "key"))
    hot = rows.where("_k > 1").drop("_k")
    groups = hot.groupBy("key", "label").agg(F.count(F.lit(1)).alias("_n"), F.sum("n_shingles").alias("_s"))
    tops = groups.groupBy("key").agg(F.max(F.struct("_n", "label", "_s")).alias("_top"), F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
    tops = tops.select("key", F.col("_top.label").alias("_of"), F.col("_top._n").alias("_tn"), F.col("_top._s").alias("_ts"), (F.col("_n") - F.col("_top._n")).alias("_n"), (F.col("_s") - F.col("_top._s")).alias("_s"))
    hot = hot.join(tops.select("key", "_of", of("_tn", "_ts").alias("_first"), of("_n", "_s").alias("_more")), "key")
    place = lambda k: F.pmod(F.xxhash64("id"), F.col(k)).cast("int")
    top = F.col("label") == F.col("_of")
    end = F.col("_first") + F.col("_more") - 1  # blocks of the largest group come first, then the others'
    hot = hot.withColumns({"_i": F.when(top, place("_first")).otherwise(F.col("_first") + place("_more")), "_js": F.sequence(F.when(top, F.col("_first")).otherwise(F.lit(0)), end)})
    small = rows.where("_k = 1").withColumns({"_i": F.lit(0), "_js": F.array(F.lit(0))})
    columns = ["key", "id", "label", "n_shingles", "_i"]
    dealt = small.select(*columns, "_js").unionByName(hot.select(*columns, "_js")).select(*columns, F.explode("_js").alias("_j"))
    dealt = dealt.select("key", "id", "label", "n_shingles", F.least("_i", "_j").alias("_lo"), F.greatest("_i", "_j").alias("_hi"), (F.col("_i") <= F.col("_j")).alias("_left"), (F.col("_i") >= F.col("_j")).alias("_right"))
    dealt = dealt.join(classes.select("id", "regs").join(sets, "id"), "id")
    return dealt.groupBy("key", "_lo", "_hi").applyInPandas(_block_links, "a long, b long")


def shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, set) of the documents among (id): distinct shingle hashes in order, as bytes."""
    wanted = docs.select(F.col("doc_id").alias("id"), "text").join(ids, "id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([np.unique(shingles(t, WORDS)).tobytes() for t in utf8(batch.column(1))], pa.binary())], names=["id", "set"])

    return wanted.mapInArrow(sets, "id long, set binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets reach the similarity."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("set").alias(f"s_{x}"))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "s_a", "s_b").mapInArrow(confirm, "a long, b long")


def _few(spark) -> int:
    """Partitions for rows of two or three numbers, where documents' are whole texts: an eighth, which keeps the rounds' files few."""
    return -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)


def roots(links: DataFrame) -> DataFrame:
    """(id, label): the root of each id of a forest of links (a, b) from a to a smaller b, by pointer jumping: each round doubles the depth that is seen."""
    parts = _few(links.sparkSession)
    up = cut(links.select(F.col("a").alias("id"), F.col("b").alias("label")).coalesce(parts))
    while True:
        far = up.select(F.col("id").alias("label"), F.col("label").alias("_far"))
        up = cut(up.join(far, "label", "left").select("id", F.coalesce("_far", "label").alias("label"), F.col("_far").isNotNull().alias("_moved")).coalesce(parts))
        moved = not up.where("_moved").isEmpty()
        up = up.select("id", "label")
        if not moved:
            return up


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id of each connected component of (a, b) edges, for ids on an edge.

    Labels fall to the least label among neighbours, then to the label of the label, until nothing changes; the rounds grow slowly with a component's width.
    """
    parts = _few(edges.sparkSession)
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().coalesce(parts))
    labels = cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("label")).coalesce(parts))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("_near"))
        # the label's own node takes the least label seen by its members, too
        lower = labels.join(near, "id").select("id", "label", F.least("label", "_near").alias("_new"))
        seen = lower.groupBy(F.col("label").alias("id")).agg(F.min("_new").alias("_root"))
        step = cut(lower.join(seen, "id", "left").select("id", F.col("label").alias("_old"), F.least("_new", F.coalesce("_root", "_new")).alias("label")).coalesce(parts))
        if step.where("_old <> label").isEmpty():
            return step.select("id", "label")
        far = step.select(F.col("id").alias("label"), F.col("label").alias("_far"))
        labels = cut(step.select("id", "label").join(far, "label", "left").select("id", F.least("label", F.coalesce("_far", "label")).alias("label")).coalesce(parts))


def unique_groups(docs: DataFrame) -> DataFrame:
    """near_groups of documents whose doc_ids are neither null nor repeated."""
    all_ = cut(sketches(docs))
    by = ["n_shingles", "key_a", "key_b"]
    classes = cut(all_.where("n_shingles > 0").groupBy(*by).agg(F.min("doc_id").alias("id"), F.min("regs").alias("regs")))  # registers are equal within a class
    rows = band_rows(classes)
    hubs = rows.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    buckets = cut(rows.join(hubs, "key"))
    sets = cut(shingle_sets(docs, buckets.select("id").distinct()))
    labels = roots(verified(hub_links(classes, buckets), sets))
    over = components(cut(rest_links(classes, buckets, labels, sets)))
    of = classes.select(*by, "id").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    of = of.join(over.select(F.col("id").alias("label"), F.col("label").alias("_over")), "label", "left").select(*by, F.coalesce("_over", "label").alias("label"))
    found = all_.select("doc_id", *by).join(of, by, "left")
    group = F.when(F.col("n_shingles") > 0, F.col("label")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", group.alias("component_id"), (F.col("doc_id") == group).alias("kept"))


def _keyed(docs: DataFrame) -> DataFrame | None:
    """Rows as (_row, _key) with a key of their own each, if a doc_id is null or repeated; else None.

    Of rows that share a doc_id the first by text has it as key; the keys of the others and of rows without doc_id come after all ids. Rows without doc_id are shuffled by nothing, and of repeated ids only the first row's number is aggregated, so neither gathers in a task. Keys of ids beyond 2**62 are shifted down; ids must lie within 2**63 of each other.
    """
    again = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id")
    if again.isEmpty():
        return None
    again = cut(again)
    least, top = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, top = (least or 0), (top or 0)
    shift = max(0, min(top - (1 << 62), low + (1 << 63)))
    key, after = F.col("doc_id") - F.lit(shift).cast("long"), F.lit(top - shift + 1).cast("long")
    one = docs.join(again.where("doc_id is not null"), "doc_id", "left_anti").where("doc_id is not null")
    more = docs.where("doc_id is null").unionByName(docs.join(again.where("doc_id is not null"), "doc_id", "left_semi").select(docs.columns))
    more = cut(more.select("doc_id", F.col("text").alias("_text"), F.struct(*docs.columns).alias("_row"), F.monotonically_increasing_id().alias("_m")))
    first = more.where("doc_id is not null").groupBy("doc_id").agg(F.min_by("_m", F.struct("_text", "_m")).alias("_m")).select("_m", F.lit(True).alias("_first"))
    more = more.join(first, "_m", "left").select("_row", F.when(F.col("_first"), key).otherwise(after + F.col("_m")).alias("_key"))
    return cut(one.select(F.struct(*docs.columns).alias("_row"), key.alias("_key")).unionByName(more))


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row; component_id is the smallest doc_id that links reach.

    Documents with equal shingle sets form one class; its smallest doc_id stands for it. Classes are sketched and banded, and each is first held against the likeliest hub of its buckets; then what lies in different groups of one bucket is compared. All links that count are confirmed on full sets; pairs within a group that is known already are left unlooked at. Empty sets are linked with nothing. Rows that share a doc_id are documents of their own; component_id is null, and kept false, in groups without any doc_id.
    """
    slim = docs.select("doc_id", "text")
    rows = _keyed(slim)
    if rows is None:
        return unique_groups(slim)
    found = cut(unique_groups(rows.select(F.col("_key").alias("doc_id"), F.col("_row.text").alias("text"))).join(rows.select(F.col("_key").alias("doc_id"), F.col("_row.doc_id").alias("_own")), "doc_id"))
    least = found.groupBy("component_id").agg(F.min("_own").alias("_least"))
    return found.join(least, "component_id").select(F.col("_own").alias("doc_id"), "n_shingles", F.col("_least").alias("component_id"), F.coalesce(F.col("_own") == F.col("_least"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: that with the smallest doc_id.

    Each row is a document: of rows that share a doc_id the first by text keeps the id's place, and the others and rows without doc_id come after all ids, so they stay only if no other of their group does.
    """
    gone = lambda keyed: unique_groups(keyed).where(~F.col("kept")).select("doc_id")
    rows = _keyed(docs)
    if rows is None:
        return docs.join(gone(docs.select("doc_id", "text")), "doc_id", "left_anti").select(docs.columns)
    keyed = rows.select(F.col("_key").alias("doc_id"), F.col("_row.text").alias("text"))
    return rows.join(gone(keyed).withColumnRenamed("doc_id", "_key"), "_key", "left_anti").select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_groups(table(spark, sf_dir, "documents"))
