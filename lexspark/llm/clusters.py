"""Centroid clustering of integer vectors by equal-average equal-variance nearest-neighbour search."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch

#: Vectors that are searched together.
AT_ONCE = 1 << 13
#: Components up to this size keep all bounds of 64 of them within 64-bit integers; vectors with larger ones are searched in integers of any size.
SMALL = 1 << 24
#: Digits in which sums are shuffled and summed, so that they are exact at any size.
DIGIT = 1 << 31
_MOST = (1 << 63) - 1


def kept_vectors(vectors: DataFrame, dims: int, scale: int, column: str = "embedding") -> DataFrame:
    """(vec_id, values): vectors with exactly `dims` components, none null or non-finite, each component x as floor(scale * x).

    values are doubles, which hold every such floor exactly. Vectors that are null, shorter or longer aren't kept, nor those whose scaled components leave a double's range. Repeated rows and ids, and null ids, are rows of their own.
    """
    schema = pa.schema([("vec_id", pa.int64()), ("values", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            right = np.asarray(lists.value_lengths().fill_null(-1)) == dims
            ids, lists = batch.column(0).filter(pa.array(right)), lists.filter(pa.array(right))
            flat = lists.flatten().cast(pa.float64()).fill_null(math.nan)
            with np.errstate(over="ignore", invalid="ignore"):
                values = np.floor(np.asarray(flat).reshape(-1, dims) * scale)
            good = np.isfinite(values).all(axis=1)
            values = values[good]
            out = pa.ListArray.from_arrays(np.arange(0, dims * len(values) + 1, dims, dtype=np.int32), pa.array(values.reshape(-1) + 0.0))
            yield pa.record_batch([ids.filter(pa.array(good)), out], schema=schema)

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).alias("values")).where(F.size("values") == dims).mapInArrow(run, "vec_id long, values array<double>")


def spread(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of integers: the sum S of its k components, and the whole part of W = sqrt(k * (sum of squares) - S * S), k times its standard deviation."""
    k = values.shape[1]
    total = values.sum(axis=1)
    under = k * (values * values).sum(axis=1) - total * total
    if values.dtype == object:
        return total, np.array([math.isqrt(x) for x in under], object)
    return total, np.sqrt(under.astype(np.float64)).astype(np.int64)


class Searcher:
    """Nearest centroids by squared Euclidean distance; of equally near ones that with the smaller number.

    For k components d * d >= (S - S')**2 / k + (W - W')**2 / k, with sums S and k-fold deviations W. Centroids are sorted by S; each vector starts at the one whose S is nearest and goes outward, to the side that is nearer by S. When S alone rules the nearer side out, it rules out all that are left; W rules out single centroids; all others get their exact integer distance. Bounds only rule out what is farther than the best, so ties are settled exactly.
    """

    def __init__(self, centroids: list[list[int]]):
        large = max((abs(x) for c in centroids for x in c), default=0) > SMALL
        self.large = large
        self.tables = {}
        for kind in ((object,) if large else (np.int64, object)):
            values = np.array(centroids, kind).reshape(len(centroids), -1)
            total, width = spread(values)
            order = np.array(sorted(range(len(values)), key=lambda c: (total[c], c)), np.int64)
            self.tables[kind] = values[order], total[order], width[order], order
        self.tested = 0  # exact distances that were computed

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of each row of whole doubles; distances are integers of any size where they leave 64 bits."""
        n = len(vectors)
        big = np.abs(vectors).max(axis=1, initial=0) > SMALL if not self.large else np.ones(n, bool)
        if not big.any():
            return self._nearest(vectors.astype(np.int64))
        which, best = np.zeros(n, np.int64), np.zeros(n, object)
        if not big.all():
            which[~big], best[~big] = self._nearest(vectors[~big].astype(np.int64))
        whole = np.array([[int(x) for x in row] for row in vectors[big].tolist()], object)
        which[big], best[big] = self._nearest(whole)
        return which, best

    def _nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values, totals, widths, order = self.tables[object if vectors.dtype == object else np.int64]
        n, (count, k) = len(vectors), values.shape
        total, width = spread(vectors)
        right = np.searchsorted(totals, total)
        left = right - 1
        best = np.full(n, -1, vectors.dtype)
        which = np.full(n, count, np.int64)
        on = np.arange(n)
        while len(on):
            l, r = left[on], right[on]
            left_gap = np.abs(total[on] - totals[np.maximum(l, 0)])
            right_gap = np.abs(totals[np.minimum(r, count - 1)] - total[on])
            go_left = (r >= count) | ((l >= 0) & (left_gap < right_gap))
            at, gap = np.where(go_left, l, r), np.where(go_left, left_gap, right_gap)
            first = best[on] < 0
            near = first | (gap * gap <= k * best[on])  # else nothing farther out can be as near
            on, at, gap, go_left, first = on[near], at[near], gap[near], go_left[near], first[near]
            apart = np.maximum(np.abs(width[on] - widths[at]) - 2, 0)  # both widths are whole parts of roots
            test = first | (gap * gap + apart * apart <= k * best[on])
            rows, cs = on[test], at[test]
            self.tested += len(rows)
            away = vectors[rows] - values[cs]
            d = (away * away).sum(axis=1)
            closer = (best[rows] < 0) | (d < best[rows]) | ((d == best[rows]) & (order[cs] < which[rows]))
            best[rows[closer]], which[rows[closer]] = d[closer], order[cs[closer]]
            left[on[go_left]] -= 1
            right[on[~go_left]] += 1
            on = on[(left[on] >= 0) | (right[on] < count)]
        return which, best


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, len(batch), AT_ONCE):
            part = batch.slice(at, AT_ONCE)
            yield part.column(0), np.asarray(part.column(1).flatten()).reshape(-1, dims)


def digits(value: int) -> list[int]:
    """An integer as digits below DIGIT, least first; the last bears the sign."""
    out = []
    while not -DIGIT <= value < DIGIT:
        value, low = divmod(value, DIGIT)
        out.append(low)
    return [*out, value]


def cluster_sums(kept: DataFrame, centroids: list[list[int]]) -> dict[tuple[int, int], int]:
    """Exact sums by (centroid, component), and the count of vectors as component -1. Each task sends a row for each digit of its sums; Spark sums them before and after the shuffle, and the driver gets a bounded number of rows."""
    dims = len(centroids[0])
    schema = pa.schema([("c", pa.int32()), ("i", pa.int32()), ("place", pa.int32()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, sums = Searcher(centroids), {}
        for _, vectors in _blocks(batches, dims):
            which, _ = search.nearest(vectors)
            exact = np.abs(vectors).max(initial=0) <= SMALL
            for c in np.unique(which).tolist():
                own = vectors[which == c]
                total = own.astype(np.int64).sum(axis=0).tolist() if exact else [sum(map(int, column)) for column in own.T.tolist()]
                sums[c] = [a + b for a, b in zip(sums.get(c, [0] * (dims + 1)), [*total, len(own)], strict=True)]
        rows = [(c, i if i < dims else -1, place, v) for c, total in sums.items() for i, x in enumerate(total) for place, v in enumerate(digits(x))]
        yield pa.record_batch([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(schema)], schema=schema)

    found: dict[tuple[int, int], int] = {}
    for c, i, place, v in kept.select("vec_id", "values").mapInArrow(run, "c int, i int, place int, v long").groupBy("c", "i", "place").agg(F.sum("v").alias("v")).collect():
        found[c, i] = found.get((c, i), 0) + v * DIGIT**place
    return found


def first_centroids(kept: DataFrame, count: int, seed: str) -> list[list[int]]:
    """The values of the vectors with the smallest hex SHA-256 of `seed:vec_id`, in ascending order; ties by the values; null ids come last. Fewer vectors give fewer centroids."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(key.alias("key"), "values").orderBy(F.col("key").asc_nulls_last(), "values").limit(count).collect()
    return [[int(x) for x in r["values"]] for r in rows]


def clustered(vectors: DataFrame, dims: int = 64, count: int = 8, rounds: int = 10, scale: int = 1024, seed: str = "3", column: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): one row for each kept vector.

    Kept vectors are written once to the shared folder; each round reads them, and what it learns is `count` times `dims` exact sums. Only centroids, never vectors or labels, pass between driver and tasks. A centroid without vectors stays. distance and its sums are longs; what doesn't fit is the largest long. Without kept vectors there are no rows.
    """
    spark = vectors.sparkSession
    path = scratch(spark, "vectors")
    kept_vectors(vectors, dims, scale, column).write.parquet(path)
    kept = spark.read.schema("vec_id long, values array<double>").parquet(path)
    centroids = first_centroids(kept, count, seed)
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])
    ddl = "vec_id long, cluster int, distance long"
    if not centroids:
        return spark.createDataFrame([], f"{ddl}, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        found = cluster_sums(kept, centroids)
        moved = [[found[c, i] // found[c, -1] for i in range(dims)] if (c, -1) in found else old for c, old in enumerate(centroids)]
        if moved == centroids:
            break  # further rounds would change nothing
        centroids = moved

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Searcher(centroids)
        for ids, vectors in _blocks(batches, dims):
            which, d = search.nearest(vectors)
            yield pa.record_batch([ids, pa.array(which, pa.int32()), pa.array(np.minimum(d, _MOST).astype(np.int64))], schema=schema)

    labels = scratch(spark, "clusters")
    kept.mapInArrow(run, ddl).write.parquet(labels)
    rows = spark.read.schema(ddl).parquet(labels)
    sums = {r.cluster: int(r.d) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    own = F.array(*(F.lit(min(sums.get(c, 0), _MOST)).cast("long") for c in range(len(centroids))))
    return rows.select(
        "vec_id", "cluster", "distance", own[F.col("cluster")].alias("cluster_inertia"), F.lit(min(sum(sums.values()), _MOST)).cast("long").alias("inertia"), F.array(*map(F.lit, shas))[F.col("cluster")].alias("centroid_sha256")
    )


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return clustered(table(spark, sf_dir, "embeddings"))


def oracle(rounds: int = 10) -> str:
    """The same by plain comparison of all centroids, in DuckDB SQL."""
    steps = []
    for t in range(1, rounds + 2):
        steps.append(
            f"d{t} AS MATERIALIZED (SELECT v.id, c.c, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{t - 1} c USING (i) GROUP BY ALL),\n"
            f"a{t} AS MATERIALIZED (SELECT id, c, d FROM d{t} QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, c) = 1)"
        )
        if t <= rounds:
            steps.append(
                f"s{t} AS (SELECT a.c, v.i, sum(v.x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM v JOIN a{t} a USING (id) GROUP BY ALL),\n"
                f"c{t} AS MATERIALIZED (SELECT o.c, o.i, CASE WHEN s.n IS NULL THEN o.x ELSE (s.s - ((s.s % s.n) + s.n) % s.n) // s.n END AS x FROM c{t - 1} o LEFT JOIN s{t} s USING (c, i))"
            )
    last = rounds + 1
    return (
        "WITH e AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),\n"
        "v AS MATERIALIZED (SELECT id, unnest(range(64)) AS i, unnest(list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::HUGEINT)) AS x FROM e),\n"
        "f AS (SELECT id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM e QUALIFY c < 8),\n"
        "c0 AS MATERIALIZED (SELECT f.c, v.i, v.x FROM v JOIN f USING (id)),\n"
        + ",\n".join(steps)
        + f",\nh AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS sha FROM c{rounds} GROUP BY c)\n"
        f"SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha AS centroid_sha256 FROM a{last} JOIN e USING (id) JOIN h USING (c)"
    )
