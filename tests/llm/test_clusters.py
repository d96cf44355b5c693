import hashlib
import math
import os

import duckdb
import numpy as np
import pytest

from lexspark.llm import clusters

DDL = "vec_id long, embedding array<float>, label int, cluster int, distance long, values string"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 1, 9, 9, "x") for i, e in rows], DDL)


def brute(rows, dims=64, rounds=10):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [e for _, e in sorted(kept, key=key)[:8]]
    nearest = lambda e: min((sum((a - b) ** 2 for a, b in zip(e, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(e)[1] for _, e in kept]
        for c in set(own):
            mine = [e for (_, e), o in zip(kept, own, strict=True) if o == c]
            centroids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, *nearest(e)) for i, e in kept]
    most = (1 << 63) - 1
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    held = lambda c: min(most, sum(min(most, d) for _, d, n in found if n == c or c is None))
    return sorted(((i, c, min(most, d), held(c), held(None), sha[c]) for i, d, c in found), key=str)


def check(spark, rows):
    got = clusters.clustered(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def noise(rng, n, around=None, width=0.2):
    return [(rng.normal(size=64) * width + (0 if around is None else around)).astype("f4").tolist() for _ in range(n)]


def test_odd_rows_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = list(enumerate(noise(rng, 60)))
    rows += [(3, rows[3][1]), (None, noise(rng, 1)[0]), (None, None), (70, None), (71, []), (72, [0.5] * 63), (73, [0.5] * 65), (74, [None] + [0.1] * 63), (75, [math.nan] + [0.1] * 63), (76, [math.inf] + [0.1] * 63), (77, [-0.0] * 64)]
    check(spark, rows)


def test_ties_copies_and_empty_clusters(spark):
    same = [0.25] * 64
    check(spark, [(i, same) for i in range(20)] + [(i, [-0.25] * 64) for i in range(20, 23)])
    check(spark, [(1, same), (2, [0.5] * 64)])  # fewer vectors than centroids


def test_huge_components_are_exact(spark):
    rng = np.random.default_rng(2)
    check(spark, list(enumerate(noise(rng, 12))) + [(90 + i, e) for i, e in enumerate(noise(rng, 6, 1e30, 1e29))] + [(99, [3e38] * 64), (98, [-3e38] * 64)])


def test_empty_table(spark):
    got = clusters.clustered(frame(spark, []))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and got.count() == 0


def test_search_rules_out_centroids_and_keeps_ties():
    rng = np.random.default_rng(3)
    centroids = np.concatenate([rng.integers(-9, 9, (6, 64)) + 200 * np.arange(6)[:, None], np.full((1, 64), 400), np.full((1, 64), 400)])
    vectors = np.concatenate([rng.integers(-9, 9, (500, 64)) + 200 * rng.integers(0, 6, (500, 1)), np.full((3, 64), 400)])
    search = clusters.Searcher(centroids.tolist())
    which, d = search.nearest(vectors.astype(float))
    all_d = ((vectors[:, None] - centroids) ** 2).sum(axis=2)
    assert (which == all_d.argmin(axis=1)).all() and (d == all_d.min(axis=1)).all()
    assert search.tested < 2.5 * len(vectors)


@pytest.mark.parametrize("value", [0, 1, -1, (1 << 31) - 1, 1 << 31, -(1 << 31), -(1 << 31) - 1, 12345678901234567890123, -98765432109876543210])
def test_digits_add_up(value):
    assert sum(d * clusters.DIGIT**i for i, d in enumerate(clusters.digits(value))) == value


def test_query_equals_its_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{os.path.join(small, 'embeddings.parquet')}')")
    want = con.execute(clusters.oracle())
    columns = [c[0] for c in want.description]
    got = clusters.query(spark, small)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())
