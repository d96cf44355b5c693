import math
import zlib

import numpy as np

from lexspark.llm import quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.query(spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    good, bad = ([r.score for r in rows if r.held_out and labels.get(r.doc_id) == q] for q in (1, 0))
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.95
    assert sum(g >= 0.3 for g in good) / len(good) > 0.97


def some_net(seed=0):
    rng = np.random.default_rng(seed)
    return quality.Network(rng.normal(0, 0.3, (quality.WIDTH, 512, quality.FILTERS)).astype(np.float32), rng.normal(0, 0.1, quality.FILTERS).astype(np.float32), rng.normal(0, 0.5, 2 * quality.FILTERS).astype(np.float32), 0.1)


def naive_score(net, text):
    """Byte by byte and chunk by chunk, in Python's own numbers."""
    padded = b"\0" * quality.GAP + text + b"\0" * quality.GAP
    codes = []
    for i in range(len(padded)):
        eight = padded[i - 7 : i + 1]
        echo = i >= 7 and any(i - 7 - k >= 0 and padded[i - 7 - k : i + 1 - k] == eight for k in range(2, quality.LAGS + 1))
        codes.append(padded[i] + 256 * echo)
    values = [[max(0.0, float(net.shift[f]) + sum(float(net.tables[j][codes[i + j]][f]) for j in range(quality.WIDTH))) for f in range(quality.FILTERS)] for i in range(quality.GAP, quality.GAP + len(text))]
    halves = [values[i : i + quality.HALF] for i in range(0, len(values), quality.HALF)]
    chunks = [a + b for a, b in zip(halves, halves[1:], strict=False)] or halves
    mean = lambda rows, f: sum(r[f] for r in rows) / len(rows)
    pools = [max((mean(c, f) for c in chunks), default=0.0) for f in range(quality.FILTERS)] + [mean(values, f) if values else 0.0 for f in range(quality.FILTERS)]
    z = net.bias + sum(float(w) * x for w, x in zip(net.weights, pools, strict=True))
    return 1 / (1 + math.exp(-z))


def test_scores_equal_brute_force_wherever_texts_lie(monkeypatch):
    rng = np.random.default_rng(0)
    net = some_net()
    texts = [b"", b"a", b"ab" * 40, "é漢 text".encode() * 70, bytes(rng.integers(97, 123, 1500, dtype=np.uint8)), b"x" * 256, b"x" * 257, bytes(rng.integers(0, 256, 1024, dtype=np.uint8))]
    got = quality.scores(net, texts)
    assert np.allclose(got, [naive_score(net, t) for t in texts], atol=1e-4)
    assert (got == np.array([quality.scores(net, [t])[0] for t in texts])).all()
    monkeypatch.setattr(quality, "AT_ONCE", 600)  # parts of any size give the same numbers
    assert (quality.scores(net, texts) == got).all()


def test_gradients_equal_finite_differences():
    net = some_net(1)
    net.tables, net.shift, net.weights = (x.astype(np.float64) for x in (net.tables, net.shift, net.weights))
    rng = np.random.default_rng(2)
    texts, y = [b"some words " * 60, b"", b"$$$ ### !!" * 40, b"short"], np.array([1.0, 0, 0, 1])
    s, starts, ends, counts = quality.batched(texts)
    loss = lambda: -np.mean(np.log(np.where(y == 1, p := quality.scores(net, texts), 1 - p)))
    grads = quality.gradients(net, s, starts, ends, counts, y)
    for param, grad in ((net.weights, grads[2]), (net.shift, grads[1]), (net.tables, grads[0])):
        for _ in range(12):
            at = tuple(int(rng.integers(n)) for n in param.shape)
            if param is net.tables:
                at = (at[0], int(s[rng.integers(len(s))]), at[2])
            old = float(param[at])
            sides = []
            for step in (3e-3, -3e-3):
                param[at] = old + step
                sides.append(loss())
            param[at] = old
            slope = (sides[0] - sides[1]) / 6e-3
            assert abs(slope - float(grad[at])) < 2e-3 + 0.05 * abs(slope), (at, slope, grad[at])


def test_the_sample_is_bounded_in_rows_and_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(40)] + [(5, "a second text")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2, "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fitted", lambda texts, labels: seen.append((texts, labels)))
    for rows, size in ((2000, 1 << 20), (7, 1 << 20), (2000, 2000)):
        monkeypatch.setattr(quality, "SAMPLE", rows)
        monkeypatch.setattr(quality, "SAMPLE_BYTES", size)
        quality.fit(docs, labels)
    free = [i for i in range(40) if zlib.crc32(b"%d" % i) % 5]
    assert sorted(map(len, seen[0][0])) == sorted(len("a second text" if i == 5 else f"text {i} " * 50) for i in free)
    assert len(seen[1][0]) == 7 and 0 < sum(map(len, seen[2][0])) <= 2000


def test_every_byte_counts():
    net = quality.fitted([b"fine words here. " * 20, b"$$$ ### !!" * 30] * 8, [1, 0] * 8)
    text = b"fine words here. " * 400
    assert quality.scores(net, [text])[0] > quality.scores(net, [text + b"$$$ ### !!" * 60])[0]


def test_odd_and_empty(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, None, "x"), (2, 0, None, "x"), (None, 1, None, "x"), (3, None, None, "x"), (6, 1, 0, "x"), (6, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    net = quality.fit(odd_docs, labels)
    rows = quality.scored(odd_docs, net, ["doc_id"]).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.scored(no_docs, quality.fit(no_docs, labels), ["doc_id"]).collect() == []
    assert quality.keep_good(odd_docs, labels.where("false")).columns == odd_docs.columns
