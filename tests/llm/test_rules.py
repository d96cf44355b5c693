import re
import zlib
from collections import Counter
from itertools import product

import numpy as np

from lexspark.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    """Brute force of the fixed counts."""
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n


def joined(docs, got):
    """Rows with their texts; texts of rows that share an id are told apart by the counts."""
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    want = Counter((d, *base(t)) for d, t in texts)
    assert Counter(tuple(r)[:7] for r in got) == want


def columns(df):
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()


def test_base_counts_equal_brute_force(spark, odd_docs, small):
    chain = rules.fitted([])
    for docs in (odd_docs, spark.read.parquet(f"{small}/documents.parquet")):
        got = columns(rules.judged(docs, chain))
        joined(docs, got)
        assert all(r.kept != r.base_failed for r in got)  # an unfitted field finds content alone


def test_odd_texts():
    for text in ("", "\n\n", "a", " a \x0b b\r\n\n a \x0b b\r", "a b c d e f g h i " * 3, "x " * 9, "x " * 8, "a\x85b\u00a0c \u2028 d", "<a> | # é😀 &&\n" * 30, "end\n", "A b c d e f g h\na b c d e f g h"):
        x = rules.lines_of(text.encode())
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.failed) == base(text), text
        assert ((x.features >= 0) & (x.features <= 1)).all() and x.chars.sum() == x.word_chars


def random_chain(rng):
    return rules.Chain(rng.normal(size=len(rules.FEATURES)), rng.normal(size=(2, 2)), rng.normal(size=2))


def score(chain, f, y):
    return chain.first[y[0]] + sum(chain.pairs[a, b] for a, b in zip(y, y[1:], strict=False)) + sum(f[i] @ chain.weights for i in range(len(y)) if y[i])


def test_decoding_and_marginals_equal_all_label_sequences():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 8):
        chain, f = random_chain(rng), rng.normal(size=(n, len(rules.FEATURES)))
        ways = list(product((0, 1), repeat=n))
        scores = np.array([score(chain, f, y) for y in ways])
        assert tuple(rules.viterbi(chain, f)) == ways[int(scores.argmax())]
        weight = np.exp(scores - scores.max())
        weight /= weight.sum()
        padded = np.zeros((2, 9, len(rules.FEATURES)))
        padded[0, :n] = f
        padded[1, :1] = f[:1]
        p, pairs, whole = rules.marginals(chain, padded @ chain.weights, np.array([n, 1]))
        assert np.allclose(p[0, :n], np.array(ways).T @ weight) and not p[0, n:].any()
        assert np.isclose(whole[0], np.log(np.exp(scores).sum()))
        want = np.zeros((2, 2))
        for y, w in zip(ways, weight, strict=True):
            for a, b in zip(y, y[1:], strict=False):
                want[a, b] += w
        assert np.allclose(pairs, want)


def test_ties_are_content():
    assert rules.viterbi(rules.fitted([]), np.ones((4, len(rules.FEATURES)))).tolist() == [1] * 4


def test_boilerplate_amid_content_is_found():
    good = [((f"Some plain words stand here in line number {i}.\n" * 1 + "And they go on for a while without marks.\n") * 3).encode() for i in range(60)]
    bad = [("buy | now | $$$ | click | here | %%% | top\n" * 5 + f"menu | {i} | home | & | more\n").encode() for i in range(60)]
    chain = rules.fitted([(t, 1) for t in good] + [(t, 0) for t in bad])
    mixed = good[0] + bad[0]
    labels = rules.viterbi(chain, rules.lines_of(mixed).features)
    assert labels.tolist() == [1] * 6 + [0] * 6
    x = rules.lines_of(mixed)
    assert 0.4 < rules.content_share(chain, x) < 0.8


def test_held_out_documents(spark):
    """Held-out labels of sf0.01, looked at once: fitted on the others."""
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    got = {r.doc_id: r for r in rules.judged(docs, rules.fit(docs, labels)).collect()}
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id in got]
    clean = [g for g, y in held if y == 1 and not g.base_failed]
    junk = [g for g, y in held if y == 0]
    assert len(clean) > 30 and sum(g.kept for g in clean) >= 0.99 * len(clean)
    assert junk and sum(not g.kept for g in junk) >= 0.9 * len(junk)


def test_line_labels_cover_all_words(spark, odd_docs, no_docs):
    chain = rules.fitted([])
    got = rules.line_labels(odd_docs, chain).collect()
    texts = [(r.doc_id, (r.text or "").encode()) for r in odd_docs.collect()]
    for doc_id, text in texts:
        own = [r for r in got if r.doc_id == doc_id]
        places = {(r.start, r.end) for r in own}
        assert all(r.content for r in own) and b" ".join(text[a:b] for a, b in sorted(places)).split() == text.split()
    assert rules.line_labels(no_docs, chain).count() == 0 and rules.judged(no_docs, chain).count() == 0


def test_no_labels_keep_by_the_base_rules(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.kept != r.base_failed for r in rules.judged(docs, rules.fit(docs, labels)).collect())


def test_query_contract(spark, small):
    df = rules.query(spark, small)
    assert df.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rows = df.collect()
    assert len(rows) == 200 and not any(r.kept and r.base_failed for r in rows)
