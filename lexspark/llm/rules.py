"""Quality rules: lines labelled content or boilerplate by a linear-chain conditional random field; the share of content decides."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grams, piece_hashes, utf8
from .quality import labelled_sample

#: A document stays if at least this share of the characters of its words lies in lines of content.
SHARE = 0.5
#: Words of a window, and limits of the base rules.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Labelled documents used for fitting at most, bytes of their texts at most, and steps of fitting.
SAMPLE, SAMPLE_BYTES, STEPS, RATE = 2000, 8 << 20, 150, 0.1

_SPACE, _SYMBOL, _UPPER, _LOWER, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(6))
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_LOWER[97:123] = True
_DIGIT[48:58] = True
_MARK[list(b".,;:!?")] = True
_FOLLOWS = np.zeros(256, bool)  # bytes of a character after its first
_FOLLOWS[0x80:0xC0] = True

#: What is known of a line, each from 0 to 1: shares of its words' characters and words, and of what is told over the whole text.
FEATURES = ("one", "symbols", "words with symbols", "lone symbols", "doubled marks", "capitals", "digits", "short", "long words", "open end", "small start", "repeated line", "repeated words")


@dataclass
class Lines:
    """A text by its lines: counts of the base rules, and of lines that have words their places in bytes, characters in words and features."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    start: np.ndarray
    end: np.ndarray
    chars: np.ndarray
    features: np.ndarray

    @property
    def failed(self) -> bool:
        return self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > MOST_REPEATED * self.n_words


def repeated_words(hashes: np.ndarray) -> np.ndarray:
    """Which words lie in a window of WINDOW words that the text holds twice or more."""
    n = len(hashes)
    out = np.zeros(n, bool)
    if n <= WINDOW:
        return out
    _, back, count = np.unique(grams(hashes, WINDOW), return_inverse=True, return_counts=True)
    step = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(count[back] > 1)
    np.add.at(step, at, 1)
    np.add.at(step, at + WINDOW, -1)
    return np.cumsum(step[:-1]) > 0


def lines_of(text: bytes) -> Lines:
    """A whole text, in memory of about 20 bytes for each of its own. Lines end at \\n alone; words are runs without U+0020 and U+0009-U+000D, as they stand."""
    raw = np.frombuffer(text + b"\n", np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    first, last = edge[::2], edge[1::2]
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    symbols = int(_SYMBOL[raw].sum())
    if not len(first):
        none = np.zeros(0, np.int64)
        return Lines(0, 0, symbols, 0, 0, none, none, none, np.zeros((0, len(FEATURES))))
    line = np.searchsorted(ends, first)  # of each word
    some, words = np.unique(line, return_counts=True)
    at = np.cumsum(words) - words  # the first word of each line with words
    start, end = starts[some], ends[some]
    total = lambda mask: np.add.reduceat(mask, np.stack([start, end], axis=1).reshape(-1), dtype=np.int64)[::2]  # noqa: E731  what lies between is in the odd places
    by_word = lambda mask: np.add.reduceat(mask, np.stack([first, last], axis=1).reshape(-1), dtype=np.int64)[::2]
    chars = total(~space & ~_FOLLOWS[raw])
    in_words = by_word(_SYMBOL[raw])
    size = last - first
    repeated = repeated_words(piece_hashes(raw, first, last))
    seen: set[bytes] = set()
    again = np.zeros(len(some), bool)
    for i, (a, b) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
        own = text[a:b]
        again[i] = own in seen
        seen.add(own)
    letters = total(_UPPER[raw] | _LOWER[raw])
    doubled = np.zeros(len(raw), bool)
    doubled[1:] = _MARK[raw[1:]] & (raw[1:] == raw[:-1])
    mean = lambda mask: np.add.reduceat(mask, at, dtype=np.int64) / words
    head, tail = raw[first[at]], raw[last[at + words - 1] - 1]
    features = np.stack(
        [
            np.ones(len(some)),
            total(_SYMBOL[raw]) / chars,
            mean(in_words > 0),
            mean(in_words == size),
            np.minimum(1, total(doubled) / words),
            np.where(letters > 0, total(_UPPER[raw]) / np.maximum(letters, 1), 0),
            total(_DIGIT[raw]) / chars,
            1 / words,
            mean(size > 24),
            ~np.isin(tail, np.frombuffer(b".!?\"')", np.uint8)),
            _LOWER[head],
            again,
            mean(repeated),
        ],
        axis=1,
    )
    return Lines(len(first), int(chars.sum()), symbols, int(again.sum()), int(repeated.sum()), start, end, chars, features)


@dataclass
class Chain:
    """Weights of the field: of features for content, and of neighbours [before, after] and first lines; 0 is boilerplate, 1 content."""

    weights: np.ndarray
    pairs: np.ndarray
    first: np.ndarray


def viterbi(chain: Chain, features: np.ndarray) -> np.ndarray:
    """The likeliest labels of all lines together; of equally likely ones, content."""
    n = len(features)
    if not n:
        return np.zeros(0, np.int8)
    content = (features @ chain.weights).tolist()
    (a00, a01), (a10, a11) = chain.pairs.tolist()
    low, high = float(chain.first[0]), float(chain.first[1]) + content[0]
    from_high = bytearray(2 * n)  # for each line and label, whether the line before is content
    for i in range(1, n):
        x0, x1, y0, y1 = low + a00, high + a10, low + a01, high + a11
        from_high[2 * i], from_high[2 * i + 1] = x1 >= x0, y1 >= y0
        low, high = (x1 if x1 >= x0 else x0), (y1 if y1 >= y0 else y0) + content[i]
    out = np.empty(n, np.int8)
    label = int(high >= low)
    for i in range(n - 1, -1, -1):
        out[i] = label
        label = from_high[2 * i + label]
    return out


def marginals(chain: Chain, content: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of chains laid side by side (chain, line), filled up on the right: the probability of content of each line, sums of those of neighbours, and the logarithm of each chain's total weight; forward and backward in logarithms."""
    m, n = content.shape
    emit = np.stack([np.zeros_like(content), content], axis=2)
    ahead, back = np.zeros((n, m, 2)), np.zeros((n, m, 2))
    ahead[0] = chain.first + emit[:, 0]
    inside = np.arange(n)[:, None] < length
    for i in range(1, n):
        nxt = np.logaddexp(ahead[i - 1, :, :1] + chain.pairs[0], ahead[i - 1, :, 1:] + chain.pairs[1]) + emit[:, i]
        ahead[i] = np.where(inside[i][:, None], nxt, ahead[i - 1])
    for i in range(n - 2, -1, -1):
        x = back[i + 1] + emit[:, i + 1]
        nxt = np.logaddexp(x[:, :1] + chain.pairs[:, 0], x[:, 1:] + chain.pairs[:, 1])
        back[i] = np.where(inside[i + 1][:, None], nxt, 0)
    whole = np.logaddexp(ahead[-1, :, 0], ahead[-1, :, 1])
    p = np.exp(ahead[:, :, 1] + back[:, :, 1] - whole) * inside
    pairs = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            joint = ahead[:-1, :, a] + chain.pairs[a, b] + (emit[:, 1:, b].T + back[1:, :, b]) - whole
            pairs[a, b] = (np.exp(np.minimum(joint, 0)) * inside[1:]).sum()
    return p.T, pairs, whole


def fitted(documents: list[tuple[bytes, int]]) -> Chain:
    """A field fitted by Adam to the likelihood of line labels.

    Labels of documents stand for labels of lines: all lines of good documents are content; lines of bad ones are boilerplate, unless a good document has the same line. Without documents of both kinds all lines are content.
    """
    chain = Chain(np.zeros(len(FEATURES)), np.zeros((2, 2)), np.zeros(2))
    held = [(t, y, x) for t, y in documents if len((x := lines_of(t)).chars)]
    if len({y for _, y, _ in held}) < 2:
        return chain
    good = {t[a:b] for t, y, x in held if y for a, b in zip(x.start.tolist(), x.end.tolist(), strict=True)}
    held.sort(key=lambda r: len(r[2].chars))
    groups = []
    for at in range(0, len(held), max(1, len(held) // 12)):  # of similar length side by side
        part = held[at : at + max(1, len(held) // 12)]
        length = np.array([len(x.chars) for _, _, x in part])
        f, y = np.zeros((len(part), length.max(), len(FEATURES))), np.zeros((len(part), length.max()))
        for k, (t, label, x) in enumerate(part):
            f[k, : length[k]] = x.features
            y[k, : length[k]] = [label or t[a:b] in good for a, b in zip(x.start.tolist(), x.end.tolist(), strict=True)]
        groups.append((f, y, length))
    lines = sum(int(length.sum()) for _, _, length in groups)
    wanted = [np.zeros(len(FEATURES)), np.zeros((2, 2)), np.zeros(2)]
    for f, y, length in groups:
        inside = np.arange(f.shape[1]) < length[:, None]
        wanted[0] += np.einsum("mn,mnf->f", y * inside, f)
        for a in (0, 1):
            wanted[2][a] += (y[:, 0] == a).sum()
            for b in (0, 1):
                wanted[1][a, b] += ((y[:, :-1] == a) & (y[:, 1:] == b) & inside[:, 1:]).sum()
    params = [chain.weights, chain.pairs, chain.first]
    one, two = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        grads = [w.copy() for w in wanted]
        for f, _, length in groups:
            p, pairs, _ = marginals(chain, f @ chain.weights, length)
            grads[0] -= np.einsum("mn,mnf->f", p, f)
            grads[1] -= pairs
            grads[2] -= [len(p) - p[:, 0].sum(), p[:, 0].sum()]
        for p_, g, m, v in zip(params, grads, one, two, strict=True):
            g = g / lines - 1e-4 * p_
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p_ += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return chain


def fit(docs: DataFrame, labels: DataFrame) -> Chain:
    """A field from a sample of labelled documents that aren't held out, bounded by SAMPLE and SAMPLE_BYTES."""
    return fitted([(text, quality) for _, text, quality in labelled_sample(docs, labels, SAMPLE, SAMPLE_BYTES)])


def content_share(chain: Chain, lines: Lines) -> float:
    """The share of the words' characters that lies in lines of content; 0 without words."""
    return float(lines.chars[viterbi(chain, lines.features) == 1].sum() / lines.word_chars) if lines.word_chars else 0.0


def line_labels(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, line, start, end, content): the lines that have words of every text, by number from 0 among them, with their places in bytes of UTF-8."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    schema = pa.schema([("doc_id", pa.int64()), ("line", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("content", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0), utf8(batch.column(1)), strict=True):
                x = lines_of(text)
                n = len(x.chars)
                yield pa.record_batch([pa.array([doc_id.as_py()] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(x.start, pa.int64()), pa.array(x.end, pa.int64()), pa.array(viterbi(shared.value, x.features) == 1)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, line long, start long, end long, content boolean")


def judged(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept): one row for each row of docs.

    Null and empty texts have no words and fail the base rules. Repeated rows and null ids are rows of their own. content_share is null where the base rules have failed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = pa.schema([*((n, pa.int64()) for n in ("doc_id", *counts)), ("base_failed", pa.bool_()), ("content_share", pa.float64()), ("kept", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in utf8(batch.column(1)):
                x = lines_of(text)
                share = None if x.failed else content_share(shared.value, x)
                rows.append((*(getattr(x, n) for n in counts), x.failed, share, share is not None and share >= SHARE))
            yield pa.record_batch([batch.column(0), *(pa.array([r[i] for r in rows], f.type) for i, f in enumerate(list(schema)[1:]))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in counts) + ", base_failed boolean, content_share double, kept boolean")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    out = judged(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
