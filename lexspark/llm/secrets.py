"""Secret spans: fixed patterns and a randomness test battery over encoded-looking tokens."""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ("assign", "access", "hex", "random")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the longest runs, as with [0-9a-f]+ and a least length
#: What may be an encoded token: no white space, 20 characters or more.
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

#: Encodings by alphabet.
ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("hex", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: The false-discovery rate over all tested tokens of a table.
RATE = 0.01
#: Least characters of a candidate, with padding.
_LEAST = 20
#: Parts of a token between inner "=", each with the padding behind it; and the longest runs of each alphabet.
_PART = re.compile(r"[A-Za-z0-9+/_-]+=*")
_RUNS = tuple(re.compile(f"[{re.escape(alphabet)}]{{16,}}(?:=+$)?") for _, alphabet in ENCODINGS)

#: Words of which names, paths and numbers are made that stand for ordinary writing.
_WORDS = """account address admin archive article author backup banner batch billing block branch browser bucket buffer button cache calendar category change channel charge check client cloud cluster code column comment commit company config connect content context cookie country create customer data database date default delete delivery deploy design detail device digest domain download driver element email engine entry error event export factory feature field file filter folder format gateway global group handler header history image import index input invoice item label language layout letter level library limit list loader local location login manager member memory menu message method mobile model module month name network node notes number object offer office option order output package page parent partner password path payment people phone picture platform player plugin point policy portal price private process product profile project property public query queue reader record region release report request resource response result return review role route sample schedule schema screen script search section security select server service session setting shadow shipping shop signal size source stage start state status storage stream string student style summary support system table target task team template test text theme thread ticket time title token topic track traffic transfer tree type update upload user value vector vendor version video view visit volume wallet warehouse weather week widget window winter worker writer year zone""".split()
_HEX_WORDS = "abba accede added babe baded beef cab cafe dad dead deaf decade deed face facade faced fad fade feed".split()
#: Tokens in the sample of each style and length by which the battery is calibrated.
_SAMPLE = 1500
#: Longer tokens are tested as blocks of this length, AT_ONCE of them at a time.
_BLOCK, _AT_ONCE = 256, 256


def _styles(rng: random.Random, alphabet: str) -> list[Callable[[], str]]:
    """Makers of a piece of ordinary writing each, within an alphabet: names in snake and camel case, names of invented words, paths, capitals and numbers."""
    held = set(alphabet)
    fits = lambda words: [w for w in words if set(w) <= held] or ["0"]
    if len(alphabet) == 16:
        words = fits([w.upper() for w in _HEX_WORDS] + _HEX_WORDS)
        number = lambda: str(rng.choice((rng.randrange(10), rng.randrange(2000, 2030), rng.randrange(10**6))))
        return [lambda: rng.choice(words), lambda: "".join(rng.choices(words, k=3)) + number(), lambda: str(rng.randrange(10**5, 10**14)) + rng.choice(alphabet[10:])]
    digits = "".join(c for c in alphabet if c.isdigit())
    number = lambda: "".join(rng.choices(digits, k=rng.choice((1, 1, 2, 4))))
    between = [c for c in "_-/+" if c in held] or [""]
    invented = lambda: "".join(rng.choice("bcdfghlmnprstvw") + rng.choice(("a", "e", "i", "o", "u", "ai", "en", "er", "on", "in", "an")) for _ in range(rng.randrange(1, 4)))
    upper = [w.upper() for w in _WORDS]
    capitals = lambda: rng.choice(upper) + rng.choice((*between, *between, number()))
    if "a" not in held:
        return [lambda: rng.choice(upper), capitals, lambda: invented().upper() + rng.choice(("", number()))]
    return [
        lambda: rng.choice(_WORDS) + rng.choice((between[-1], between[-1], number() + between[-1])),
        lambda: rng.choice(_WORDS).capitalize() + rng.choice(("", "", "", number())),
        lambda: rng.choice((str.capitalize, str.lower))(invented()) + rng.choice(("", between[0], number())),
        lambda: rng.choice(between) + rng.choice((rng.choice(_WORDS), invented(), number(), rng.choice(_WORDS) + number())),
        capitals,
    ]


def _kind(c: str) -> int:
    """The class of a character: digit, mark, and small or capital letter by how common it is in writing."""
    if not c.isalpha():
        return 0 if c.isdigit() else 1
    return 2 + 5 * c.isupper() + next(i for i, of in enumerate(("aeiou", "tnsr", "hldcm", "bfgkpvwy", "jqxz")) if c.lower() in of)


class Battery:
    """Tests of the characters of one alphabet, as distances from randomness in standard deviations.

    Chi-squared of the classes of characters against a uniform alphabet; runs, as how many fewer changes between digits, capitals, small letters and marks there are than chance makes; and serial correlation, of neighbouring classes as writing has it and of neighbouring places in the alphabet as counting has it. Random characters lie near 0 in all three, and writing far off, the farther the longer it is.
    """

    def __init__(self, alphabet: str):
        self.alphabet = alphabet
        self.place = np.full(256, -1)
        self.place[[ord(c) for c in alphabet]] = range(len(alphabet))
        kinds = np.array([_kind(c) for c in alphabet])
        self.cell = np.unique(kinds, return_inverse=True)[1]
        self.share = np.bincount(self.cell) / len(alphabet)
        self.group = np.where(kinds < 2, kinds, 2 + (kinds >= 7))
        self.change = 1 - float(((np.bincount(self.group) / len(alphabet)) ** 2).sum())
        # neighbouring classes in writing against uniform characters, from samples of each style
        n, pairs = len(self.share), np.ones((len(self.share),) * 2)
        for style in range(self.styles):
            cells = self.cell[self._written(style, 64, 200)]
            pairs += np.bincount((cells[:, :-1] * n + cells[:, 1:]).reshape(-1), minlength=n * n).reshape(n, n)
        self.pair = np.log(pairs / pairs.sum()) - np.log(pairs.sum(1) / pairs.sum())[:, None] - np.log(self.share)[None, :]
        chance = self.share[:, None] * self.share[None, :]
        self.pair_mean = float((chance * self.pair).sum())
        self.pair_sd = math.sqrt(float((chance * (self.pair - self.pair_mean) ** 2).sum()))
        self.null: dict[int, list[tuple[float, float]]] = {}
        # weights that part writing from chance best, by Fisher's linear discriminant at 32 characters
        self.weights = np.ones(3)
        written = [self.tests(self._written(style, 32, 400)) for style in range(self.styles)]
        chanced = self.tests(np.random.default_rng(0).integers(0, len(alphabet), (400, 32)))
        spread = sum(np.cov(x.T) for x in [*written, chanced]) / (len(written) + 1)
        best = np.linalg.solve(spread + 0.05 * np.eye(3), np.mean([x.mean(0) for x in written], axis=0) - chanced.mean(0))
        self.weights = np.maximum(best, 0.05 * best.max())

    @property
    def styles(self) -> int:
        return len(_styles(random.Random(0), self.alphabet))

    def _written(self, style: int, n: int, count: int) -> np.ndarray:
        """Tokens of n characters in one style of ordinary writing, as places in the alphabet; the same for the same call."""
        rng = random.Random(f"{style} {n}")
        piece = _styles(rng, self.alphabet)[style]
        out = []
        while len(out) < count:
            token = piece()
            while len(token) < n:
                token += piece()
            out.append(token[:n])
        return self.place[np.frombuffer("".join(out).encode(), np.uint8).reshape(count, n)]

    def distance(self, at: np.ndarray) -> np.ndarray:
        """The weighted sum of the three tests."""
        return self.tests(at) @ self.weights

    def tests(self, at: np.ndarray) -> np.ndarray:
        """The three tests for tokens of one length, as rows of places in the alphabet. What is more even than chance counts for two standard deviations at most."""
        rows, n = at.shape
        cells = self.cell[at]
        k = len(self.share)
        seen = np.bincount((cells + k * np.arange(rows)[:, None]).reshape(-1), minlength=rows * k).reshape(rows, k)
        chi = ((seen - n * self.share) ** 2 / (n * self.share)).sum(1)
        uniform = (chi - (k - 1)) / math.sqrt(2 * (k - 1))
        group = self.group[at]
        usual = (n - 1) * self.change
        runs = (usual - (group[:, 1:] != group[:, :-1]).sum(1)) / math.sqrt(usual * (1 - self.change))
        classes = (self.pair[cells[:, :-1], cells[:, 1:]].sum(1) - (n - 1) * self.pair_mean) / (math.sqrt(n - 1) * self.pair_sd)
        x = at - at.mean(1, keepdims=True)
        counting = np.abs((x[:, 1:] * x[:, :-1]).sum(1) / np.maximum((x * x).sum(1), 1e-9)) * math.sqrt(n)
        return np.stack([np.maximum(uniform, -2), np.maximum(runs, -2), np.maximum(classes, -2) + np.maximum(counting - 3, 0)], axis=1)

    def p_value(self, token: str) -> float:
        """How likely ordinary writing of that length lies as near to randomness, by the style for which it is likeliest.

        Each style's distances are calibrated on a sample; below it, by a normal tail through the sample's mean and its thousandth, widened by 15 %, so small p-values are carried on and not counted. Of a token of more than _BLOCK characters all blocks are tested (the last may overlap the one before) and their mean distance is held against that of single blocks, as if the others told nothing more: so its p-value is too large rather than too small, and its cost linear in its length.
        """
        n = min(len(token), _BLOCK)
        step = 1 << max(0, n.bit_length() - 4)  # an eighth to a sixteenth of the length
        length = n // step * step
        if length not in self.null:
            self.null[length] = []
            for style in range(self.styles):
                d = self.distance(self._written(style, length, max(200, min(_SAMPLE, 1_000_000 // length))))
                spread = max(float(d.std()), float(d.mean() - np.quantile(d, 0.001)) / 3.09, 1e-6)
                self.null[length].append((float(d.mean()), 1.15 * spread))
        at = self.place[np.frombuffer(token.encode(), np.uint8)]
        starts = [*range(0, len(at) - n, n), len(at) - n]
        total = 0.0
        for k in range(0, len(starts), _AT_ONCE):
            total += float(self.distance(np.stack([at[x : x + n] for x in starts[k : k + _AT_ONCE]])).sum())
        d = total / len(starts)
        return max(0.5 * math.erfc(-(d - mean) / (sd * math.sqrt(2))) for mean, sd in self.null[length])


@lru_cache(maxsize=None)
def _battery(which: int) -> Battery:
    return Battery(ENCODINGS[which][1])


def randomness(token: str) -> tuple[str, float] | None:
    """The encoding of a token, the smallest alphabet that holds it, and the p-value of the hypothesis that it is ordinary writing; None if no alphabet holds it or it is short."""
    body = token.rstrip("=")
    for which, (name, alphabet) in enumerate(ENCODINGS):
        if len(body) >= 16 and set(body) <= set(alphabet):
            return name, _battery(which).p_value(body)
    return None


def _candidates(token: str) -> set[tuple[int, int]]:
    """The parts of a token that one alphabet holds, and of other parts the longest runs of every alphabet. Runs of digits, capitals or small letters alone are words and numbers."""
    out = set()
    for part in _PART.finditer(token):
        if part.end() - part.start() < _LEAST:
            continue
        found = [list(runs.finditer(part.group())) for runs in _RUNS]
        whole = [m for of in found for m in of if m.group() == part.group()]
        for of in [whole] if whole else found:
            for m in of:
                run = m.group()
                if len(run) >= _LEAST and any(c.isdigit() for c in run) + any(c.isupper() for c in run) + any(c.islower() for c in run) >= 2:
                    out.add((part.start() + m.start(), part.start() + m.end()))
    return out


def tested(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, float]]:
    """(start, end, p-value over weight) of every tested token that no base span overlaps. A token's weight is its length: its share of the errors allowed, as long tokens decide more surely."""
    out = []
    starts = [a for a, _, _ in base]  # sorted
    reach = list(accumulate((b for _, _, b in base), max))  # how far the spans up to each go
    for m in _TOKEN.finditer(text):
        for s, e in sorted(_candidates(m.group())):
            s, e = m.start() + s, m.start() + e
            before = bisect_left(starts, e)
            if not (before and reach[before - 1] > s) and (got := randomness(text[s:e])):
                out.append((s, e, got[1] / (e - s)))
    return out


#: Places of -100 log10(p / weight) in which tested tokens are counted.
_BINS = 32_000


def _bin(q: float) -> int:
    return min(_BINS, max(0, int(-100 * math.log10(max(q, 1e-320)))))


def threshold(counts: dict[int, int], weight: float, rate: float = RATE) -> int:
    """The least bin whose tokens are secrets: the weighted procedure of Benjamini and Hochberg over counts by bin and the sum of all weights. Tokens of a bin count with its largest value, so the rate is kept."""
    found, best = 0, _BINS + 1
    for b in sorted(counts, reverse=True):
        found += counts[b]
        if 10 ** (-b / 100) <= rate * found / weight:
            best = b
    return best


def random_spans(found: list[tuple[int, int, float]], least: int) -> list[tuple[int, int]]:
    """The spans among tested tokens from a bin on; those that overlap become one."""
    out: list[tuple[int, int]] = []
    for s, e, q in sorted(found):
        if _bin(q) >= least:
            if out and s < out[-1][1]:
                out[-1] = out[-1][0], max(e, out[-1][1])
            else:
                out.append((s, e))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the fixed patterns, sorted; code points, end exclusive."""
    base = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return sorted(base + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)])


def secret_spans(text: str, least: int) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of all secrets, sorted; random tokens from a bin on. Random tokens that a fixed pattern covers aren't told twice."""
    base = base_spans(text)
    return sorted(base + [(s, 3, e) for s, e in random_spans(tested(text, base), least)])


def _listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _least_bin(tokens: DataFrame, rate: float) -> int:
    """The threshold over a table of tested tokens (size, bin); the driver sees one row a bin."""
    rows = tokens.groupBy("bin").agg(F.count(F.lit(1)), F.sum("size")).collect()
    return threshold({r[0]: r[1] for r in rows}, float(sum(r[2] for r in rows)), rate)


_TOKENS = "array<struct<start: int, end: int, q: double>>"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("base", pa.string()), ("tokens", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("q", pa.float64())])))])
_BIN = pa.schema([("size", pa.int64()), ("bin", pa.int32())])


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """One row per document: counts of the fixed patterns, a digest of their spans, and all spans. Null texts are empty.

    Texts are gone through once; which of the tested tokens are secrets is then decided over the whole table, at a false-discovery rate.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base = base_spans(text or "")
                n, listed = Counter(k for _, k, _ in base), _listed(base)
                found = [{"start": s, "end": e, "q": q} for s, e, q in tested(text or "", base)]
                out.append((doc, n[0], n[1], n[2], hashlib.sha256(listed.encode()).hexdigest(), listed, found))
            yield pa.record_batch([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_OUT)], schema=_OUT)

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for base, tokens in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True):
                more = [(s, f"random:{s}:{e}") for s, e in random_spans([(t["start"], t["end"], t["q"]) for t in tokens], least)]
                # sorted by start; equal starts can't be, as random spans lie beside the base ones
                out.append(",".join(x for _, x in sorted([(int(x.split(":")[1]), x) for x in base.split(",") if x] + more, key=lambda x: x[0])) if more else base)
            yield pa.record_batch([*batch.columns[:5], pa.array(out, pa.string())], names=[*batch.schema.names[:5], "spans"])

    found = cut(docs.select("doc_id", "text").mapInArrow(rows, f"doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base string, tokens {_TOKENS}"))
    tokens = found.where(F.size("tokens") > 0).select(F.explode("tokens").alias("t"))
    edge = F.least(F.lit(_BINS), F.greatest(F.lit(0), F.floor(-100 * F.log10(F.greatest("t.q", F.lit(1e-320))))))
    least = _least_bin(tokens.select((F.col("t.end") - F.col("t.start")).alias("size"), edge.cast("int").alias("bin")), rate)
    return found.mapInArrow(decided, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(text: str, least: int, mask: str = "[SECRET]") -> str:
    """The text with every secret span replaced by a mark; overlapping spans become one."""
    out, at = [], 0
    for s, _, e in secret_spans(text, least):
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


def mask_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """docs with secrets in `text` masked and `n_chars` made to fit; all rows and other columns stay. Null texts stay null.

    Texts are gone through twice: once to count tested tokens by p-value, which gives the threshold for the whole table, and once to mask.
    """

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for t in batch.column(0).to_pylist() if t for x in tested(t, base_spans(t))]
            yield pa.record_batch([pa.array([e - s for s, e, _ in found], pa.int64()), pa.array([_bin(q) for _, _, q in found], pa.int32())], schema=_BIN)

    least = _least_bin(docs.select("text").mapInArrow(bins, "size long, bin int"), rate)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = batch.schema.get_field_index("text"), batch.schema.get_field_index("n_chars")
            old = batch.column(at).to_pylist()
            new = [masked(t, least) if t else t for t in old]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            if n >= 0:
                count = [len(b) if a != b else c for a, b, c in zip(old, new, batch.column(n).to_pylist(), strict=True)]
                batch = batch.set_column(n, batch.schema.field(n), pa.array(count, batch.schema.field(n).type))
            yield batch

    return docs.mapInArrow(rows, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return scan(table(spark, sf_dir, "documents"))
