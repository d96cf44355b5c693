"""Packing token pieces into fixed-length sequences as a cutting-stock problem."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ranked
from .tokens import encoded

LENGTH = 1024


def knapsack(value: np.ndarray, room: int) -> tuple[float, dict[int, int]]:
    """The multiset of lengths (indices of value from 1) of the greatest value within the room, by dynamic programming over capacities."""
    best, choice = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    lengths = np.flatnonzero(value > 1e-12)
    for c in range(1, room + 1):
        fit = lengths[: np.searchsorted(lengths, c, "right")]
        best[c] = best[c - 1]
        if len(fit):
            gain = value[fit] + best[c - fit]
            k = int(np.argmax(gain))
            if gain[k] > best[c] + 1e-12:
                best[c], choice[c] = gain[k], fit[k]
    pattern: dict[int, int] = {}
    c = room
    while c > 0:
        if choice[c]:
            pattern[int(choice[c])] = pattern.get(int(choice[c]), 0) + 1
            c -= int(choice[c])
        else:
            c -= 1
    return float(best[room]), pattern


def fit_rest(left: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """Patterns for a histogram by best fit: each takes the largest length left, then the largest that still fits, as often as the counts allow."""
    left = {k: v for k, v in left.items() if v > 0}
    out = []
    while left:
        pattern, c = {}, room
        for k in sorted(left, reverse=True):
            n = min(left[k], c // k)
            if n:
                pattern[k] = n
                c -= n * k
        times = min(left[k] // n for k, n in pattern.items())
        out.append((pattern, times))
        for k, n in pattern.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def first_basis(lengths: list[int], need: np.ndarray, room: int) -> tuple[list[dict[int, int]], np.ndarray]:
    """As many independent patterns as lengths, feasible for the linear program, and the inverse of their matrix.

    Each pattern takes the longest pieces left that fit and is used, in fractions too, until one length is spent; later patterns don't hold that length, so the matrix is triangular in the order in which lengths are spent.
    """
    place = {k: i for i, k in enumerate(lengths)}
    left = {k: float(v) for k, v in zip(lengths, need, strict=True)}
    patterns, order = [], []
    while left:
        pattern, c = {}, room
        for k in sorted(left, reverse=True):
            if k <= c:
                pattern[k] = c // k
                c -= pattern[k] * k
        spent = min(pattern, key=lambda k: left[k] / pattern[k])
        times = left.pop(spent) / pattern[spent]
        order.append(spent)
        patterns.append(pattern)
        for k, n in pattern.items():
            if k in left:
                left[k] = max(left[k] - n * times, 0.0)
    inverse = np.zeros((len(lengths), len(lengths)))
    for i, k in enumerate(order):
        row = np.zeros(len(lengths))
        row[place[k]] = 1.0
        for j in range(i):
            if k in patterns[j]:
                row -= patterns[j][k] * inverse[j]
        inverse[i] = row / patterns[i][k]
    return patterns, inverse


@dataclass
class Program:
    """A solved linear program: patterns (length -> how many), how often each is used (in fractions), the pricing rounds taken, and the bound that no packing can go below."""

    patterns: list[dict[int, int]]
    uses: np.ndarray
    rounds: int
    bound: float


def linear_program(lengths: list[int], need: np.ndarray, room: int, gap: float) -> Program:
    """Fewest sequences, in fractions, by column generation.

    The revised simplex method keeps a basis of as many patterns as lengths; its dual prices value the lengths, and the knapsack prices the next pattern. The search ends when no pattern is worth more than one sequence, or when Farley's bound (the prices' worth of all pieces over that of the best pattern) proves the uses to lie within `gap` of the optimum.
    """
    place = {k: i for i, k in enumerate(lengths)}
    patterns, inverse = first_basis(lengths, need, room)
    times = lambda vector: np.einsum("ij,j->i", inverse, vector)  # noqa: E731  small; BLAS threads only get in each other's way here
    x = np.maximum(times(need), 0)
    rounds, bound, since, least = 0, float((need * lengths).sum()) / room, 0, np.inf
    while True:
        prices = np.maximum(inverse.sum(axis=0), 0)
        value = np.zeros(room + 1)
        value[lengths] = prices
        best, pattern = knapsack(value, room)
        bound = max(bound, float((need * prices).sum()) / best)
        if x.sum() < least - 1e-9 * least:
            least, since = x.sum(), 0
        since += 1
        if best <= 1 + 1e-9 or since > 2 * len(lengths):  # optimal; or pivots that change nothing go round in circles
            return Program(patterns, x, rounds, bound)
        rounds += 1
        column = np.zeros(len(lengths))
        for k, n in pattern.items():
            column[place[k]] = n
        d = times(column)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(d > 1e-9, x / d, np.inf)
        out = int(np.argmin(ratio))
        patterns[out] = pattern
        row = inverse[out] / d[out]
        inverse -= d[:, None] * row
        inverse[out] = row
        x = np.maximum(times(need), 0)
        if x.sum() <= (1 + gap) * bound:
            return Program(patterns, x, rounds, bound)


def cutting_stock(histogram: dict[int, int], room: int = LENGTH, gap: float = 1e-4) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> how many) with how often each is used, which hold all pieces of a length histogram.

    Full pieces are sequences of their own. The uses of the linear program's patterns are rounded down, and what is left over, of less than one sequence a length, is packed by best fit.
    """
    used = [({k: 1}, v) for k, v in histogram.items() if k == room and v > 0]
    histogram = {k: v for k, v in histogram.items() if k < room and v > 0}
    lengths = sorted(histogram)
    if not lengths:
        return used
    solved = linear_program(lengths, np.array([histogram[k] for k in lengths], float), room, gap)
    left = dict(histogram)
    for i in np.argsort(-solved.uses):
        most = min([int(solved.uses[i] + 1e-9), *(left[k] // n for k, n in solved.patterns[i].items())])
        if most > 0:
            used.append((solved.patterns[i], most))
            for k, n in solved.patterns[i].items():
                left[k] -= n * most
    return used + fit_rest(left, room)


def pack(pieces: DataFrame, order: list[str], room: int = LENGTH) -> DataFrame:
    """Pieces (with `length`, 1 to room) with `sequence_id` and `offset`: no sequence holds more than `room`, and offsets are gapless from 0.

    The driver sees the length histogram alone (room entries at most). Pieces are ranked within their length, and the solved patterns say which ranks go where; that table has as many rows as the patterns have lengths, a bound set by `room`.
    """
    pieces = cut(pieces)
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    if any(not 1 <= k <= room for k in histogram):
        raise ValueError(f"lengths must lie from 1 to {room}")
    plan: dict[int, list[tuple[int, int, int, int]]] = {}
    filled, sequence = dict.fromkeys(histogram, 0), 0
    for pattern, times in cutting_stock(histogram, room):
        offset = 0
        for k, n in sorted(pattern.items(), reverse=True):
            plan.setdefault(k, []).append((filled[k], sequence, n, offset))
            filled[k] += n * times
            offset += n * k
        sequence += times
    rows = [(k, [(int(a), int(b), int(c), int(d)) for a, b, c, d in v]) for k, v in plan.items()]
    placed = pieces.sparkSession.createDataFrame(rows, "length long, _plan array<struct<first:long,sequence:long,times:long,offset:long>>")
    found = ranked(pieces.withColumn("length", F.col("length").cast("long")), ["length"], order, F.struct(*order), "_at").join(F.broadcast(placed), "length")
    found = found.withColumn("_p", F.expr("element_at(filter(_plan, p -> p.first <= _at), -1)")).withColumn("_at", F.col("_at") - F.col("_p.first"))
    return found.withColumns({"sequence_id": F.expr("_p.sequence + _at div _p.times"), "offset": F.expr("_p.offset + (_at % _p.times) * length")}).drop("_plan", "_p", "_at")


def cuts(n: int, room: int) -> list[int]:
    """The pieces of a document of n ids: full sequences, and a rest cut once more at half a sequence where it is longer, as short pieces leave little padding."""
    full, rest = divmod(n, room)
    half = room // 2
    return [room] * full + ([half, rest - half] if rest > half else [rest] if rest else [])


def token_pieces(docs: DataFrame, path: str, end: int, room: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Pieces of at most `room` ids: (doc_id, start, length, ids_crc32, doc_tokens), and `ids` if asked for. Every document has one at least: its end id."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    if with_ids:
        fields, ddl = [*fields, ("ids", pa.list_(pa.int32()))], ddl + ", ids array<int>"

    def rows(doc, raw: bytes):
        n = len(raw) // 4
        at = 0
        for length in cuts(n, room):
            part = raw[4 * at : 4 * (at + length)]
            yield (doc, at, length, zlib.crc32(part), n, *([np.frombuffer(part, np.int32)] * with_ids))
            at += length

    return encoded(docs, path, end, rows, pa.schema(fields), ddl)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    pieces = token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0)
    return pack(pieces, ["doc_id", "start"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
