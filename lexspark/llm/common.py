"""Helpers that several operators share: tables, shared folder, salted ranks and word hashes."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Sub-groups into which a ranked key is split, so that no key is ranked in a single task.
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where unset, on one machine, a temporary one is set. Raises ValueError on a cluster without one, whose executors have no folder in common."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and spark.sparkContext.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='lexspark-')}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder or spark.sparkContext.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, for files that executors write and read again."""
    return f"{ready(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder, so that a lost executor costs no recomputation of what came before."""
    ready(df.sparkSession)
    return df.checkpoint()


def ranked(df: DataFrame, keys: list[str], order: list[str], salt: Column, name: str) -> DataFrame:
    """df with a gapless rank from 0 per key, as `name`.

    Each key is split into SALTS sub-groups by the salt; sub-groups are ranked apart and shifted by the sizes of those before them, so a key with a third of all rows is no single task. df is computed twice: cut() it before if it is dear.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    by = [*keys, "_salt"]
    sizes = salted.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inner = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return salted.withColumn("_rank", inner).join(shifts, by).withColumn(name, F.col("_rank") + F.col("_shift")).drop("_salt", "_rank", "_shift")


# --- words and shingles of whole texts, as 64-bit hashes -------------------------------------

#: A-Z as a-z, for bytes.translate.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Key of hashes that several tasks compare; words of more than LONG bytes are hashed by BLAKE2b.
KEY, LONG = 0x9E3779B97F4A7C15, 64
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def piece_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, key: int = KEY) -> np.ndarray:
    """One keyed hash for each piece of some bytes, the same wherever it lies.

    Blocks of eight bytes are mixed in one after the other, which keeps pieces of the same length of up to eight bytes apart for certain. Nothing in it is linear, so texts can't be made to collide for every key, as sums of powers can.
    """
    size = (end - start).astype(np.int64)
    out = mixed(size.astype(np.uint64) + np.uint64(key))
    if not len(size):
        return out
    held = raw.tobytes() + bytes(8)
    blocks = np.ndarray((len(raw) + 1,), "<u8", held, strides=(1,))
    on = np.flatnonzero(size <= LONG)
    at, left, h = start[on], size[on], out[on]
    while len(on):
        h = mixed(h ^ (blocks[at] & _MASKS[np.minimum(left, 8)]))
        out[on] = h
        more = np.flatnonzero(left > 8)
        on, at, left, h = on[more], at[more] + 8, left[more] - 8, h[more]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(held[start[i] : end[i]], digest_size=8, key=key.to_bytes(8, "little")).digest(), "little")
    return out


def word_hashes(text: bytes) -> np.ndarray:
    """One hash a word of the text, in order: A-Z lowered, words are runs without U+0020 and U+0009-U+000D."""
    raw = np.frombuffer(text.translate(LOWER), np.uint8)
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64)
    space = np.ones(n + 2, bool)
    space[1:-1] = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    return piece_hashes(raw, start, end)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, in order."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[i : n + i]
    return mixed(h)


def shingles(text: bytes, k: int = 5) -> np.ndarray:
    """Hashes of all k-word shingles in order, with repeats; with fewer words, the whole sequence as one; without words none."""
    words = word_hashes(text)
    return grams(words, min(k, len(words))) if len(words) else words


def utf8(column) -> list[bytes]:
    """The texts of an Arrow column as bytes; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]
