"""Text payloads as lossless motion-JPEG in AVI, read back frame by frame into timed clips.

Frames are written by the lossless process of JPEG (ITU-T T.81, annex H): 8-bit samples, predictor 1, Huffman-coded differences. The table gives a difference of s bits a code of 9 - s bits, so each sample takes nine bits and numpy codes whole frames at once. Read are lossless frames with any Huffman table and predictor, and baseline ones.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, utf8

#: Samples in a row of a frame, rows in a frame at most, frames a second.
WIDTH, ROWS, FPS = 64, 64, 25
#: Samples of a frame that are decoded at most; files with larger frames get a status.
MOST_SAMPLES = 1 << 26


def _tables() -> tuple[np.ndarray, np.ndarray]:
    code, back = np.zeros(511, np.uint16), np.zeros(512, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        prefix = ((1 << (8 - s)) - 1) << 1  # 8 - s ones and a zero
        word = (prefix << s) | (d if d > 0 else d + (1 << s) - 1)
        code[d + 255], back[word] = word, d
    return code, back


_CODE, _DIFF = _tables()
_DHT = struct.pack(">BBH17B", 0xFF, 0xC4, 2 + 17 + 9, 0, *([1] * 9), *([0] * 7)) + bytes(range(8, -1, -1))


def _pack(words: np.ndarray) -> np.ndarray:
    """Rows of 9-bit words (a multiple of 8 a row) as bytes."""
    w = words.reshape(len(words), -1, 8)
    out = np.empty((*w.shape[:2], 9), np.uint8)
    out[..., 0] = w[..., 0] >> 1
    for i in range(1, 8):
        out[..., i] = (w[..., i - 1] << (8 - i)) | (w[..., i] >> (i + 1))
    out[..., 8] = w[..., 7]
    return out.reshape(len(words), -1)


def _unpack(raw: np.ndarray) -> np.ndarray:
    b = raw.reshape(-1, 9).astype(np.uint16)
    out = np.empty((len(b), 8), np.uint16)
    for i in range(8):
        out[:, i] = ((b[:, i] << (i + 1)) | (b[:, i + 1] >> (7 - i))) & 511
    return out.reshape(-1)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def encode_avi(payload: bytes) -> bytes:
    """An AVI of motion-JPEG frames whose samples are the payload, row by row; the payload's length is a multiple of WIDTH and above 0."""
    rows = len(payload) // WIDTH
    frames = -(-rows // ROWS)
    height = -(-rows // frames)
    samples = np.zeros((frames, height, WIDTH), np.int16)
    samples.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    diff = np.empty_like(samples)
    diff[:, :, 1:] = samples[:, :, 1:] - samples[:, :, :-1]
    diff[:, 1:, 0] = samples[:, 1:, 0] - samples[:, :-1, 0]
    diff[:, 0, 0] = samples[:, 0, 0] - 128
    packed = _pack(_CODE[diff + 255].reshape(frames, -1))
    head = b"\xff\xd8" + _DHT + struct.pack(">BBHBHHBBBB", 0xFF, 0xC3, 11, 8, height, WIDTH, 1, 1, 0x11, 0) + struct.pack(">BBHBBBBBB", 0xFF, 0xDA, 8, 1, 1, 0, 1, 0, 0)
    movi, index = [b"movi"], []
    at = 4
    for i in range(frames):
        frame = _chunk(b"00dc", head + packed[i].tobytes().replace(b"\xff", b"\xff\0") + b"\xff\xd9")
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, int.from_bytes(frame[4:8], "little")))
        movi.append(frame)
        at += len(frame)
    main = struct.pack("<10I16x", 1_000_000 // FPS, 0, 0, 0x10, frames, 0, 1, 0, WIDTH, height)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, frames, 0, 0xFFFFFFFF, 0, 0, 0, WIDTH, height)
    picture = struct.pack("<IiiHH4sIiiII", 40, WIDTH, height, 1, 8, b"MJPG", WIDTH * height, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", picture))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + strl + _chunk(b"plen", struct.pack("<Q", len(payload))))
    body = hdrl + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", b"AVI " + body)


def parse_avi(media: bytes) -> tuple[list[bytes], int, float]:
    """The frames' bytes by the RIFF index, the payload's length (all samples if the file doesn't say) and the frames a second. Places in the index count from the movi list, or from the file's start.

    Chunks end with the list that holds them and with the file. What stands behind the last whole entry of an index is left. Raises ValueError for what isn't an AVI with an index, and for an index whose frames are together longer than the file.
    """
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, length, fps = None, b"", -1, float(FPS)
    spans = [(12, min(len(media), 8 + int.from_bytes(media[4:8], "little")))]
    while spans:
        at, end = spans.pop()
        while at + 8 <= end:
            name, size = media[at : at + 4], min(int.from_bytes(media[at + 4 : at + 8], "little"), end - at - 8)
            if name == b"LIST":
                if media[at + 8 : at + 12] == b"movi":
                    movi = at + 8
                else:
                    spans.append((at + 12, at + 8 + size))
            elif name == b"idx1":
                index = media[at + 8 : at + 8 + size]
            elif name == b"plen":
                length = int.from_bytes(media[at + 8 : at + 16], "little")
            elif name == b"avih":
                fps = 1e6 / max(1, int.from_bytes(media[at + 8 : at + 12], "little"))
            at += 8 + size + (size & 1)
    if movi is None or not index:
        raise ValueError("an AVI without frames or index")
    frames, total = [], 0
    for name, _, at, size in struct.iter_unpack("<4sIII", index[: len(index) // 16 * 16]):
        if name[2:] in (b"dc", b"db"):
            start = movi + at if media[movi + at : movi + at + 4] == name else at
            if media[start : start + 4] != name or start + 8 + size > len(media):
                raise ValueError("the index points beside a frame")
            total += size
            if total > len(media):
                raise ValueError("an index of more than the file holds")
            frames.append(media[start + 8 : start + 8 + size])
    return frames, length, fps


#: Order in which a block's coefficients are stored: along the diagonals, to and fro.
_ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
#: Rows are the basis functions of the cosine transform of eight samples.
_COSINES = np.array([[(0.125**0.5 if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def _huffman(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For all 16 bits that may come next, the length of the code at their start (0: none) and its symbol."""
    length, symbol = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    code, k = 0, 0
    for bits in range(1, 17):
        for _ in range(counts[bits - 1]):
            low, high = code << (16 - bits), (code + 1) << (16 - bits)
            length[low:high], symbol[low:high] = bits, symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return length, symbol


class _Bits:
    """Entropy-coded bits of one restart interval."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.end = raw.replace(b"\xff\0", b"\xff") + b"\xff" * 4, 0, 8 * len(raw.replace(b"\xff\0", b"\xff"))

    def take(self, n: int) -> int:
        if self.at + n > self.end:
            raise ValueError("a frame cut short")
        word = int.from_bytes(self.raw[self.at >> 3 : (self.at >> 3) + 4], "big")
        out = (word >> (32 - n - (self.at & 7))) & ((1 << n) - 1)
        self.at += n
        return out

    def symbol(self, table: tuple[np.ndarray, np.ndarray]) -> int:
        word = int.from_bytes(self.raw[self.at >> 3 : (self.at >> 3) + 4], "big")
        ahead = (word >> (16 - (self.at & 7))) & 0xFFFF
        if not table[0][ahead]:
            raise ValueError("bits that are no code")
        self.at += int(table[0][ahead])
        if self.at > self.end:
            raise ValueError("a frame cut short")
        return int(table[1][ahead])

    def value(self, size: int) -> int:
        """A signed number of so many bits."""
        if not size:
            return 0
        v = self.take(size)
        return v if v >> (size - 1) else v - (1 << size) + 1


def _segments(frame: bytes) -> dict:
    """What the markers of a frame say: process, sizes, tables, scan and entropy-coded bytes."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    out: dict = {"huffman": {}, "tables": b"", "quantum": {}, "interval": 0}
    at = 2
    while True:
        if at + 4 > len(frame) or frame[at] != 0xFF:
            raise ValueError("a frame without a scan")
        marker, size = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        body = frame[at + 4 : at + 2 + size]
        if marker == 0xC4:
            out["tables"] += frame[at : at + 2 + size]
            k = 0
            while k + 17 <= len(body):
                counts = body[k + 1 : k + 17]
                out["huffman"][body[k]] = (counts, body[k + 17 : k + 17 + sum(counts)])
                k += 17 + sum(counts)
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                out["quantum"][body[k] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1).astype(np.int64)
                k += 129 if wide else 65
        elif marker == 0xDD:
            out["interval"] = int.from_bytes(body[:2], "big")
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            out["process"], out["bits"] = marker, body[0]
            out["height"], out["width"] = struct.unpack(">HH", body[1:5])
            out["parts"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        at += 2 + size
        if marker == 0xDA:
            out["scan"] = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            out["predictor"] = body[1 + 2 * body[0]]
            break
    end = frame.rfind(b"\xff\xd9")
    if end < at or "process" not in out or out["bits"] != 8 or not out["height"] or not out["width"]:
        raise ValueError("a frame without an end, a process or 8-bit samples")
    if out["height"] * out["width"] > MOST_SAMPLES:
        raise ValueError("a frame of too many samples")
    out["raw"] = frame[at:end]
    return out


def _intervals(raw: bytes) -> list[_Bits]:
    """The bits between restart markers."""
    out, last = [], 0
    at = raw.find(b"\xff")
    while at >= 0:
        if 0xD0 <= raw[at + 1 : at + 2][0] <= 0xD7 if at + 1 < len(raw) else False:
            out.append(_Bits(raw[last:at]))
            last = at + 2
        at = raw.find(b"\xff", at + 2)
    return [*out, _Bits(raw[last:])]


def _lossless(seen: dict) -> np.ndarray:
    """Samples of a lossless frame of one part, by any Huffman table and predictor, sample by sample."""
    if len(seen["parts"]) != 1 or seen["interval"]:
        raise ValueError("a lossless frame of several parts or intervals")
    table = _huffman(*seen["huffman"][seen["scan"][seen["parts"][0][0]] >> 4])
    bits, how = _Bits(seen["raw"]), seen["predictor"]
    guess = {1: lambda a, b, c: a, 2: lambda a, b, c: b, 3: lambda a, b, c: c, 4: lambda a, b, c: a + b - c, 5: lambda a, b, c: a + ((b - c) >> 1), 6: lambda a, b, c: b + ((a - c) >> 1), 7: lambda a, b, c: (a + b) >> 1}[how]
    rows: list[list[int]] = []
    for y in range(seen["height"]):
        row: list[int] = []
        for x in range(seen["width"]):
            if y and x:
                near = guess(row[x - 1], rows[y - 1][x], rows[y - 1][x - 1])
            else:
                near = row[x - 1] if x else rows[y - 1][0] if y else 128
            row.append((near + bits.value(bits.symbol(table))) & 0xFF)
        rows.append(row)
    return np.array(rows, np.uint8)


def _baseline(seen: dict) -> np.ndarray:
    """Samples of the first part (brightness) of a baseline frame."""
    wide, high = max(p[1] for p in seen["parts"]), max(p[2] for p in seen["parts"])
    across, down = -(-seen["width"] // (8 * wide)), -(-seen["height"] // (8 * high))
    sizes = [p[1:3] for p in seen["parts"]]
    if len(sizes) == 1:  # a part by itself isn't interleaved: its blocks come row by row
        across, down, sizes = -(-seen["width"] // 8), -(-seen["height"] // 8), [(1, 1)]
    if across * down * sum(h * v for h, v in sizes) > 4 * len(seen["raw"]):  # a block takes two bits at least
        raise ValueError("a frame cut short")
    tables = {k: _huffman(*v) for k, v in seen["huffman"].items()}
    parts = [(h, v, tables[seen["scan"][p[0]] >> 4], tables[16 + (seen["scan"][p[0]] & 15)], np.zeros((down * v, across * h, 64), np.int16)) for (h, v), p in zip(sizes, seen["parts"], strict=True)]
    units = across * down
    step = seen["interval"] or units
    intervals = _intervals(seen["raw"])
    for unit in range(units):
        if unit % step == 0:
            if unit // step >= len(intervals):
                raise ValueError("a frame cut short")
            bits, last = intervals[unit // step], [0] * len(parts)
        for i, (h, v, dc, ac, blocks) in enumerate(parts):
            for k in range(h * v):
                block = blocks[unit // across * v + k // h, unit % across * h + k % h]
                last[i] += bits.value(bits.symbol(dc))
                if abs(last[i]) > 32767:
                    raise ValueError("coefficients beyond 16 bits")
                block[0] = last[i]
                at = 1
                while at < 64:
                    run = bits.symbol(ac)
                    if not run & 15:
                        if run != 0xF0:
                            break
                        at += 16
                        continue
                    at += run >> 4
                    if at > 63:
                        raise ValueError("coefficients beyond a block")
                    block[at] = bits.value(run & 15)
                    at += 1
    blocks, quantum = parts[0][4], seen["quantum"][seen["parts"][0][3]]
    whole = np.zeros((8 * blocks.shape[0], 8 * blocks.shape[1]), np.uint8)
    for r, row in enumerate(blocks):  # a row of blocks at a time bounds the memory
        square = np.zeros(row.shape, float)
        square[:, _ZIGZAG] = row * quantum
        samples = np.einsum("ux,cuv,vy->xcy", _COSINES, square.reshape(-1, 8, 8), _COSINES)
        whole[8 * r : 8 * r + 8] = np.clip(np.round(samples + 128), 0, 255).reshape(8, -1)
    name, h, v, _ = seen["parts"][0]
    return whole[: -(-seen["height"] * v // high), : -(-seen["width"] * h // wide)]


def decode_frame(frame: bytes) -> np.ndarray:
    """The samples of one intra frame as an array of rows, of its first part if it has several: lossless frames with any table and predictor, and baseline ones with tables of their own. Raises ValueError for what isn't such a frame."""
    try:
        seen = _segments(frame)
        if seen["process"] == 0xC3 and seen["tables"] == _DHT and seen["predictor"] == 1 and len(seen["parts"]) == 1 and not seen["interval"]:
            raw = np.frombuffer(seen["raw"].replace(b"\xff\0", b"\xff"), np.uint8)
            n = seen["height"] * seen["width"]
            if n % 8 == 0 and len(raw) == n // 8 * 9:
                diff = _DIFF[_unpack(raw)].reshape(seen["height"], seen["width"])
                diff[0, 0] += 128
                diff[:, 0] = np.cumsum(diff[:, 0])
                return np.cumsum(diff, axis=1, dtype=np.int16).astype(np.uint8)
        if seen["process"] == 0xC3:
            return _lossless(seen)
        if seen["process"] in (0xC0, 0xC1):
            return _baseline(seen)
    except (KeyError, IndexError) as e:
        raise ValueError("a frame without a table that it names") from e
    except (struct.error, ZeroDivisionError) as e:
        raise ValueError("a frame with damaged sizes") from e
    raise ValueError("a frame of another process")


def shots(frames: list[np.ndarray], fps: float, window: int = 8, factor: float = 3.0, least: float = 0.2) -> list[tuple[float, float]]:
    """Clips as (start, end) in seconds: a cut stands where the histogram difference of neighbouring frames passes an adaptive threshold.

    The threshold is `factor` times the mean difference of the `window` frames before, `least` at least (differences run from 0 to 1).
    """
    cuts, before, past = [0], None, []
    for i, frame in enumerate(frames):
        hist = np.bincount(frame.reshape(-1) >> 3, minlength=32) / frame.size
        if before is not None:
            d = float(np.abs(hist - before).sum()) / 2
            recent = past[-window:]
            if d > max(least, factor * (sum(recent) / len(recent) if recent else 0.0)):
                cuts.append(i)
                past = []
            else:
                past.append(d)
        before = hist
    return [(a / fps, b / fps) for a, b in zip(cuts, [*cuts[1:], len(frames)], strict=True)]


def padded(text: bytes) -> bytes:
    """Bytes 0 appended up to a positive multiple of 64."""
    return text + b"\0" * (-len(text) % 64 if text else 64)


_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text (null: empty) as an AVI. Equal texts give equal files; other columns are ignored."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):  # a few hundred files at a time bound the memory
                part = batch.slice(at, 256)
                texts = utf8(part.column(1))
                yield pa.record_batch([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array([encode_avi(padded(t)) for t in texts], pa.binary())], schema=_MEDIA)

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, n_bytes long, media binary")


def read_media(media: bytes) -> dict:
    """What one stored file holds: its payload, read back, and its clips."""
    frames, length, fps = parse_avi(media)
    images = [decode_frame(f) for f in frames]
    payload = b"".join(x.tobytes() for x in images)
    return {"payload": payload[:length] if length >= 0 else payload, "frames": len(images), "clips": shots(images, fps)}


_CLIPS = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
_DECODED = pa.schema([("status", pa.string()), ("frames", pa.int32()), ("clips", _CLIPS), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())])
_DECODED_DDL = "status string, frames int, clips array<struct<start_s: double, end_s: double>>, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def decoded(media: DataFrame) -> DataFrame:
    """A (doc_id, media) table with what is read back from each file, its other columns left out but for n_bytes: status, the clips, and digests of the payload and of the file.

    Every row stays. status is "ok", "none" for a null file, or what is wrong with a file that can't be read; such rows have no clips and no payload.
    """
    keys = [c for c in ("doc_id", "n_bytes") if c in media.columns]
    schema = pa.schema([*(pa.field(k, pa.int64()) for k in keys), *_DECODED])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for *key, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    got, status = read_media(m) if m is not None else None, "none" if m is None else "ok"
                except (ValueError, struct.error) as e:
                    got, status = None, str(e)
                stored = (None, None) if m is None else (len(m), hashlib.sha256(m).hexdigest())
                if got:
                    p = got["payload"]
                    out.append((*key, status, got["frames"], [{"start_s": a, "end_s": b} for a, b in got["clips"]], len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), *stored))
                else:
                    out.append((*key, status, None, None, None, None, None, *stored))
            yield pa.record_batch([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return media.select(*keys, "media").mapInArrow(rows, "".join(f"{k} long, " for k in keys) + _DECODED_DDL)


def clip_rows(media: DataFrame) -> DataFrame:
    """Timed clips (doc_id, status, clip, start_s, end_s): one row per shot of each file of a (doc_id, media) table; a file without clips has one row, whose status says why."""
    return decoded(media).select("doc_id", "status", F.posexplode_outer("clips").alias("clip", "_c")).select("doc_id", "status", "clip", "_c.start_s", "_c.end_s")


def stored(docs: DataFrame) -> DataFrame:
    """The media column of docs, written as a table to the shared folder and read again."""
    path = scratch(docs.sparkSession, "media")
    media_column(docs).write.parquet(path, compression="zstd")
    return docs.sparkSession.read.parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    ms = lambda c: F.round(c * 1000).cast("long").cast("string")
    clips = F.array_join(F.transform("clips", lambda c: F.concat(ms(c["start_s"]), F.lit("-"), ms(c["end_s"]))), ",")
    feature = F.concat(F.lit("frames="), F.col("frames").cast("string"), F.lit(";clips="), clips)
    return decoded(stored(table(spark, sf_dir, "documents"))).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
