import hashlib
import math
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from lexspark.llm import media


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4096, 4097, 100_000])
def test_round_trip(n):
    payload = media.padded(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes())
    assert len(payload) % 64 == 0 and payload
    assert media.read_media(media.encode_avi(payload))["payload"] == payload


def test_other_files_are_refused():
    for bad in (b"", b"RIFF\0\0\0\0WAVE", media.encode_avi(b"a" * 64)[:200]):
        with pytest.raises(ValueError):
            media.parse_avi(bad)


def test_cuts_lie_where_histograms_change():
    dark, light = np.full((8, 64), 10, np.uint8), np.full((8, 64), 200, np.uint8)
    assert media.shots([dark] * 10 + [light] * 15, 25.0) == [(0.0, 0.4), (0.4, 1.0)]


class Writer:
    """Bits of a scan, as a plain encoder of another make would write them: codes of one length for each table."""

    def __init__(self, symbols, width):
        self.codes, self.bits = {s: format(i, f"0{width}b") for i, s in enumerate(symbols)}, []
        self.dht = bytes([len(symbols) if n == width else 0 for n in range(1, 17)]) + bytes(symbols)

    def value(self, v, run=0):
        size = abs(v).bit_length()
        return self.codes[run << 4 | size] + (format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else "")


def segment(marker, body):
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def scan_bytes(bits):
    bits += "1" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")


def natural(k):
    """Row and column of the k-th coefficient, by walking the diagonals."""
    r = c = 0
    for _ in range(k):
        if (r + c) % 2 == 0:
            r, c = (r, c + 1) if c == 7 or r == 0 else (r - 1, c + 1)
            if c > 7:
                r, c = r + 1, 7
        else:
            r, c = (r + 1, c) if c == 0 or r == 7 else (r + 1, c - 1)
            if r > 7:
                r, c = 7, c + 1
    return r, c


def coefficients(block, quant):
    """The transform by its definition, sum by sum, in stored order."""
    out = []
    for k in range(64):
        u, v = natural(k)
        scale = (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) / 4
        total = sum((block[y][x] - 128) * math.cos((2 * y + 1) * u * math.pi / 16) * math.cos((2 * x + 1) * v * math.pi / 16) for y in range(8) for x in range(8))
        out.append(round(scale * total / quant))
    return out


def baseline(planes, sampling, quant=2, interval=0):
    """A baseline frame of planes that are whole units in size."""
    dc, ac = Writer(range(12), 4), Writer([r << 4 | n for r in range(16) for n in range(1, 11)] + [0, 0xF0], 8)
    high, wide = max(v for _, v in sampling), max(h for h, _ in sampling)
    height, width = planes[0].shape[0] * high // sampling[0][1], planes[0].shape[1] * wide // sampling[0][0]
    across, down = (planes[0].shape[1] // 8, planes[0].shape[0] // 8) if len(planes) == 1 else (width // (8 * wide), height // (8 * high))
    last, parts, bits = [0] * len(planes), [], ""
    for unit in range(across * down):
        if interval and unit and unit % interval == 0:
            parts.append(scan_bytes(bits))
            bits, last = "", [0] * len(planes)
        for i, (plane, (h, v)) in enumerate(zip(planes, [(1, 1)] if len(planes) == 1 else sampling, strict=True)):
            for k in range(h * v):
                y, x = (unit // across * v + k // h) * 8, (unit % across * h + k % h) * 8
                c = coefficients(plane[y : y + 8, x : x + 8].astype(int).tolist(), quant)
                bits += dc.value(c[0] - last[i])
                last[i], run = c[0], 0
                for n, value in enumerate(c[1:], 1):
                    if value:
                        while run > 15:
                            bits, run = bits + ac.codes[0xF0], run - 16
                        bits, run = bits + ac.value(value, run), 0
                    else:
                        run += 1
                bits += ac.codes[0] if run else ""
    parts.append(scan_bytes(bits))
    raw = b"".join(p + (bytes([0xFF, 0xD0 + i % 8]) if i < len(parts) - 1 else b"") for i, p in enumerate(parts))
    head = segment(0xE0, b"JFIF\0") + segment(0xDB, b"\0" + bytes([quant] * 64)) + segment(0xC0, struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling)))
    head += segment(0xC4, b"\0" + dc.dht + b"\x10" + ac.dht) + (segment(0xDD, struct.pack(">H", interval)) if interval else b"")
    return b"\xff\xd8" + head + segment(0xDA, bytes([len(planes)]) + b"".join(bytes([i + 1, 0]) for i in range(len(planes))) + b"\0\x3f\0") + raw + b"\xff\xd9"


@pytest.mark.parametrize(("sampling", "interval"), [([(1, 1)], 0), ([(1, 1)], 3), ([(2, 2)], 0), ([(2, 1), (1, 1), (1, 1)], 0), ([(2, 2), (1, 1), (1, 1)], 1), ([(1, 1)] * 3, 2)])
def test_baseline_frames_of_other_makers(sampling, interval):
    rng = np.random.default_rng(4)
    slope = np.add.outer(np.arange(32) * 3, np.arange(32) * 2)
    planes = [np.clip(slope[: 16 * v, : 16 * h] + rng.integers(0, 40, (16 * v, 16 * h)), 0, 255).astype(np.uint8) for h, v in sampling]
    got = media.decode_frame(baseline(planes, sampling, interval=interval))
    assert got.shape == planes[0].shape and np.abs(got.astype(int) - planes[0]).max() <= 6


@pytest.mark.parametrize("predictor", range(1, 8))
def test_lossless_frames_of_other_makers(predictor):
    x = np.random.default_rng(predictor).integers(0, 256, (9, 11)).tolist()
    table, bits = Writer(range(9), 4), ""
    for i, row in enumerate(x):
        for j, v in enumerate(row):
            a, b, c = (row[j - 1], x[i - 1][j], x[i - 1][j - 1]) if i and j else (0, 0, 0)
            near = [a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1][predictor - 1] if i and j else row[j - 1] if j else x[i - 1][0] if i else 128
            bits += table.value((v - near + 128) % 256 - 128)
    frame = b"\xff\xd8" + segment(0xC4, b"\0" + table.dht) + segment(0xC3, struct.pack(">BHHB", 8, 9, 11, 1) + b"\1\x11\0") + segment(0xDA, b"\1\1\0" + bytes([predictor]) + b"\0\0") + scan_bytes(bits) + b"\xff\xd9"
    assert media.decode_frame(frame).tolist() == x


def test_files_that_cannot_be_read_have_a_status(spark):
    good = media.encode_avi(b"a" * 6400)
    gray = baseline([np.full((8, 8), 90, np.uint8)], [(1, 1)])
    foreign = good.replace(good[good.index(b"\xff\xd8") : good.index(b"\xff\xd9") + 2], b"")
    rows = [(1, good), (2, None), (3, b""), (4, b"RIFF junk"), (5, good[:300]), (6, good.replace(b"00dc", b"00xx")), (7, good.replace(b"\xff\xc3", b"\xff\xc2")), (8, good.replace(b"\xff\xc4", b"\xff\xe4")), (9, good[:-20] + b"\xff" * 20), (10, foreign), (10, good[: len(good) // 2] + bytes(reversed(good[len(good) // 2 :])))]
    frame = spark.createDataFrame([(d, m, "x") for d, m in rows], "doc_id long, media binary, status string")
    got = sorted((tuple(r) for r in media.clip_rows(frame).collect()), key=lambda r: (r[0], r[2] or 0))
    assert [r[0] for r in got if r[2] in (0, None)] == sorted(d for d, _ in rows)
    assert {r[0] for r in got if r[1] == "ok"} >= {1} and {r[1] for r in got if r[0] == 2} == {"none"}
    assert all(r[2] is None and r[1] not in ("ok", "none") for r in got if r[0] in (3, 4, 5, 7, 8, 9, 10))
    assert media.decoded(frame).count() == len(rows)
    assert media.decode_frame(gray).shape == (8, 8)


def test_digests_and_clips(odd_docs, no_docs):
    column = media.media_column(odd_docs)
    rows = media.decoded(media.stored(odd_docs)).collect()
    assert {r.status for r in rows} == {"ok"}
    texts = sorted((r.text or "").encode() for r in odd_docs.collect())
    assert sorted(r.payload_sha256 for r in rows) == sorted(hashlib.sha256(media.padded(t)).hexdigest() for t in texts)
    assert sorted(r.tail_crc32 for r in rows) == sorted(zlib.crc32(media.padded(t)[-64:]) for t in texts)
    assert len({(r.payload_sha256, r.media_sha256, r.frames, str(r.clips)) for r in rows}) == len(set(texts))
    clips = media.clip_rows(column).where("doc_id = 5").orderBy("clip").collect()
    assert clips[0].start_s == 0 and all(a.end_s == b.start_s for a, b in zip(clips, clips[1:], strict=False))
    assert media.decoded(media.stored(no_docs)).collect() == [] and media.clip_rows(media.media_column(no_docs)).collect() == []


def test_damaged_files_are_read_or_refused_in_no_time(mutations=2500):
    """Random damage of one or two bytes, cuts and doublings: each file is read or raises ValueError within a second."""
    rng = np.random.default_rng(5)
    files = [media.encode_avi(media.padded(t)) for t in (b"", b"some text " * 40, bytes(rng.integers(0, 256, 6000, np.uint8)))]
    kinds = Counter()
    for _ in range(mutations):
        f = bytearray(files[rng.integers(len(files))])
        how = rng.integers(4)
        head = min(len(f), 400) if rng.random() < 0.7 else len(f)
        for _ in range(rng.integers(1, 3)):
            f[rng.integers(head)] = rng.choice([0, 1, 0x7F, 0x80, 0xFF, rng.integers(256)])
        if how == 0:
            f = f[: rng.integers(len(f))]
        elif how == 1:
            at = rng.integers(len(f))
            f[at:at] = f[at : at + rng.integers(1, 64)]
        began = time.process_time()
        try:
            media.read_media(bytes(f))
            kinds["ok"] += 1
        except ValueError:
            kinds["refused"] += 1
        assert time.process_time() - began < 1
    assert min(kinds.values()) > mutations // 20


def test_a_list_beyond_the_file_and_frames_beyond_their_bits():
    whole = media.encode_avi(media.padded(b"abc" * 50))
    for at in range(12, 60):
        for value in (0, 0x7F, 0xFF):
            try:
                media.read_media(whole[:at] + bytes([value]) + whole[at + 1 :])
            except ValueError:
                pass
    start = whole.index(b"\xff\xc3")
    huge = whole[: start + 5] + b"\xff\xff\xff\xff" + whole[start + 9 :]
    with pytest.raises(ValueError, match="too many samples"):
        media.read_media(huge)
    short = whole[:start] + b"\xff\xc3\x00\x02" + whole[start + 4 :]
    with pytest.raises(ValueError):
        media.read_media(short)


def test_an_index_cut_within_an_entry_keeps_the_frames_before():
    payload = media.padded(b"line of text\n" * 900)
    whole = media.encode_avi(payload)
    at = whole.index(b"idx1")
    cut = whole[: at + 8 + 16 + 5]
    got = media.read_media(cut)
    assert got["frames"] == 1 and payload.startswith(got["payload"][:64])
    doubled = whole[: at + 4] + (16 * 40).to_bytes(4, "little") + whole[at + 8 : at + 24] * 40
    doubled = doubled[:4] + (len(doubled) - 8).to_bytes(4, "little") + doubled[8:]
    with pytest.raises(ValueError, match="more than the file holds"):
        media.read_media(doubled)
