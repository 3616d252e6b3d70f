"""FLAC as a media column: mono 8-bit streams, written and read many frames at a time.

Each stream has STREAMINFO (with the samples' MD5), a seek table with a point for every frame, and frames with a fixed
linear predictor and Rice-coded residuals. Frames are coded and decoded in step with each other by array operations.
Streams of other writers (mono, 8 bits) are read frame after frame: all subframes, linear predictors with coefficients of
their own, Rice partitions and escapes, with or without a seek table. Reading checks the header's CRC-8 and the frame's
CRC-16 of every frame and the MD5 of every stream; a stream that fails a check raises an error. A byte of payload is one
sample, less 128.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import textvec as tv
from tallyforge.llm.pieces import gather
from tallyforge.llm.shared import table, written

BLOCK = 1024
RATE = 8000
UNIT = 64
MAX_ORDER = 2
SLICE = 500_000


class Foreign(ValueError):
    """A frame that is sound as far as seen, but not of the form that is read many at a time."""


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for byte in range(256):
        c = byte << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.uint16)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc8(raw: bytes) -> int:
    c = 0
    for b in raw:
        c = int(_CRC8[c ^ b])
    return c


def crc16(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 of many byte spans, a byte of each at a time."""
    order = np.argsort(-size, kind="stable")
    at, left = begin[order], size[order]
    active = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1 if len(left) else 1), "right")
    c = np.zeros(len(at), np.uint16)
    for t, m in enumerate(active):
        h = c[:m]
        c[:m] = (h << np.uint16(8)) ^ _CRC16[(h >> np.uint16(8)) ^ data[at[:m] + t]]
    out = np.zeros_like(c)
    out[order] = c
    return out


def _number(n: int) -> bytes:
    """A frame's number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    k = 1
    while n >= 1 << (6 * k + (6 - k)):
        k += 1
    return bytes([(0xFF << (7 - k)) & 0xFF | n >> (6 * k), *((n >> (6 * j)) & 0x3F | 0x80 for j in range(k - 1, -1, -1))])


@lru_cache(1 << 16)
def _header(frame: int, size: int) -> bytes:
    full = size == BLOCK
    raw = bytes([0xFF, 0xF8, 0xA0 if full else 0x70, 0x02]) + _number(frame) + (b"" if full else struct.pack(">H", size - 1))
    return raw + bytes([_crc8(raw)])


@lru_cache(1 << 16)
def _parsed(raw: bytes) -> tuple[int, int, int]:
    """(frame number, samples, header bytes) from a frame's first bytes."""
    if raw[0] != 0xFF or raw[1] != 0xF8 or raw[3] != 0x02 or raw[2] >> 4 not in (7, 10):
        raise Foreign("not a mono 8-bit frame of a fixed size")
    lead, k = raw[4], 0
    if lead >= 0x80:
        while lead & (0x80 >> k):
            k += 1
        k -= 1
    n = lead if not k else lead & ((1 << (6 - k)) - 1)
    for b in raw[5 : 5 + k]:
        n = n << 6 | b & 0x3F
    end, size = 5 + k, BLOCK
    if raw[2] >> 4 == 7:
        size = struct.unpack(">H", raw[end : end + 2])[0] + 1
        end += 2
    if _crc8(raw[:end]) != raw[end]:
        raise ValueError("a frame header's CRC-8 is wrong")
    return n, size, end + 1


def _frames(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stream, number in it and samples of each frame of streams of these sizes."""
    count = -(-sizes // BLOCK)
    stream = np.repeat(np.arange(len(sizes)), count)
    number = gather(np.zeros(len(sizes), np.int64), count)
    return stream, number, np.minimum(BLOCK, sizes[stream] - number * BLOCK)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each non-empty payload."""
    x = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16) - 128
    sizes = np.fromiter(map(len, payloads), np.int64, len(payloads))
    stream, number, n = _frames(sizes)
    begin = np.cumsum(n) - n
    place = gather(np.zeros(len(n), np.int64), n)
    r = [x, np.diff(x, prepend=x[:1]), np.diff(x, 2, prepend=x[:1].repeat(2))]
    cost = []
    for order in range(MAX_ORDER + 1):
        u = np.abs(r[order])
        u[place < order] = 0
        cost.append(np.add.reduceat(u.astype(np.int64), begin) + 2 * order)
    order = np.argmin(cost, 0)
    own = np.repeat(order, n)
    res = np.select([own == 0, own == 1], [r[0], r[1]], r[2]).astype(np.int32)
    u = (res << 1) ^ (res >> 31)
    warm = place < own
    u[warm] = 0
    bits = [np.add.reduceat(u >> k, begin) + n * (k + 1) for k in range(10)]
    k = np.argmin(bits, 0)
    ks = np.repeat(k, n)
    q = u >> ks
    length = np.where(warm, 8, q + 1 + ks)
    total = np.add.reduceat(length, begin) + 10
    heads = [_header(int(a), int(b)) for a, b in zip(number, n, strict=True)]
    head = np.fromiter(map(len, heads), np.int64, len(heads))
    size = head + 1 + (total + 7) // 8 + 2
    at = np.cumsum(size) - size
    base = 8 * (at + head + 1)
    before = np.cumsum(length) - length
    pos = before - np.repeat(before[begin], n) + np.repeat(base, n) + np.where(warm, 0, 10)
    held = np.zeros(8 * int(size.sum()), np.uint8)
    for j in range(4):
        held[base + 8 * order + 6 + j] = k >> (3 - j) & 1
    w = np.flatnonzero(warm)
    for j in range(8):
        held[pos[w] + j] = (x[w].astype(np.int64) & 0xFF) >> (7 - j) & 1
    c = np.flatnonzero(~warm)
    low = pos[c] + q[c]
    held[low] = 1
    low += 1
    uc, kc = u[c], ks[c]
    for j in range(int(k.max(initial=0))):
        some = kc > j
        held[low[some] + j] = uc[some] >> (kc[some] - 1 - j) & 1
    data = np.packbits(held)
    joined = np.frombuffer(b"".join(heads), np.uint8)
    data[gather(at, head)] = joined
    data[at + head] = (8 + order) << 1
    crc = crc16(data, at, size - 2)
    data[at + size - 2], data[at + size - 1] = crc >> 8, crc & 0xFF
    raw = data.tobytes()
    first = np.searchsorted(stream, np.arange(len(sizes) + 1))
    samples = x.astype(np.int8).tobytes()
    out, offset = [], 0
    for s, total_ in enumerate(sizes.tolist()):
        a, b = int(first[s]), int(first[s + 1])
        begin_, end_ = int(at[a]), int(at[b - 1] + size[b - 1])
        info = struct.pack(">HH", BLOCK, BLOCK) + int(size[a:b].min()).to_bytes(3, "big") + int(size[a:b].max()).to_bytes(3, "big")
        info += ((RATE << 44) | (7 << 36) | total_).to_bytes(8, "big") + hashlib.md5(samples[offset : offset + total_]).digest()
        seek = b"".join(struct.pack(">QQH", BLOCK * j, int(at[a + j]) - begin_, int(n[a + j])) for j in range(b - a))
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + raw[begin_:end_])
        offset += total_
    return out


def layout(media: bytes) -> tuple[int, bytes, np.ndarray, int]:
    """(samples, MD5, seek table rows (sample, offset, samples), where frames begin) of a stream."""
    if media[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, total, md5, seek = 4, False, 0, b"", np.zeros((0, 3), np.int64)
    while not last:
        kind, size = media[at], int.from_bytes(media[at + 1 : at + 4], "big")
        body, last = media[at + 4 : at + 4 + size], bool(kind & 0x80)
        if kind & 0x7F == 0:
            total, md5 = int.from_bytes(body[10:18], "big") & ((1 << 36) - 1), body[18:34]
        elif kind & 0x7F == 3:
            rows = np.frombuffer(body, np.dtype([("s", ">u8"), ("o", ">u8"), ("n", ">u2")]))
            seek = np.stack([rows["s"], rows["o"], rows["n"]], 1).astype(np.int64)
        at += 4 + size
    return total, md5, seek, at


def _decode_frames(data: np.ndarray, at: np.ndarray, size: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Samples of all frames in a row (as bytes of payload), and the samples of each frame."""
    parsed = [_parsed(raw[a : a + 16][: min(16, s)]) for a, s in zip(at.tolist(), size.tolist(), strict=True)]
    n, head = (np.array([p[j] for p in parsed], np.int64) for j in (1, 2))
    crc = crc16(data, at, size - 2)
    if (crc != data[at + size - 2].astype(np.uint16) << np.uint16(8) | data[at + size - 1]).any():
        raise ValueError("a frame's CRC-16 is wrong")
    kind = data[at + head] >> 1
    order = kind.astype(np.int64) - 8
    if ((order < 0) | (order > MAX_ORDER) | (data[at + head] & 0x81 > 0)).any():
        raise Foreign("a subframe without a fixed predictor of order 0 to 2")
    bits = np.unpackbits(data)
    form = 8 * (at + head + 1) + 8 * order
    if any(bits[form + j].any() for j in range(6)) or np.all([bits[form + 6 + j] for j in range(4)], 0).any():
        raise Foreign("Rice partitions or escapes")
    place = np.where(bits, np.arange(len(bits), dtype=np.int32), np.int32(len(bits)))
    nxt = np.minimum.accumulate(place[::-1])[::-1]
    base = 8 * (at + head + 1)
    k = sum(bits[base + 8 * order + 6 + j].astype(np.int64) << (3 - j) for j in range(4))
    count = n - order
    lane = np.argsort(-count, kind="stable")
    p, kl, cl = (base + 8 * order + 10)[lane], k[lane] + 1, count[lane]
    active = np.searchsorted(-cl, -np.arange(1, int(cl[0]) + 1 if len(cl) else 1), "right")
    where = (np.cumsum(n) - n + order)[lane]
    start, one = np.zeros(int(n.sum()), np.int64), np.zeros(int(n.sum()), np.int64)
    for t, m in enumerate(active):
        at_ = where[:m] + t
        start[at_] = p = p[:m]
        q = nxt[p]
        one[at_] = q
        p = q + kl[:m]
    begin = np.cumsum(n) - n
    ks = np.repeat(k, n)
    low = np.zeros(len(start), np.int64)
    for j in range(int(k.max(initial=0))):
        some = ks > j
        low[some] = low[some] << 1 | bits[one[some] + 1 + j]
    u = (one - start) << ks | low
    v = (u >> 1) ^ -(u & 1)
    for j in range(MAX_ORDER):
        frames = np.flatnonzero(order > j)
        w = sum(bits[base[frames] + 8 * j + b].astype(np.int64) << (7 - b) for b in range(8)) if len(frames) else np.zeros(0, np.int64)
        v[begin[frames] + j] = (w ^ 0x80) - 0x80
    two = np.flatnonzero(order == 2)
    v[begin[two] + 1] -= v[begin[two]]
    own = np.repeat(order, n)

    def summed(values: np.ndarray, mask: np.ndarray) -> np.ndarray:
        c = np.cumsum(np.where(mask, values, 0))
        return np.where(mask, c - np.repeat(c[begin] - np.where(mask, values, 0)[begin], n), values)

    if len(two):
        first = v[begin[two]].copy()
        v[begin[two]] = 0
        v = summed(v, own == 2)
        v[begin[two]] = first
    return (summed(v, own >= 1) + 128).astype(np.uint8), n


class _Bits:
    """Bits of a byte string in order."""

    def __init__(self, raw: bytes, at: int) -> None:
        self.raw, self.at = raw, 8 * at

    def take(self, n: int) -> int:
        first, last = self.at // 8, (self.at + n + 7) // 8
        value = int.from_bytes(self.raw[first:last], "big") >> (8 * last - self.at - n) & ((1 << n) - 1)
        self.at += n
        return value

    def signed(self, n: int) -> int:
        value = self.take(n) if n else 0
        return value - (1 << n) if n and value >> (n - 1) else value

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


#: Fixed by the format: the weights of the fixed predictors, latest sample first.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def plain_frame(raw: bytes, at: int, depth: int = 8) -> tuple[list[int], int]:
    """The samples of the mono frame that begins at a byte, and where it ends; bit by bit, any subframe and residual form."""
    bits = _Bits(raw, at)
    if bits.take(15) != 0x7FFC:
        raise ValueError("a frame does not begin here")
    bits.take(1)
    code, rate, channels, width = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
    bits.take(1)
    if channels or width not in (0, 1) or depth != 8:
        raise ValueError("not mono with 8 bits")
    lead = bits.take(8)
    while lead & 0xC0 == 0xC0:
        bits.take(8)
        lead = (lead << 1) & 0xFF
    n = {1: 192, 6: 0, 7: 0}.get(code) if code in (1, 6, 7) else 576 << (code - 2) if code < 6 else 256 << (code - 8)
    n = n or bits.take(8 if code == 6 else 16) + 1
    if rate in (12, 13, 14):
        bits.take(8 if rate == 12 else 16)
    if _crc8(raw[at : bits.at // 8]) != bits.take(8):
        raise ValueError("a frame header's CRC-8 is wrong")
    bits.take(1)
    kind = bits.take(6)
    wasted = bits.unary() + 1 if bits.take(1) else 0
    width = depth - wasted
    if kind == 0:
        x = [bits.signed(width)] * n
    elif kind == 1:
        x = [bits.signed(width) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind <= 12 else kind - 31
        x = [bits.signed(width) for _ in range(order)]
        weights, shift = FIXED[order] if kind <= 12 else (), 0
        if kind >= 32:
            precision, shift = bits.take(4) + 1, bits.signed(5)
            weights = tuple(bits.signed(precision) for _ in range(order))
        wide = 5 if bits.take(2) else 4
        parts = bits.take(4)
        for part in range(1 << parts):
            k = bits.take(wide)
            escaped = bits.take(5) if k == (1 << wide) - 1 else None
            for _ in range((n >> parts) - (order if part == 0 else 0)):
                if escaped is None:
                    u = bits.unary() << k | (bits.take(k) if k else 0)
                    r = u >> 1 ^ -(u & 1)
                else:
                    r = bits.signed(escaped)
                x.append(r + (sum(w * v for w, v in zip(weights, reversed(x))) >> shift))
    else:
        raise ValueError("a subframe of a reserved kind")
    end = (bits.at + 7) // 8
    body = np.frombuffer(raw[at:end], np.uint8)
    if int(crc16(body, np.zeros(1, np.int64), np.array([len(body)]))[0]) != int.from_bytes(raw[end : end + 2], "big"):
        raise ValueError("a frame's CRC-16 is wrong")
    return [v << wasted for v in x], end + 2


def plain_decode(media: bytes) -> bytes:
    """The payload of one stream of any writer, frame after frame, with all checks made."""
    total, md5, _, at = layout(media)
    x: list[int] = []
    while at < len(media):
        more, at = plain_frame(media, at)
        x += more
    signed = np.array(x, np.int64).astype(np.int8).tobytes()
    if total and len(x) != total or md5.strip(b"\0") and hashlib.md5(signed).digest() != md5:
        raise ValueError("a stream's MD5 or length is wrong")
    return (np.array(x, np.int64) + 128).astype(np.uint8).tobytes()


def decode(medias: list[bytes]) -> list[bytes]:
    """The payload of each stream, with all checks made: many at a time, or bit by bit where a stream's form asks for it."""
    try:
        return _decode(medias)
    except Foreign:
        return [plain_decode(medias[0])] if len(medias) == 1 else [p for m in medias for p in decode([m])]


def _indexed(total: int, seek: np.ndarray) -> bool:
    """Whether a seek table names every frame."""
    return len(seek) > 0 and not seek[0, 1] and int(seek[:, 2].sum()) == total


def _decode(medias: list[bytes]) -> list[bytes]:
    laid = [layout(m) for m in medias]
    if not all(_indexed(total, seek) for total, _, seek, _ in laid):
        raise Foreign("a seek table without every frame")
    raw = b"".join(m[found[3] :] for m, found in zip(medias, laid, strict=True))
    at, size, offset = [], [], 0
    for m, (_, _, seek, frames) in zip(medias, laid, strict=True):
        at.append(seek[:, 1] + offset)
        size.append(np.diff(np.append(seek[:, 1], len(m) - frames)))
        offset += len(m) - frames
    samples, n = _decode_frames(np.frombuffer(raw, np.uint8), np.concatenate(at), np.concatenate(size), raw)
    signed, out, begin = (samples.astype(np.int16) - 128).astype(np.int8).tobytes(), [], 0
    for total, md5, _, _ in laid:
        if hashlib.md5(signed[begin : begin + total]).digest() != md5:
            raise ValueError("a stream's MD5 is wrong")
        out.append(samples[begin : begin + total].tobytes())
        begin += total
    return out


def read_range(media: bytes, first: int, count: int) -> bytes:
    """Samples first to first + count, reading only the frames that hold them; all frames where the seek table lacks some."""
    total, _, seek, frames = layout(media)
    if first < 0:
        raise ValueError("samples count from 0")
    if not _indexed(total, seek):
        return plain_decode(media)[first : first + max(0, count)]
    a = max(0, int(np.searchsorted(seek[:, 0], first, "right")) - 1)
    b = int(np.searchsorted(seek[:, 0], first + count, "left"))
    if count <= 0 or b <= a:
        return b""
    end = int(seek[b, 1]) if b < len(seek) else len(media) - frames
    raw = media[frames + int(seek[a, 1]) : frames + end]
    at = seek[a:b, 1] - seek[a, 1]
    samples, _ = _decode_frames(np.frombuffer(raw, np.uint8), at, np.diff(np.append(at, len(raw))), raw)
    skip = first - int(seek[a, 0])
    return samples[skip : skip + count].tobytes()


def encode_column(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_bytes, media): each text as UTF-8 (null: empty), zeros to a positive multiple of 64, as a FLAC stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in tv.slices(texts, SLICE):
                raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts[a:b]]
                media = encode([r.ljust(max(UNIT, -(-len(r) // UNIT) * UNIT), b"\0") for r in raw])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _groups(media: list[bytes]) -> Iterator[tuple[int, int]]:
    begin, held = 0, 0
    for k, m in enumerate(media):
        held += len(m)
        if held >= SLICE:
            yield begin, k + 1
            begin, held = k + 1, 0
    if begin < len(media):
        yield begin, len(media)


PCM = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, pcm array<struct<sample_offset: long, samples: binary>>"


def pcm_blocks(df: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) -> a row for each stream: its size and digest, and its decoded blocks of BLOCK samples, each
    with its first sample's offset. Explode `pcm` for a table of blocks that a reader can seek in."""
    kind = pa.list_(pa.struct([("sample_offset", pa.int64()), ("samples", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column(2).to_pylist()
            for a, b in _groups(media):
                blocks = [[{"sample_offset": s, "samples": p[s : s + BLOCK]} for s in range(0, len(p), BLOCK)] for p in decode(media[a:b])]
                cols = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([len(m) for m in media[a:b]], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media[a:b]]), pa.array(blocks, kind)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "media_bytes", "media_sha256", "pcm"])

    return df.select("doc_id", "n_bytes", "media").mapInArrow(run, PCM)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        rows = {k: [] for k in names[2:5] + names[7:]}
        for size, pcm in zip(batch.column(2).to_pylist(), batch.column(4), strict=True):
            p = b"".join(pcm.values.field("samples").to_pylist())
            x = np.frombuffer(p, np.uint8).astype(np.int64) - 128
            crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
            for k, v in zip(rows, (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), f"frames={len(pcm)};mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};crossings={crossings};ratio={size / len(p):.4f}"), strict=True):
                rows[k].append(v)
        own = {"doc_id": batch.column(0), "n_bytes": batch.column(1), "media_bytes": batch.column(2), "media_sha256": batch.column(3)}
        yield pa.RecordBatch.from_arrays([own[k] if k in own else pa.array(rows[k]) for k in names], names=names)


def describe(pcm: DataFrame) -> DataFrame:
    """Rows of pcm_blocks -> digests of the payload that the blocks hold and of the stored stream, and a feature string."""
    return pcm.mapInArrow(_described, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op6_flac_media(spark, sf_dir: str) -> DataFrame:
    """One row for each document: its streams are stored as a Parquet column, read back, decoded to PCM blocks, described.

    Null texts are empty, and give one unit of zeros; equal texts give equal values; repeated rows stay; ids must be whole
    numbers or null; an empty table gives no rows.
    """
    media = written(encode_column(table(spark, sf_dir, "documents"), "doc_id", "text"), "media")
    return describe(pcm_blocks(media))
