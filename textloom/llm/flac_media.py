"""Media columns: FLAC streams of 8-bit mono samples, written and read in numpy.

A stream has blocks of 192 samples and a seek point for each frame (every so many of a stream above 170
MB), so that any sample is found without reading what stands before it.  A frame takes the shortest of the
fixed predictors, a linear predictor of its own, a constant and plain samples.  Frames do not depend on each other: thousands are decoded in
step, one Rice code of each at a time.  The reader takes constant, verbatim, fixed and linear-predictor
subframes with partitioned Rice residuals (with their escape code), and verifies the CRC-8 of each
frame header, the CRC-16 of each frame, and the MD5 of the samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 192
RATE = 8000
#: Frames that are worked on at once, and samples of a PCM block.
FRAMES, PCM_BLOCK = 8192, 1 << 16
MAX_ORDER, MAX_RICE = 2, 8
#: Order of the linear predictor and bits of its coefficients, beside the fixed predictors.
LPC_ORDER, LPC_BITS = 4, 10
#: Of a seek table, which is one metadata block of less than 2^24 bytes.
MOST_POINTS = (1 << 24) // 18 - 1

_LEADING = np.array([16 if not v else 16 - int(v).bit_length() for v in range(1 << 16)], np.uint8)


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        out = (out << 1) ^ np.where(out >> (bits - 1) & 1, poly, 0).astype(np.uint32)
        out &= (1 << bits) - 1
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc16_rows(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of the first ``lengths[i]`` bytes of each row."""
    order = np.argsort(-lengths, kind="stable")
    crc, columns, sizes = np.zeros(len(rows), np.uint32), np.ascontiguousarray(rows[order].T), lengths[order]
    live = np.searchsorted(-sizes, -np.arange(columns.shape[0]), side="left")
    for j in range(int(sizes[0]) if len(sizes) else 0):
        n = live[j]
        crc[:n] = (crc[:n] << 8 & 0xFFFF) ^ _CRC16[crc[:n] >> 8 ^ columns[j, :n]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _frame_numbers(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, lengths) of frame numbers in the extended UTF-8 form."""
    n = np.searchsorted([1 << 7, 1 << 11, 1 << 16, 1 << 21, 1 << 26, 1 << 31], numbers, side="right") + 1
    out = np.zeros((len(numbers), 6), np.uint8)
    for size in np.unique(n):
        at = np.flatnonzero(n == size)
        for j in range(size):
            part = numbers[at] >> (6 * (size - 1 - j))
            out[at, j] = (part & 0x3F | 0x80) if j else part if size == 1 else part | (0xFF << (8 - size) & 0xFF)
    return out, n


def _predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, shifts) of each frame's linear predictor, by the Levinson recursion on exact autocorrelations."""
    count = len(x)
    auto = np.stack([(x[:, k:] * x[:, : BLOCK - k]).sum(axis=1) for k in range(LPC_ORDER + 1)], axis=1).astype(np.float64)
    coefs, error = np.zeros((count, LPC_ORDER)), auto[:, 0] * (1 + 1e-9) + 1e-9
    for i in range(LPC_ORDER):
        reflect = (auto[:, i + 1] - sum((coefs[:, j] * auto[:, i - j] for j in range(i)), np.zeros(count))) / error
        coefs[:, :i] -= reflect[:, None] * coefs[:, :i][:, ::-1].copy()
        coefs[:, i] = reflect
        error = np.maximum(error * (1 - reflect * reflect), 1e-9)
    largest = np.maximum(np.abs(coefs).max(axis=1), 1e-6)
    shift = np.clip(LPC_BITS - 2 - np.floor(np.log2(largest)).astype(np.int64), 0, 15)
    top = (1 << (LPC_BITS - 1)) - 1
    return np.clip(np.rint(coefs * (1 << shift)[:, None]), -top, top).astype(np.int32), shift.astype(np.int32)


def _spread(values: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` bits of each value, the highest first, on a further axis."""
    return (values[..., None] >> np.arange(n - 1, -1, -1) & 1).astype(np.uint8)


def _encode_frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, lengths) of frames: ``samples`` is (frames, 192), signed; numbers count within a stream.

    Each frame takes the shortest of the fixed predictors and the linear one, constant or verbatim samples.
    """
    count, x = len(samples), samples.astype(np.int32)
    coefs, shift = _predictors(x)
    guess = sum(coefs[:, j, None] * x[:, LPC_ORDER - 1 - j : BLOCK - 1 - j] for j in range(LPC_ORDER)) >> shift[:, None]
    # (order, bits of the predictor, residuals) of each kind of subframe
    kinds = [(o, 0, np.diff(x, n=o, axis=1) if o else x) for o in range(MAX_ORDER + 1)]
    kinds.append((LPC_ORDER, 9 + LPC_ORDER * LPC_BITS, x[:, LPC_ORDER:] - guess))
    rices, lengths, folded = [], [], []
    for o, extra, residual in kinds:
        u = (residual << 1) ^ (residual >> 31)
        k = np.minimum(MAX_RICE, np.log2(np.maximum(1, 2 * np.abs(residual).sum(axis=1) // (BLOCK - o))).astype(np.int64))
        rices.append(k)
        folded.append(u)
        lengths.append(18 + 8 * o + extra + (u >> k[:, None]).sum(axis=1) + (BLOCK - o) * (1 + k))
    chosen = np.stack(lengths).argmin(axis=0)
    width = 8 + 8 * BLOCK
    bits = np.zeros((count, width), np.uint8)
    used = np.full(count, width)
    plain = np.ones(count, bool)
    same = (x == x[:, :1]).all(axis=1)
    for kind, (o, extra, _) in enumerate(kinds):
        ready = (chosen == kind) & ~same & (lengths[kind] < width)
        for k in np.unique(rices[kind][ready]):
            at = np.flatnonzero(ready & (rices[kind] == k))
            u = folded[kind][at]
            base = 8 + 8 * o + extra
            ends = np.cumsum((u >> k) + (1 + k), axis=1) + base + 10
            plain[at], used[at] = False, ends[:, -1]
            rows = bits[at]
            rows[:, :8] = np.unpackbits(np.array([(32 | o - 1 if extra else 8 | o) << 1], np.uint8))
            if o:
                rows[:, 8 : 8 + 8 * o] = np.unpackbits((x[at, :o] & 0xFF).astype(np.uint8), axis=1)
            if extra:
                head = 8 + 8 * o
                rows[:, head : head + 4] = _spread(np.array([LPC_BITS - 1]), 4)
                rows[:, head + 4 : head + 9] = _spread(shift[at], 5)
                rows[:, head + 9 : base] = _spread(coefs[at], LPC_BITS).reshape(len(at), -1)
            rows[:, base + 6 : base + 10] = _spread(np.array([k]), 4)
            flat, last = rows.reshape(-1), (np.arange(len(at)) * width)[:, None] + ends
            flat[last - (k + 1)] = 1
            for j in range(k):
                flat[last - (j + 1)] = u >> j & 1
            bits[at] = rows
    at = np.flatnonzero(plain & ~same)
    bits[at, 6] = 1
    bits[at, 8:] = np.unpackbits((x[at] & 0xFF).astype(np.uint8), axis=1)
    at = np.flatnonzero(same)
    bits[at, 8:16], used[at] = np.unpackbits((x[at, :1] & 0xFF).astype(np.uint8), axis=1), 16
    body, size = np.packbits(bits, axis=1), -(-used // 8)
    text, n = _frame_numbers(numbers)
    rows = np.zeros((count, 4 + 6 + 1 + body.shape[1] + 2), np.uint8)
    rows[:, :4] = [0xFF, 0xF8, 0x10, 0x02]
    for h in np.unique(n):
        at = np.flatnonzero(n == h)
        rows[at, 4 : 4 + h] = text[at, :h]
        crc = np.zeros(len(at), np.uint32)
        for j in range(4 + h):
            crc = _CRC8[crc ^ rows[at, j]]
        rows[at, 4 + h] = crc
        rows[at, 5 + h : 5 + h + body.shape[1]] = body[at]
    length = 5 + n + size
    crc, each = _crc16_rows(rows, length), np.arange(count)
    rows[each, length], rows[each, length + 1] = crc >> 8, crc & 0xFF
    return rows, length + 2


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload, whose length is a positive multiple of 192 bytes."""
    counts = np.array([len(p) // BLOCK for p in payloads])
    joined = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    numbers = np.concatenate([np.arange(c) for c in counts])
    parts, sizes = [], []
    for at in range(0, len(joined), FRAMES):
        rows, length = _encode_frames((joined[at : at + FRAMES] ^ 0x80).view(np.int8), numbers[at : at + FRAMES])
        parts.append(rows[np.arange(rows.shape[1]) < length[:, None]].tobytes())
        sizes.append(length)
    frames, sizes, out, done, first = b"".join(parts), np.concatenate(sizes), [], 0, 0
    for payload, count in zip(payloads, counts):
        own = sizes[first : first + count]
        each = np.arange(0, count, -(-count // MOST_POINTS))  # every frame, or every so many of a very long stream
        points = np.zeros(len(each), np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
        points["sample"], points["offset"], points["n"] = each * BLOCK, (np.cumsum(own) - own)[each], BLOCK
        md5 = hashlib.md5((np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()).digest()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3) + int(own.max()).to_bytes(3) + (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8) + md5
        size, table = int(own.sum()), points.tobytes()
        out.append(b"fLaC\x00" + len(info).to_bytes(3) + info + b"\x83" + len(table).to_bytes(3) + table + frames[done : done + size])
        done, first = done + size, first + count
    return out


class _Bits:
    """64-bit windows at bit positions of a buffer, for many positions at once."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        self.data, self.windows = padded, np.zeros(len(data) + 8, np.uint64)
        for j in range(8):
            self.windows |= padded[j : j + len(self.windows)].astype(np.uint64) << np.uint64(56 - 8 * j)

    def peek(self, at: np.ndarray) -> np.ndarray:
        return self.windows[at >> 3] << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, n) -> np.ndarray:
        """Unsigned values of ``n`` (0 to 32) bits."""
        n = np.broadcast_to(np.asarray(n, np.uint64), at.shape)
        return np.where(n > 0, self.peek(at) >> (np.uint64(64) - np.maximum(n, 1)), np.uint64(0)).astype(np.int64)

    def signed(self, at: np.ndarray, n) -> np.ndarray:
        value, n = self.take(at, n), np.asarray(n, np.int64)
        return np.where((n > 0) & (value >> np.maximum(n - 1, 0) & 1 == 1), value - (1 << n), value)

    def unary(self, at: np.ndarray) -> np.ndarray:
        """The number of zero bits at each position."""
        zeros = _LEADING[(self.peek(at) >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        more = np.flatnonzero(zeros == 16)
        while len(more):
            step = _LEADING[(self.peek(at[more] + zeros[more]) >> np.uint64(48)).astype(np.int64)]
            zeros[more] += step
            more = more[step == 16]
        return zeros


def _residuals(bits: _Bits, at: np.ndarray, size: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(residuals, positions behind them) of frames of one size and order; ``at`` is at the coding method."""
    method, parts = bits.take(at, 2), bits.take(at + 2, 4)
    out, ends = np.zeros((len(at), size - order), np.int64), at.copy()
    if (method > 1).any():
        raise ValueError("unknown residual coding")
    for wide, split in {(int(a), int(b)) for a, b in zip(method, parts)}:
        rows = np.flatnonzero((method == wide) & (parts == split))
        pos, done, width = at[rows] + 6, 0, 4 + wide
        found = np.zeros((size - order, len(rows)), np.int64)
        for p in range(1 << split):
            rice = bits.take(pos, width)
            raw = rice == (1 << width) - 1
            pos = pos + width
            plain = np.where(raw, bits.take(pos, 5), 0)
            pos = pos + np.where(raw, 5, 0)
            k = np.where(raw, 0, rice)
            any_raw, shift, bits_k = raw.any(), np.uint64(64) - np.maximum(k, 1).astype(np.uint64), k.astype(np.uint64)
            for _ in range((size >> split) - (order if p == 0 else 0)):
                q = bits.unary(pos)
                low = np.where(k > 0, (bits.peek(pos + q + 1) >> shift), np.uint64(0)).astype(np.int64)
                u = q << k | low
                value = (u >> 1) ^ -(u & 1)
                if any_raw:
                    value = np.where(raw, bits.signed(pos, plain), value)
                    pos = pos + np.where(raw, plain, q + 1 + k)
                else:
                    pos = pos + q + 1 + k
                found[done] = value
                done += 1
        out[rows], ends[rows] = found.T, pos
    return out, ends


def _restore(warm: np.ndarray, residual: np.ndarray, coefs: np.ndarray | None, shift: np.ndarray | None) -> np.ndarray:
    """Samples from warm-up samples and residuals; ``coefs`` is None for fixed predictors."""
    order = warm.shape[1]
    if coefs is None:
        x = residual
        for o in range(order - 1, -1, -1):
            x = np.cumsum(np.concatenate([np.diff(warm[:, : o + 1], n=o, axis=1), x], axis=1), axis=1)
        return x
    x = np.concatenate([warm, residual], axis=1)
    for t in range(order, x.shape[1]):
        x[:, t] += (coefs * x[:, t - order : t][:, ::-1]).sum(axis=1) >> shift
    return x


def _decode_frames(bits: _Bits, starts: np.ndarray, depth: int, limit: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(samples of each frame, byte behind each frame) of the frames that start at ``starts``."""
    data, each = bits.data, np.arange(len(starts))
    if (data[starts] != 0xFF).any() or (data[starts + 1] & 0xFE != 0xF8).any():
        raise ValueError("no frame where one should start")
    size_code, rate_code = data[starts + 2] >> 4, data[starts + 2] & 15
    if (data[starts + 3] >> 4 != 0).any():
        raise ValueError("more than one channel")
    lead = data[starts + 4].astype(np.int64)
    number = np.where(lead < 0x80, 1, _LEADING[(~lead & 0xFF) << 8].astype(np.int64))
    at = starts + 4 + number
    more = np.select([size_code == 6, size_code == 7], [1, 2], 0)
    raw = data[at].astype(np.int64)
    raw2 = raw << 8 | data[at + 1]
    code = size_code.astype(np.int64)
    size = np.select([code == 1, (code >= 2) & (code <= 5), code == 6, code == 7], [192, 576 << np.maximum(code - 2, 0), raw + 1, raw2 + 1], 256 << np.maximum(code - 8, 0))
    at = at + more + np.select([rate_code == 12, (rate_code == 13) | (rate_code == 14)], [1, 2], 0)
    head, crc = at - starts, np.zeros(len(starts), np.uint32)
    for j in range(int(head.max())):
        live = j < head
        crc[live] = _CRC8[crc[live] ^ data[starts[live] + j]]
    if (crc != data[at]).any():
        raise ValueError("a frame header does not fit its CRC-8")
    at = (at + 1) * 8
    kind, wasted = bits.take(at + 1, 6), bits.take(at + 7, 1)
    if wasted.any():
        raise ValueError("wasted bits are not supported")
    at = at + 8
    ends, out = at.copy(), [None] * len(starts)
    for k, n in {(int(a), int(b)) for a, b in zip(kind, size)}:
        rows = np.flatnonzero((kind == k) & (size == n))
        pos = at[rows]
        if k == 0:
            x = np.repeat(bits.signed(pos, depth)[:, None], n, axis=1)
            pos = pos + depth
        elif k == 1:
            x = np.stack([bits.signed(pos + depth * t, depth) for t in range(n)], axis=1)
            pos = pos + depth * n
        elif 8 <= k <= 12 or k >= 32:
            order = k - 8 if k < 32 else k - 31
            warm = np.stack([bits.signed(pos + depth * t, depth) for t in range(order)], axis=1) if order else np.zeros((len(rows), 0), np.int64)
            pos, coefs, shift = pos + depth * order, None, None
            if k >= 32:
                precision, shift = bits.take(pos, 4) + 1, bits.signed(pos + 4, 5)
                if (precision == 16).any() or (shift < 0).any():
                    raise ValueError("invalid linear predictor")
                pos = pos + 9
                coefs = np.stack([bits.signed(pos + precision * t, precision) for t in range(order)], axis=1)
                pos = pos + precision * order
            residual, pos = _residuals(bits, pos, n, order)
            x = _restore(warm, residual, coefs, shift)
        else:
            raise ValueError("reserved subframe")
        ends[rows] = pos
        for i, row in zip(rows, x):
            out[i] = row
    behind = -(-ends // 8)
    length = behind - starts
    if (behind + 2 > limit).any():
        raise ValueError("a frame is cut off")
    columns = starts[:, None] + np.arange(int(length.max()))
    crc = _crc16_rows(data[np.minimum(columns, len(data) - 1)], length)
    if (crc != (data[behind].astype(np.uint32) << 8 | data[behind + 1])).any():
        raise ValueError("a frame does not fit its CRC-16")
    return out, behind + 2


def _parse(stream: bytes) -> dict:
    """What the metadata of a stream say: depth, samples, md5, seek points, where frames begin."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, found = 4, False, {"points": []}
    while not last:
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4])
        block = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(block[10:18])
            found |= {"channels": (packed >> 41 & 7) + 1, "depth": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": block[18:34]}
        elif kind == 3:
            points = np.frombuffer(block, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
            found["points"] += [points[points["sample"] != 2**64 - 1]]
        at += 4 + size
    return found | {"frames": at}


def decode(streams: list[bytes], verify_md5: bool = True) -> list[np.ndarray]:
    """Signed samples of each mono stream, with all checksums verified."""
    heads = [_parse(s) for s in streams]
    if any(h["channels"] != 1 for h in heads):
        raise ValueError("more than one channel")
    depths = {h["depth"] for h in heads}
    if len(depths) > 1:
        return [x for s in streams for x in decode([s], verify_md5)]
    bits = _Bits(np.frombuffer(b"".join(streams), np.uint8))
    base = np.cumsum([0] + [len(s) for s in streams])
    starts, ends, owner = [], [], []
    for i, head in enumerate(heads):
        offsets = np.concatenate([p["offset"].astype(np.int64) for p in head["points"]] + [np.zeros(1, np.int64)])
        own = base[i] + head["frames"] + np.unique(offsets)
        own = own[own < base[i + 1]]
        starts.append(own)
        ends.append(np.append(own[1:], base[i + 1])[: len(own)])
        owner.append(np.full(len(own), i))
    at, ends, owner = (np.concatenate(x) for x in (starts, ends, owner))
    # from each seek point on, one frame after the other; all points are in step
    parts: list[list[np.ndarray]] = [[] for _ in at]
    live = np.arange(len(at))
    while len(live):
        for k in range(0, len(live), FRAMES):
            some = live[k : k + FRAMES]
            frames, behind = _decode_frames(bits, at[some], heads[0]["depth"], ends[some])
            for j, x in zip(some.tolist(), frames):
                parts[j].append(x)
            at[some] = behind
        if (at > ends).any():
            raise ValueError("a frame does not end at the next seek point")
        live = live[at[live] < ends[live]]
    first = np.searchsorted(owner, np.arange(len(streams) + 1))
    out = [np.concatenate([np.zeros(0, np.int64), *(x for p in parts[first[i] : first[i + 1]] for x in p)]) for i in range(len(streams))]
    for head, x in zip(heads, out):
        if len(x) != head["samples"]:
            raise ValueError("the number of samples is wrong")
        if verify_md5 and any(head["md5"]):
            if hashlib.md5(x.astype(f"<i{-(-head['depth'] // 8)}").tobytes()).digest() != head["md5"]:
                raise ValueError("the samples do not fit their MD5")
    return out


def pcm_blocks(samples: np.ndarray, size: int = PCM_BLOCK) -> list[tuple[int, bytes]]:
    """(sample offset, unsigned 8-bit PCM) blocks of one stream."""
    data = ((samples + 128) & 0xFF).astype(np.uint8)
    return [(at, data[at : at + size].tobytes()) for at in range(0, len(data), size)]


def padded(text: str | None) -> tuple[bytes, int]:
    """(the UTF-8 bytes of a text, spaces appended to a positive multiple of 192; their own number)."""
    raw = (text or "").encode("utf-8")
    return raw.ljust(max(1, -(-len(raw) // BLOCK)) * BLOCK, b" "), len(raw)


def _grouped(column, most: int = 1 << 20):
    """Slices of a column with about ``most`` bytes of text each."""
    at, size = 0, 0
    for i, value in enumerate(column):
        size += len(value.as_buffer()) if value.is_valid else 0
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(column):
        yield at, len(column)


def _store_batches(batches):
    for batch in batches:
        for a, b in _grouped(batch.column(1)):
            part = batch.slice(a, b - a)
            payloads, sizes = zip(*[padded(t.as_py()) for t in part.column(1)])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(encode(list(payloads)), pa.binary())], ["id", "n_bytes", "media"])


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text's UTF-8 bytes as a FLAC stream, padded with spaces.

    A null text is empty and padded like any other; equal texts give equal streams; repeated rows and
    null ids stay; an empty table stays empty; other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_store_batches, f"id {kind}, n_bytes long, media binary")


def _decoded(batches):
    for batch in batches:
        for a, b in _grouped(batch.column(2)):
            part = batch.slice(a, b - a)
            media = [m.as_py() for m in part.column(2)]
            yield part, media, decode(media)


def _block_batches(batches):
    kind = pa.schema([("id", pa.int64()), ("block", pa.int64()), ("sample_offset", pa.int64()), ("pcm", pa.binary())])
    for part, _, samples in _decoded(batches):
        rows = [(i.as_py(), k, at, pcm) for i, x in zip(part.column(0), samples) for k, (at, pcm) in enumerate(pcm_blocks(x))]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)


def read_pcm_blocks(media: DataFrame) -> DataFrame:
    """(id, block, sample_offset, pcm): the decoded samples of ``media(id, n_bytes, media)``.

    Rows of null media have no blocks; ids are integers.
    """
    return media.where("media is not null").select(F.col("id").cast("long").alias("id"), "n_bytes", "media").select("id", "n_bytes", "media").mapInArrow(_block_batches, "id long, block long, sample_offset long, pcm binary")


def feature(samples: np.ndarray) -> str:
    """Length, energy, zero crossings, peak, and the autocorrelation at lags of 1, 2, 4, 8 and 16 samples.

    All are exact integers, so equal streams have equal features wherever they are computed.
    """
    x = samples.astype(np.int64)
    lags = ",".join(str(int((x[k:] * x[:-k]).sum())) for k in (1, 2, 4, 8, 16))
    return f"n={len(x)};energy={int((x * x).sum())};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};peak={int(np.abs(x).max(initial=0))};lags={lags}"


def _report_batches(batches):
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for part, media, samples in _decoded(batches):
        pcm = [b"".join(p for _, p in pcm_blocks(x)) for x in samples]
        columns = [
            pa.array([len(p) for p in pcm], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in pcm]), pa.array([zlib.crc32(p[-16:]) for p in pcm], pa.int64()),
            pa.array([len(m) for m in media], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.array([feature(x) for x in samples]),
        ]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names)


def media_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of each text's stream and of the PCM blocks that are read back from it."""
    kind = dict(docs.dtypes)[id_col]
    schema = f"{id_col} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return store_media(docs, id_col, text_col).mapInArrow(_report_batches, schema)
