"""FLAC media columns: texts as 8-bit mono samples, and a decoder that works on many frames at a time.

A byte less 128 is a sample. Each frame is stored as a constant, verbatim, with a fixed predictor of order 0 to 4
or with a linear predictor of order LPC_ORDER fitted to it, whichever takes fewest bits.

Decoding takes all streams of a batch together: a lane per seek point (a stream without seek table is one
lane), and every step reads the next Rice residual of each lane, so numpy does the bit work for thousands of
frames at once. Constant, verbatim, fixed and linear-predictor subframes of one 8-bit channel are understood,
with any partition order; frame numbers, header and frame checksums and the stream's MD5 are verified. What comes out
are PCM blocks with the offset of their first sample, which are written; any of them can be read alone, and a
stretch of samples is decoded from the seek point before it.

Defined results: null text counts as empty; the payload of an empty text is one frame of padding; repeated rows
give equal media; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, tokens

FRAME = 576
RATE = 8000
#: Frames between seek points, and in a PCM block.
SEEK_FRAMES = 8
#: Bytes of streams decoded together: enough lanes to keep numpy busy.
DECODE_BYTES = 6 << 20
#: Order of the linear predictors that the encoder fits, and bits of their factors.
LPC_ORDER, PRECISION = 4, 12
#: Parts in which whole tables are stored and decoded: at least so many, and as many as the planner's size of the table asks
#: for; more than MOST_SLICES are none, as each is a job of its own.
SLICES, SLICE_BYTES, MOST_SLICES = 4, 8 << 30, 4096
#: Kinds of subframe that the encoder tells apart: FIXED + order, or these.
CONSTANT, VERBATIM, LPC = 5, 6, 7


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = []
    for b in range(256):
        c = b << bits - 8
        for _ in range(8):
            c = (c << 1 ^ poly if c >> bits - 1 else c << 1) & (1 << bits) - 1
        out.append(c)
    return np.array(out, np.int64)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(CRC8[c ^ b])
    return c


def crc16s(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-16 of runs of bytes, a byte of each at a time."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    crc = np.zeros(len(sizes), np.int64)
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(1, steps + 1), side="right")
    for t in range(steps):
        k = active[t]
        c = crc[:k]
        crc[:k] = (c << 8 & 0xFFFF) ^ CRC16[c >> 8 ^ data[starts[:k] + t]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def coded_number(n: int) -> bytes:
    """A number in the extended UTF-8 form of frame headers."""
    if n < 0x80:
        return bytes([n])
    tail = []
    lead = 0x3F
    while n > lead:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        lead >>= 1
    return bytes([~(lead << 1 | 1) & 0xFF | n, *tail[::-1]])


def _frame_header(number: int) -> bytes:
    # fixed block size, 576 samples, rate from STREAMINFO, mono, 8 bits
    head = b"\xff\xf8\x20\x02" + coded_number(number)
    return head + bytes([crc8(head)])


_headers: list[bytes] = []


def linear_predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised factors [frame, order] and shifts of each frame's best linear predictor (Levinson-Durbin)."""
    p, f = LPC_ORDER, x.astype(np.float64)
    r = np.stack([(f[:, : f.shape[1] - lag] * f[:, lag:]).sum(axis=1) for lag in range(p + 1)], axis=1)
    a, error = np.zeros((len(x), p)), r[:, 0] + 1e-9
    for i in range(p):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / error
        a[:, :i], a[:, i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1], k
        error = np.maximum(error * (1 - k * k), 1e-9)
    most = np.abs(a).max(axis=1)
    shift = np.clip(PRECISION - 1 - np.ceil(np.log2(np.maximum(most, 1e-9))).astype(np.int64), 0, 15)
    top = (1 << PRECISION - 1) - 1
    return np.clip(np.round(a * (1 << shift)[:, None]), -top - 1, top).astype(np.int64), shift


def _residuals(x: np.ndarray, kind: int, factors: np.ndarray | None = None, shift: np.ndarray | None = None) -> np.ndarray:
    """What the predictor leaves of the samples [frame, sample] after the warm-up ones."""
    if kind == LPC:
        n = x.shape[1] - LPC_ORDER
        guess = sum(x[:, LPC_ORDER - 1 - j : LPC_ORDER - 1 - j + n] * factors[:, j, None] for j in range(LPC_ORDER))
        return x[:, LPC_ORDER:] - (guess >> shift[:, None])
    return np.diff(x, kind, axis=1) if kind else x


def _folded(r: np.ndarray) -> np.ndarray:
    return np.where(r >= 0, r << 1, ~r << 1 | 1)


def _spread(value: np.ndarray, bits: int) -> np.ndarray:
    """Numbers [frame] or [frame, k] as bits, most significant first."""
    held = value.reshape(len(value), -1)
    return (held[:, :, None] >> np.arange(bits - 1, -1, -1) & 1).reshape(len(value), -1).astype(np.uint8)


def _coded(x: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Subframes after their type byte, end to end, and the bytes of each; all frames have one kind of predictor."""
    order = LPC_ORDER if kind == LPC else kind
    head = [_spread(x[:, :order] & 255, 8)]
    factors = shift = None
    if kind == LPC:
        factors, shift = linear_predictors(x)
        head += [_spread(np.full(len(x), PRECISION - 1), 4), _spread(shift, 5), _spread(factors & (1 << PRECISION) - 1, PRECISION)]
    u = _folded(_residuals(x, kind, factors, shift))
    costs = np.stack([(u >> k).sum(axis=1) + u.shape[1] * (1 + k) for k in range(12)])
    k = costs.argmin(axis=0)
    # Rice coding in one partition: its parameter, then the codes
    bits = np.concatenate([*head, np.zeros((len(x), 6), np.uint8), _spread(k, 4)], axis=1)
    body = -(-(bits.shape[1] + costs[k, np.arange(len(x))]) // 8)
    local = (np.cumsum(body) - body) * 8
    stream = np.zeros(int(body.sum()) * 8, np.uint8)
    stream[local[:, None] + np.arange(bits.shape[1])] = bits
    kk = k[:, None]
    length = (u >> kk) + 1 + kk
    stop = local[:, None] + bits.shape[1] + np.cumsum(length, axis=1) - length + (u >> kk)
    stream[stop.ravel()] = 1
    for j in range(int(k.max(initial=0))):
        rows = k > j
        # bit j from below lies at the stop bit's place + k - j
        stream[(stop[rows] + kk[rows] - j).ravel()] = (u[rows] >> j & 1).ravel()
    return np.packbits(stream), body


def _chosen(x: np.ndarray) -> np.ndarray:
    """The kind of each frame, by the bits that its residuals take about."""
    factors, shift = linear_predictors(x)
    costs = np.full((8, len(x)), np.inf)
    for kind in (*range(5), LPC):
        u = _folded(_residuals(x, kind, factors, shift))
        n, total = u.shape[1], u.sum(axis=1)
        k = np.maximum(np.log2(np.maximum(total / n, 1e-9) * np.log(2)).round(), 0)
        costs[kind] = n * (1 + k) + np.maximum(total - n * (2**k - 1) / 2, 0) / 2**k + 8 * (FRAME - n)
    costs[LPC] += 9 + PRECISION * LPC_ORDER
    costs[VERBATIM] = 8 * FRAME - 10
    costs[CONSTANT] = np.where((x == x[:, :1]).all(axis=1), 0, np.inf)
    return costs.argmin(axis=0)


def encode(payload: np.ndarray, frames: np.ndarray) -> list[bytes]:
    """FLAC streams of byte payloads laid end to end; frames: the number of 576-byte frames of each."""
    raw = (payload ^ 128).view(np.int8)
    x = raw.reshape(-1, FRAME).astype(np.int64)
    n = len(x)
    kind = _chosen(x) if n else np.zeros(0, np.int64)
    number = np.arange(n) - np.repeat(np.cumsum(frames) - frames, frames)
    while len(_headers) <= (int(number.max()) if n else -1):
        _headers.append(_frame_header(len(_headers)))
    heads = np.array([len(_headers[i]) for i in number.tolist()], np.int64)
    body = np.where(kind == CONSTANT, 1, FRAME)
    coded = {}
    for c in np.unique(kind).tolist():
        if c not in (CONSTANT, VERBATIM):
            rows = np.flatnonzero(kind == c)
            coded[c] = (rows, *_coded(x[rows], c))
            body[rows] = coded[c][2]
    sizes = heads + 1 + body + 2
    ends = np.cumsum(sizes)
    starts = ends - sizes
    out = np.zeros(int(ends[-1]) if n else 0, np.uint8)
    joined = np.frombuffer(b"".join(_headers[i] for i in number.tolist()), np.uint8)
    out[np.repeat(starts - (np.cumsum(heads) - heads), heads) + np.arange(len(joined))] = joined
    at = starts + heads
    out[at] = np.array([16, 18, 20, 22, 24, 0, 2, 2 * (31 + LPC_ORDER)])[kind]
    constant, verbatim = kind == CONSTANT, kind == VERBATIM
    out[at[constant] + 1] = x[constant, 0] & 255
    out[at[verbatim, None] + 1 + np.arange(FRAME)] = x[verbatim] & 255
    for rows, data, size in coded.values():
        out[np.repeat(at[rows] + 1 - (np.cumsum(size) - size), size) + np.arange(len(data))] = data
    crc = crc16s(out, starts, sizes - 2)
    out[ends - 2], out[ends - 1] = crc >> 8, crc & 0xFF
    streams, f = [], 0
    held, samples = memoryview(out), memoryview(raw)
    for m in frames.tolist():
        md5 = hashlib.md5(samples[f * FRAME : (f + m) * FRAME]).digest()
        info = struct.pack(">HH", FRAME, FRAME) + bytes(6) + (RATE << 44 | 7 << 36 | m * FRAME).to_bytes(8, "big") + md5
        points = [struct.pack(">QQH", j * FRAME, int(starts[f + j] - starts[f]), FRAME) for j in range(0, m, SEEK_FRAMES)]
        blocks = b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + (18 * len(points)).to_bytes(3, "big") + b"".join(points)
        streams.append(b"fLaC" + blocks + bytes(held[starts[f] : ends[f + m - 1]]))
        f += m
    return streams


class Bits:
    """Bit readers over one buffer, one per lane."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data = np.concatenate([data, np.zeros(16, np.uint8)])
        self.windows = np.lib.stride_tricks.sliding_window_view(self.data, 8)
        self.at = at * 8

    def part(self, lanes: np.ndarray) -> "Bits":
        """Readers of these lanes alone, at their places."""
        out = object.__new__(Bits)
        out.data, out.windows, out.at = self.data, self.windows, self.at[lanes]
        return out

    def window(self, lanes) -> np.ndarray:
        """The next 57 bits at least, from the top."""
        at = self.at[lanes]
        return self.windows[at >> 3].view(">u8").ravel().astype(np.uint64) << (at & 7).astype(np.uint64)

    def read(self, lanes, n) -> np.ndarray:
        """n (up to 57) bits of the lanes as unsigned numbers."""
        n = np.broadcast_to(np.asarray(n, np.int64), self.at[lanes].shape)
        out = np.where(n > 0, self.window(lanes) >> (64 - np.maximum(n, 1)).astype(np.uint64), np.uint64(0)).astype(np.int64)
        self.at[lanes] += n
        return out

    def signed(self, lanes, n) -> np.ndarray:
        x = self.read(lanes, n)
        n = np.asarray(n)
        return np.where((n > 0) & (x >> np.maximum(n - 1, 0) & 1 > 0), x - (1 << n), x)

    def rice(self, lanes, k: np.ndarray) -> np.ndarray:
        """Rice codes with parameters k, unfolded."""
        w = self.window(lanes)
        top = (w >> np.uint64(32)).astype(np.int64)
        q = 32 - np.frexp(top.astype(np.float64))[1].astype(np.int64)
        if not top.all():  # long runs of zeros
            dry = np.flatnonzero(top == 0)
            q = q.copy()
            q[dry] = 0
            mine = dry if isinstance(lanes, slice) else lanes[dry]
            while len(dry):
                t = (self.window(mine) >> np.uint64(32)).astype(np.int64)
                more = t == 0
                step = np.where(more, 32, 32 - np.frexp(np.maximum(t, 1).astype(np.float64))[1])
                q[dry] += step
                self.at[mine[more]] += 32
                if (self.at > self.windows.shape[0] * 8 - 64).any():
                    raise ValueError("FLAC: a code runs beyond the stream")
                dry, mine = dry[more], mine[more]
            skipped = q // 32 * 32
            w = self.window(lanes)
            near = q - skipped
        else:
            near = q
        low = np.where(k > 0, (w << (near + 1).astype(np.uint64)) >> (64 - np.maximum(k, 1)).astype(np.uint64), np.uint64(0)).astype(np.int64)
        self.at[lanes] += near + 1 + k
        u = q << k | low
        return u >> 1 ^ -(u & 1)


FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def _subframes(bits: Bits, lanes: np.ndarray, size: int) -> np.ndarray:
    """The next subframe of each lane: [lane, sample]."""
    head = bits.read(lanes, 8)
    kind = head >> 1 & 63
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    if (head & 0x81).any() or not (fixed | lpc | (kind < 2)).all():
        raise ValueError("FLAC: wasted bits or a subframe of a reserved type")
    out = np.zeros((len(lanes), size), np.int64)
    some = np.flatnonzero(kind == 0)
    out[some] = bits.signed(lanes[some], 8)[:, None]
    some = np.flatnonzero(kind == 1)
    out[some] = bits.data[(bits.at[lanes[some]] >> 3)[:, None] + np.arange(size)].view(np.int8)
    bits.at[lanes[some]] += 8 * size
    some = np.flatnonzero(fixed | lpc)
    if len(some):
        mine = bits.part(lanes[some])
        order = np.where(fixed, kind - 8, kind - 31)[some]
        if (order > size).any():
            raise ValueError("FLAC: a predictor longer than its frame")
        out[some] = _predicted(mine, order, lpc[some], size).T
        bits.at[lanes[some]] = mine.at
    return out


def _predicted(bits: Bits, order: np.ndarray, lpc: np.ndarray, size: int) -> np.ndarray:
    """Subframes with predictors of all lanes of the readers: [sample, lane]."""
    n, top = len(order), int(order.max())
    every, lanes = slice(None), np.arange(n)
    out = np.zeros((size, n), np.int64)
    for i in range(top):
        rows = np.flatnonzero(order > i)
        out[i, rows] = bits.signed(rows, 8)
    factors, shift = np.zeros((max(top, 4), n), np.int64), np.zeros(n, np.int64)
    for o in range(1, 5):
        factors[:o, ~lpc & (order == o)] = np.array(FIXED[o])[:, None]
    rows = np.flatnonzero(lpc)
    if len(rows):
        precision = bits.read(rows, 4) + 1
        shift[rows] = bits.signed(rows, 5)
        for i in range(int(order[rows].max())):
            some = order[rows] > i
            factors[i, rows[some]] = bits.signed(rows[some], precision[some])
    method = bits.read(lanes, 2)
    if (method > 1).any():
        raise ValueError("FLAC: a reserved residual coding")
    wide, span = 4 + method, size // (1 << bits.read(lanes, 4))
    k, raw, some_raw = np.zeros(n, np.int64), np.full(n, -1, np.int64), False
    boundaries = {int(x) for s in np.unique(span) for x in range(0, size, int(s))} | {int(o) for o in np.unique(order)}
    for i in range(size):
        if i in boundaries:
            fresh = np.flatnonzero((i >= order) & ((i % span == 0) | (i == order)))
            k[fresh] = bits.read(fresh, wide[fresh])
            escaped = fresh[k[fresh] == (1 << wide[fresh]) - 1]
            raw[fresh] = -1
            raw[escaped] = bits.read(escaped, 5)
            k[escaped] = 0
            some_raw = bool((raw >= 0).any())
        # samples before the first are 0, and so are factors beyond a lane's order
        guess = sum((out[i - 1 - j] * factors[j] for j in range(min(top, i))), np.zeros(n, np.int64)) >> shift
        if i >= top and not some_raw:
            out[i] = bits.rice(every, k) + guess
            continue
        live = i >= order
        rows = np.flatnonzero(live & (raw < 0))
        out[i, rows] = bits.rice(rows, k[rows]) + guess[rows]
        rows = np.flatnonzero(live & (raw >= 0))
        out[i, rows] = bits.signed(rows, raw[rows]) + guess[rows]
    return out


def decode(streams: list[bytes], first: int = 0, last: int | None = None) -> list[np.ndarray]:
    """The samples of FLAC streams of one 8-bit channel and one block size.

    first, last: only these samples (last not included) are given, and only what lies between the seek points
    around them is read; the stream's MD5 is verified where all of it is.
    """
    data = np.frombuffer(b"".join(streams), np.uint8)
    base, lanes, totals, sums, sizes = 0, [], [], [], set()
    for s, stream in enumerate(streams):
        if stream[:4] != b"fLaC":
            raise ValueError("FLAC: no stream")
        at, points, final, info = 4, [(0, 0)], False, b""
        while not final:
            head, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
            block = stream[at + 4 : at + 4 + size]
            final, kind, at = bool(head & 128), head & 127, at + 4 + size
            if kind == 0:
                info = block
            elif kind == 3:
                points = [(a, b) for a, b, _ in struct.iter_unpack(">QQH", block) if a != (1 << 64) - 1]
        size, rest = int.from_bytes(info[:2], "big"), int.from_bytes(info[10:18], "big")
        if rest >> 36 & 0xFF != 7 or info[:2] != info[2:4]:
            raise ValueError("FLAC: one channel of 8 bits in blocks of one size is expected")
        sizes.add(size)
        totals.append(rest & (1 << 36) - 1)
        sums.append(info[18:34])
        stops = [a for a, _ in points[1:]] + [totals[-1]]
        end = totals[-1] if last is None else last
        lanes += [(s, base + at + b, a, stop) for (a, b), stop in zip(points, stops) if stop > max(a, first) and a < end]
        base += len(stream)
    if len(sizes) > 1:
        raise ValueError("FLAC: streams of one block size are expected")
    size = sizes.pop() if sizes else FRAME
    outs = [np.zeros(t, np.int8) for t in totals]
    which = np.array([x[0] for x in lanes], np.int64)
    bits = Bits(data, np.array([x[1] for x in lanes], np.int64))
    sample, stop = (np.array([x[i] for x in lanes], np.int64) for i in (2, 3))
    while True:
        live = np.flatnonzero(sample < stop)
        if not len(live):
            break
        start = bits.at[live] >> 3
        if (stop[live] - sample[live] < size).any():
            raise ValueError("FLAC: a frame of another size")
        # sync code, block size, rate, channel and sample size; then the frame's number and the header's CRC-8
        head = bits.read(live, 32)
        if ((head >> 16 != 0xFFF8) | (head >> 4 & 15 != 0) | (head >> 1 & 7 != 1) & (head >> 1 & 7 != 0)).any():
            raise ValueError("FLAC: bad frame header")
        lead = bits.read(live, 8)
        extra = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [0, 1, 2, 3, 4, 5], 6)
        number = np.where(extra > 0, lead & (0x3F >> extra), lead)
        for j in range(int(extra.max())):
            rows = extra > j
            number[rows] = number[rows] << 6 | bits.read(live[rows], 8) & 63
        if (number * size != sample[live]).any():
            raise ValueError("FLAC: frames out of order")
        c = np.zeros(len(live), np.int64)
        for j in range(5 + int(extra.max())):
            rows = 5 + extra > j
            c[rows] = CRC8[c[rows] ^ data[start[rows] + j]]
        if (bits.read(live, 8) != c).any():
            raise ValueError("FLAC: header checksum")
        found = _subframes(bits, live, size)
        bits.at[live] = -(-bits.at[live] // 8) * 8
        crc = crc16s(data, start, (bits.at[live] >> 3) - start)
        if (bits.read(live, 16) != crc).any():
            raise ValueError("FLAC: frame checksum")
        for s, a, row in zip(which[live].tolist(), sample[live].tolist(), found.astype(np.int8)):
            outs[s][a : a + size] = row
        sample[live] += size
    for out, md5 in zip(outs, sums):
        if (first or last is not None) and (first > 0 or last < len(out)):
            continue
        if md5 != bytes(16) and hashlib.md5(out.tobytes()).digest() != md5:
            raise ValueError("FLAC: stream checksum")
    return [x[first:last] for x in outs]


def payloads(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts, each filled up with 255 to a positive multiple of FRAME; frames; bytes unpadded."""
    texts = pc.fill_null(texts, "").cast(pa.binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    held = texts.buffers()[2]
    raw = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    frames = np.maximum(1, -(-sizes // FRAME))
    out = np.full(int(frames.sum()) * FRAME, 255, np.uint8)
    starts = (np.cumsum(frames) - frames) * FRAME
    out[np.repeat(starts - (offsets[:-1] - offsets[0]), sizes) + np.arange(len(raw))] = raw
    return out, frames, sizes


def as_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as a FLAC stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.steps(batch, "text"):
                payload, frames, sizes = payloads(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), pa.array(encode(payload, frames), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


BLOCK = pa.list_(pa.struct([("sample_offset", pa.int64()), ("pcm", pa.binary())]))
BLOCK_SQL = "array<struct<sample_offset:bigint,pcm:binary>>"


def pcm_blocks(media: DataFrame) -> DataFrame:
    """Rows with a column media, and in its place media_bytes, media_sha256 and blocks: signed 8-bit PCM with the
    offset of each block's first sample."""
    kept = [f for f in media.schema if f.name != "media"]
    names = [*(f.name for f in kept), "media_bytes", "media_sha256", "blocks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = SEEK_FRAMES * FRAME
        for batch in batches:
            for part in tokens.steps(batch, "media", DECODE_BYTES):
                streams = part.column("media").to_pylist()
                found = [[(i, x[i : i + step].tobytes()) for i in range(0, len(x), step)] for x in decode(streams)]
                blocks = pa.array([[{"sample_offset": i, "pcm": b} for i, b in x] for x in found], BLOCK)
                facts = [pa.array([len(x) for x in streams], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in streams], pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *facts, blocks], names)

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return media.mapInArrow(run, f"{schema}media_bytes long, media_sha256 string, blocks {BLOCK_SQL}")


def slices_of(docs: DataFrame) -> int:
    """How many slices a table takes, by the size that the planner knows of its files."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(MOST_SLICES, max(SLICES, -(-size // SLICE_BYTES)))


def stored_blocks(docs: DataFrame, slices: int | None = None) -> DataFrame:
    """Written pcm_blocks() of all rows, decoded from written streams. A slice's streams are dropped once its blocks are
    written, so that at any time only those of one slice take space beside the blocks; who wants to keep the streams
    writes as_media().

    Slices are ranges of doc_id between approximate quantiles, which the scan prunes by statistics where rows lie in
    that order; elsewhere the table is read once a slice. docs is evaluated once a slice and has to give the same rows
    each time, as a written table does. Rows without doc_id, and all of one doc_id, share a slice. An empty table
    gives an empty table.
    """
    spark = docs.sparkSession
    # without a file's size the planner assumes the largest there is
    slices = slices or (slices_of(docs) if docs.inputFiles() else SLICES)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    edges = sorted({int(x) for x in docs.approxQuantile("doc_id", [i / slices for i in range(1, slices)], min(0.01, 0.1 / slices))})
    within = [F.col("doc_id").isNull() | (F.col("doc_id") < edges[0]), *((F.col("doc_id") >= a) & (F.col("doc_id") < b) for a, b in pairwise(edges)), F.col("doc_id") >= edges[-1]] if edges else [F.lit(True)]
    paths = []
    for mine in within:
        with store.scratch(spark):
            blocks = pcm_blocks(store.saved(as_media(docs.where(mine)), "media", "none"))
            paths.append(store.write(blocks, "pcm", keep=True))
    return spark.read.schema(blocks.schema).parquet(*paths)


def samples_between(rows: DataFrame, first: int, last: int) -> DataFrame:
    """(doc_id, sample_offset, pcm) of the blocks of written PCM rows that hold samples first to last (not included)."""
    wanted = F.filter("blocks", lambda b: (b["sample_offset"] < last) & (b["sample_offset"] + F.octet_length(b["pcm"]) > first))
    return rows.select("doc_id", F.explode(wanted).alias("block")).select("doc_id", "block.sample_offset", "block.pcm")


def payload_of(pcm: bytes) -> bytes:
    """The bytes that samples stand for."""
    return (np.frombuffer(pcm, np.uint8) ^ 128).tobytes()


def features_of(pcm: bytes) -> str:
    """Sum of squares, peak and sign changes of the samples."""
    s = np.frombuffer(pcm, np.int8).astype(np.int64)
    return f"energy={int((s * s).sum())} peak={int(np.abs(s).max(initial=0))} crossings={int(np.count_nonzero(np.diff(s < 0)))}"


def digests(blocks: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload and media digests, feature) of rows of pcm_blocks()."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n, size, sha, held in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media_bytes", "media_sha256", "blocks"))):
                pcm = b"".join(b["pcm"] for b in held)
                payload = payload_of(pcm)
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), size, sha, features_of(pcm)))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=DIGESTS)

    return blocks.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
