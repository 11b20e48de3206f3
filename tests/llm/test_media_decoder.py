"""The decoder against streams with subframes that the encoder does not choose: a bit writer by the format."""

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import media, queries, store


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> n - 1 - i & 1 for i in range(n)]

    def rice(self, v, k):
        u = 2 * v if v >= 0 else -2 * v - 1
        self.bits += [0] * (u >> k) + [1]
        self.put(u & (1 << k) - 1, k)

    def bytes(self):
        self.bits += [0] * (-len(self.bits) % 8)
        return np.packbits(np.array(self.bits, np.uint8)).tobytes()


def frame(number, samples, kind, order=0, coefs=(), shift=0, parts=0, escape=None, k=3):
    w = Writer()
    code = {"constant": 0, "verbatim": 1, "fixed": 8 + order, "lpc": 31 + order}[kind]
    w.put(code << 1, 8)
    if kind == "constant":
        w.put(int(samples[0]) & 255, 8)
    elif kind == "verbatim":
        for s in samples:
            w.put(int(s) & 255, 8)
    else:
        for s in samples[:order]:
            w.put(int(s) & 255, 8)
        if kind == "lpc":
            w.put(11, 4)
            w.put(shift, 5)
            for c in coefs:
                w.put(c & 4095, 12)
        factors = coefs if kind == "lpc" else media.FIXED[order]
        w.put(0, 2)
        w.put(parts, 4)
        span = len(samples) >> parts
        for i in range(order, len(samples)):
            if i == order or i % span == 0:
                raw = escape is not None and (i // span) % 2 == escape
                w.put(15 if raw else k, 4)
                if raw:
                    w.put(10, 5)
            r = int(samples[i]) - (sum(int(c) * int(samples[i - 1 - j]) for j, c in enumerate(factors)) >> shift)
            w.put(r & 1023, 10) if raw else w.rice(r, k)
    head = b"\xff\xf8\x20\x02" + media.coded_number(number)
    data = head + bytes([media.crc8(head)]) + w.bytes()
    crc = 0
    for b in data:
        crc = (crc << 8 & 0xFFFF) ^ int(media.CRC16[crc >> 8 ^ b])
    return data + struct.pack(">H", crc)


def stream(samples, frames):
    raw = samples.astype(np.int8).tobytes()
    info = struct.pack(">HH", 576, 576) + bytes(6) + (8000 << 44 | 7 << 36 | len(samples)).to_bytes(8, "big") + hashlib.md5(raw).digest()
    return b"fLaC" + b"\x80" + len(info).to_bytes(3, "big") + info + b"".join(frames)


def test_all_subframes():
    rng = np.random.default_rng(5)
    wave = (90 * np.sin(np.arange(576 * 12) / 9) + rng.integers(-5, 5, 576 * 12)).astype(np.int64)
    wave[576:1152] = -7
    how = [dict(kind="verbatim"), dict(kind="constant"), *[dict(kind="fixed", order=o, parts=o % 3, k=2 + o) for o in range(5)], dict(kind="lpc", order=2, coefs=(1980, -1010), shift=10, parts=2), dict(kind="lpc", order=8, coefs=(900, 300, -200, 50, -30, 20, 10, -60), shift=10, k=5), dict(kind="fixed", order=1, parts=3, escape=1), dict(kind="lpc", order=1, coefs=(950,), shift=10, escape=0), dict(kind="fixed", order=0, k=0)]
    frames = [frame(i, wave[576 * i : 576 * i + 576], **h) for i, h in enumerate(how)]
    other = rng.integers(-128, 128, 576)
    got = media.decode([stream(wave, frames), stream(other, [frame(0, other, "verbatim")]), stream(wave, frames)])
    assert got[0].tolist() == wave.tolist() == got[2].tolist() and got[1].tolist() == other.tolist()


def test_round_trips_and_seek_points():
    rng = np.random.default_rng(6)
    frames = np.array([1, 40, 3, 200])
    payload = rng.choice(np.frombuffer("eeee ttt \xff\x00é".encode(), np.uint8), frames.sum() * 576)
    payload[: 576 * 2] = rng.integers(0, 256, 1152)
    streams = media.encode(payload, frames)
    at = 0
    for s, n in zip(media.decode(streams), frames.tolist()):
        assert media.payload_of(s.tobytes()) == payload[at : at + n * 576].tobytes()
        at += n * 576


def kinds(stream):
    """The types of the frames' subframes, by the seek table and one frame per point."""
    return media._chosen((np.frombuffer(stream, np.uint8) ^ 128).view(np.int8).reshape(-1, media.FRAME).astype(np.int64))


def test_each_frame_takes_the_cheapest_predictor():
    rng = np.random.default_rng(8)
    t = np.arange(576)
    waves = [np.full(576, 7), rng.integers(-128, 128, 576), np.cumsum(rng.integers(-1, 2, 576)) % 100 - 50, (100 * np.sin(t / 7)).astype(int) + rng.integers(-2, 3, 576)]
    payload = np.concatenate([(w.astype(np.int64) & 255).astype(np.uint8) ^ 128 for w in waves])
    found = kinds(payload.tobytes()).tolist()
    assert found[:2] == [media.CONSTANT, media.VERBATIM] and found[2] in (1, media.LPC) and found[3] == media.LPC
    streams = media.encode(payload, np.array([4]))
    assert media.payload_of(media.decode(streams)[0].tobytes()) == payload.tobytes()
    whole = len(media.encode(payload[576 * 3 :], np.array([1]))[0])
    assert whole < 576 * 0.7 + 100


def test_text_is_stored_with_predictors():
    text = "The predictors of a frame of prose leave less than the letters themselves. " * 40
    payload, frames, _ = media.payloads(pa.array([text]))
    assert (np.isin(kinds(payload.tobytes()), [1, 2, 3, 4, media.LPC])).mean() > 0.5


def test_samples_are_the_payload_and_stretches_are_decoded_alone():
    rng = np.random.default_rng(9)
    payload = rng.choice(np.frombuffer(b"some words and letters", np.uint8), 576 * 50)
    (stream,) = media.encode(payload, np.array([50]))
    assert media.decode([stream])[0].astype(int).tolist() == (payload.astype(int) - 128).tolist()
    # damage at the end does not matter for samples before it: the rest is not read
    broken = stream[:-40] + bytes(40)
    with pytest.raises(ValueError):
        media.decode([broken])
    for first, last in ((0, 1), (576 * 20 + 5, 576 * 21), (4600, 9300)):
        (got,) = media.decode([broken], first, last)
        assert media.payload_of(got.tobytes()) == payload[first:last].tobytes()


def test_query_against_brute_force(spark, tmp_path):
    texts = ["", None, "Hello world", "é漢字 " * 400, "x" * 576, "y" * 577, "Some prose that repeats itself. " * 300]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op7_flac(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        (stream,) = media.encode(np.frombuffer(payload, np.uint8), np.array([len(payload) // 576]))
        s = [b - 128 for b in payload]
        feature = f"energy={sum(x * x for x in s)} peak={max(map(abs, s))} crossings={sum((a < 0) != (b < 0) for a, b in zip(s, s[1:]))}"
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"], r["feature"]) == (zlib.crc32(payload[-32:]), len(stream), hashlib.sha256(stream).hexdigest(), feature)


def test_written_blocks_are_read_from_an_offset(spark):
    text = "abcdefghij" * 3000
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    pcm = store.saved(media.pcm_blocks(media.as_media(docs)), "pcm")
    found = media.samples_between(pcm, 20000, 20010).collect()
    (one,) = [r for r in found if r["doc_id"] == 1]
    assert {r["doc_id"] for r in found} == {1} and one["sample_offset"] % media.FRAME == 0
    at = 20000 - one["sample_offset"]
    assert media.payload_of(bytes(one["pcm"]))[at : at + 10].decode() == text[20000:20010]


@pytest.mark.parametrize("ids", [range(40), [None] * 40, [7] * 40, [i % 3 or None for i in range(40)], [-(2**62), 2**62] * 20, []], ids=["all", "none", "one", "some", "far", "empty"])
def test_slices_hold_every_row_once(spark, monkeypatch, ids):
    texts = [None if i % 7 == 0 else f"text {i % 5} " * (i * 40) for i in range(len(ids))]
    docs = spark.createDataFrame(list(zip(ids, texts, texts)), "doc_id long, text string, media string")
    kept, dropped = [], []
    monkeypatch.setattr(store, "write", lambda df, name, *a, write=store.write, **k: (kept.append((name, write(df, name, *a, **k))), kept[-1][1])[1])
    monkeypatch.setattr(store, "drop", lambda spark, path, drop=store.drop: (dropped.append(path), drop(spark, path)))
    got = media.digests(media.stored_blocks(docs))
    order = lambda df: sorted(map(str, df.collect()))
    assert order(got) == order(media.digests(media.pcm_blocks(media.as_media(docs)))) and got.count() == len(ids)
    assert dropped == [path for name, path in kept if name == "media"] and len(dropped) <= media.SLICES
    if ids == range(40):
        assert len(dropped) == media.SLICES


def test_slices_grow_with_the_table(spark, tmp_path, monkeypatch):
    spark.range(5000).selectExpr("id AS doc_id", "repeat(string(id), 50) AS text").repartition(2).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    assert media.slices_of(docs) == media.SLICES
    monkeypatch.setattr(media, "SLICE_BYTES", 10_000)
    assert media.slices_of(docs) > media.SLICES


@pytest.mark.parametrize("at", [60, 100, -1])
def test_damage_is_found(at):
    payload = np.random.default_rng(7).choice(np.frombuffer(b"some text of letters", np.uint8), 576 * 3)
    (data,) = media.encode(payload, np.array([3]))
    broken = bytearray(data)
    broken[at] ^= 1
    with pytest.raises(ValueError):
        media.decode([bytes(broken)])


def test_numbers():
    for n in (0, 127, 128, 2047, 2048, 65535, 65536, (1 << 31) - 1):
        b = media.coded_number(n)
        if n < 1 << 16 and not 0xD800 <= n < 0xE000:
            assert b == chr(n).encode()
        assert len(b) <= 6
