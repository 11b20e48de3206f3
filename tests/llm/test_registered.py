"""The registered queries against brute force, on a small table with odd rows."""

import hashlib
import threading
import zlib

import numpy as np
import pytest

from sparkloom.llm import packing, queries, store, tokens

TEXTS = ["", None, "Hello world, hello!", "tie tie", "tie tie", "é漢字 ok", " ".join(f"w{i}" for i in range(5000)), "a b c d e f g h i j k l m n o p", "x" * 3000]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [(i * 3, t, "en" if i % 2 else None, f"s{i % 3}", 0) for i, t in enumerate(TEXTS)]
    rows += [(100 + i, " ".join(f"u{i % 7}v{k}" for k in range(20 + i)), "de", "s1", 0) for i in range(60)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path), {r[0]: r[1] or "" for r in rows}


def ids_of(text, end):
    return tokens.encoder().tokenizer.encode(text, add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op2(spark, folder):
    got = {r["doc_id"]: r for r in queries.op2_token_files(spark, folder[0]).collect()}
    at = 0
    assert len(got) == len(folder[1])
    for i in sorted(folder[1]):
        ids = ids_of(folder[1][i], 2)
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)


def test_op4(spark, folder):
    got = queries.op4_best_fit_packing(spark, folder[0]).collect()
    whole = {i: ids_of(t, 0) for i, t in folder[1].items()}
    expected = sorted((i, k, k * 2048, len(x[k * 2048 : k * 2048 + 2048]), crc(x[k * 2048 : k * 2048 + 2048])) for i, x in whole.items() for k in range(-(-len(x) // 2048)))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(map(len, whole.values())) // 2048) + 1


def test_plan_is_near_the_lower_bound():
    lengths = np.clip(np.random.default_rng(1).lognormal(6, 1, 200_000).astype(int), 1, 2048)
    counts = np.bincount(lengths, minlength=2049)
    needed = sum(times for times, _ in packing.plan(counts))
    assert needed <= -(-int(lengths.sum()) // 2048) + 2


def test_op8(spark, folder):
    got = queries.op8_kd_shards(spark, folder[0]).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in folder[1].items())
    assert {r["law"] for r in got} == {"bytes"} and all(0 <= r["shard"] < 24 and r["grown_shard"] is None for r in got)
    for s in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_op10(spark, folder):
    got = {r["doc_id"]: r for r in queries.op10_winnowing(spark, folder[0]).collect()}
    order = sorted(folder[1], reverse=True)
    kept = lambda fp: {x.split("@")[0] for x in fp.split()}
    near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, i in enumerate(order):
        text, after = folder[1][i], folder[1][order[(k + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r, following = got[i], got[order[(k + 1) % len(order)]]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(near(kept(r["fingerprint"]), kept(r["edited_fingerprint"])))
        assert r["near_next"] == pytest.approx(near(kept(r["fingerprint"]), kept(following["fingerprint"])))
    assert got[9]["fingerprint"] == got[12]["fingerprint"]


def test_scratch_tables_are_dropped(spark):
    with store.scratch(spark):
        a = store.saved(spark.range(3), "a")
        b = store.saved(a, "b", keep=True)
    assert b.count() == 3 and a.inputFiles() != b.inputFiles()
    with pytest.raises(Exception):
        a.count()


def test_scopes_of_threads_are_their_own(spark):
    held, go = {}, threading.Event()

    def other():
        go.wait(30)
        held["theirs"] = store.saved(spark.range(5), "theirs")

    thread = threading.Thread(target=other)
    thread.start()
    with store.scratch(spark):
        store.saved(spark.range(3), "mine")
        go.set()
        thread.join()
    assert held["theirs"].count() == 5
