"""Packing ends with the ids: in what the query writes and reads back, and in the pipeline's last stage."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import packing, queries, store, tokens


def documents(spark):
    rows = [(1, "Hello world, hello!"), (2, " ".join(f"w{i}" for i in range(3000))), (3, None), (None, "no id")]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_digests_are_of_the_ids_that_are_held(spark):
    found = packing.packed(documents(spark))
    spoilt = packing.digests(store.saved(found.withColumn("ids", F.unhex(F.lit("0500000006000000"))), "spoilt")).collect()
    assert {(r["length"], r["ids_crc32"]) for r in spoilt} == {(2, zlib.crc32(np.array([5, 6], "<u4").tobytes()))}


def test_query_writes_placed_ids(spark, tmp_path, monkeypatch):
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    written, save = {}, store.saved
    monkeypatch.setattr(store, "saved", lambda df, name, *how, **keep: written.setdefault(name, save(df, name, *how, **keep)))
    got = queries.op4_best_fit_packing(spark, str(tmp_path))
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert sorted(map(str, got.collect())) == sorted(map(str, written["packed"].drop("ids").collect()))
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in written["packed"].collect())


def test_pipeline_ends_with_ids(spark):
    found = corpus_pipeline.into_sequences(spark, documents(spark), "").orderBy("piece").collect()
    enc = tokens.encoder().tokenizer
    for r in documents(spark).collect():
        ids = b"".join(bytes(x["ids"]) for x in found if x["doc_id"] == r["doc_id"])
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode(r["text"] or "", add_special_tokens=False).ids + [0]


def test_ids_of_either_width_come_back_wide():
    rows = [np.array(x, t) for x, t in (([1, 2], "<u2"), ([70000], "<u4"), ([5], "<u2"))]
    held = packing.wide(pa.array([x.tobytes() for x in rows], pa.binary()), np.array([2, 1, 1]))
    assert [np.frombuffer(x, "<u4").tolist() for x in held.to_pylist()] == [[1, 2], [70000], [5]]
