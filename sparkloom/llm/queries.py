"""The registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graphs, impacts, jaccard, language, licenses, media, mixing, oracles, packing, phrases, shards, store, token_files, tokens, warc, winnowing


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of source/thousand/hundred directories."""
    step = lambda n: F.coalesce(F.floor(F.col("doc_id") / n).cast("string"), F.lit("none"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), step(1000), step(100), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
    files = store.table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    found = licenses.inherited(licenses.scanned(files))
    return found.select("row.doc_id", *[c for c in found.columns if c != "row"]).withColumn("own_score", F.round("own_score", 6))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.new_path(spark, "token-files")
    token_files.write_files(store.table(spark, sf_dir, "documents"), path, end_id=2)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = tokens.from_binary(batch.column("ids"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(sizes), tokens.crc32s(ids, sizes)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return token_files.read_files(spark, path).mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(store.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with store.scratch(spark):
        placed = store.saved(packing.packed(store.table(spark, sf_dir, "documents")), "packed", keep=True)
    return packing.digests(placed)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(store.table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = store.new_path(spark, "warc")
    index = warc.write_archives(warc.with_revisits(store.table(spark, sf_dir, "pages")), directory)
    found = warc.read_records(index, directory)
    return found.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op7_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.stored_blocks(store.table(spark, sf_dir, "documents")))


def op8_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    # where one document is much of a shard the nearest cut counts more than the widest dimension
    found = shards.sharded(store.table(spark, sf_dir, "documents"), 24, tolerance=0.002)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(language.learning_rows(docs))
    found = language.identified(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(F.crc32(F.col("row.doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return found.select("row.doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprinted(store.table(spark, sf_dir, "documents"))


def op11_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = store.table(spark, sf_dir, "embeddings")
    return graphs.nearest(graphs.write_index(vectors), vectors.where("vec_id % 20 = 0"), 20)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(store.table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impacts.ranked(store.table(spark, sf_dir, "documents"), store.table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_token_files, op3_mix_sources, op4_best_fit_packing, op5_jaccard_join, op6_warc, op7_flac, op8_kd_shards, op9_language_id, op10_winnowing, op11_nearest_vectors, op12_collocations, op13_ranked_search)}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": oracles.op1(), "op3_mix_sources": oracles.OP3, "op5_jaccard_join": oracles.OP5, "op6_warc": oracles.OP6, "op12_collocations": oracles.OP12, "op13_ranked_search": oracles.OP13}
