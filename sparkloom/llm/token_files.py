"""Token-ID output: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A file set is a Parquet table of blocks. A block holds the documents of a run of doc_ids: one control stream
(two bits per id, four ids per byte: bytes of the id less one) and one data stream (1 to 4 little-endian bytes
per id). What is coded is an id's rank by corpus frequency, so common ids take one byte. Blocks are written by
Spark's committer, so a lost executor leaves no half file, and any store that Spark writes to will do.

Defined results: null text counts as empty and has the end id alone; rows with equal doc_id are kept apart and
ordered by their coded bytes; null doc_ids come first, spread over parts by a checksum of their ids; an empty table
gives an empty file set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store, tokens, words

#: Ids that a block holds at most, unless one document has more.
BLOCK_IDS = 1 << 18
#: Table for each control byte: the number of data bytes of its four ids.
SIZES = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.int64)


def encode_streams(values: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control and data bytes of runs of unsigned 32-bit values; each run starts a control byte of its own."""
    values = values.astype("<u4")
    lengths = 1 + (values > 0xFF).astype(np.int64) + (values > 0xFFFF) + (values > 0xFFFFFF)
    controls = -(-sizes // 4)
    ends, control_ends = np.cumsum(sizes), np.cumsum(controls)
    codes = np.zeros(int(controls.sum()) * 4, np.uint8)
    codes[np.arange(len(values)) + np.repeat((control_ends - controls) * 4 - (ends - sizes), sizes)] = lengths - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8).tobytes()
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]].tobytes()
    cuts = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], ends])]
    return (
        [control[e - n : e] for e, n in zip(control_ends.tolist(), controls.tolist())],
        [data[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())],
    )


def decode_streams(control: bytes, data: bytes, sizes: np.ndarray) -> np.ndarray:
    """The values of joined runs: sizes by table lookup of the control bytes, places by their running sum."""
    controls = -(-sizes // 4)
    slots = int(controls.sum()) * 4
    # the last control byte of a run may have slots to spare; they have no data
    used = np.arange(slots) - np.repeat((np.cumsum(controls) - controls) * 4, controls * 4) < np.repeat(sizes, controls * 4)
    lengths = SIZES[np.frombuffer(control, np.uint8)].ravel()[used]
    starts = np.cumsum(lengths) - lengths
    padded = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    out = padded[starts].astype(np.uint32)
    for k in range(1, int(lengths.max(initial=1))):
        out |= np.where(lengths > k, padded[starts + k], 0).astype(np.uint32) << np.uint32(8 * k)
    return out


def tokenised(docs: DataFrame, end_id: int | None = 2, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, ids): the little-endian 32-bit token ids of every whole text, the end id appended if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer)
        for batch in batches:
            for part in tokens.steps(batch, "text"):
                ids, sizes = enc.encode(part.column("text"))
                ids, sizes = tokens.with_end(ids, sizes, end_id)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), tokens.as_binary(ids, sizes)], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(words.tidied(run), "doc_id long, ids binary")


def frequency_ranks(ids: DataFrame) -> np.ndarray:
    """rank[id] by descending count in the whole corpus, ties by id. One entry per id of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for part in tokens.steps(batch, "ids"):
                found = np.bincount(tokens.from_binary(part.column("ids"))[0])
                if len(found) > len(total):
                    found, total = total, found
                total[: len(found)] += found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    found = ids.select("ids").mapInArrow(words.tidied(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    size = int(found.id.max()) + 1 if len(found) else 0
    counts = np.zeros(size, np.int64)
    counts[found.id.to_numpy(np.int64)] = found.n.to_numpy(np.int64)
    rank = np.empty(size, np.uint32)
    rank[np.lexsort((np.arange(size), -counts))] = np.arange(size, dtype=np.uint32)
    return rank


def range_bounds(df: DataFrame, key: str, n: int) -> np.ndarray:
    """At most n - 1 bounds that cut the keys into ranges of about as many rows, from a sketch of the key column."""
    shares = [i / n for i in range(1, n)]
    found = df.agg(F.percentile_approx(key, shares, max(10_000, 20 * n)).alias("b")).first()["b"] if shares else None
    return np.unique(np.array(found or [], np.int64))


def write_files(docs: DataFrame, path: str, end_id: int = 2, tokenizer: str | None = None, parts: int | None = None) -> np.ndarray:
    """Encodes documents into a file set at path; returns the frequency-ordered vocabulary that readers need.

    The vocabulary (ids in rank order) is bounded by the tokenizer's. It is also written beside the blocks.
    """
    spark = docs.sparkSession
    raw = store.write(tokenised(docs, end_id, tokenizer), "ids")
    ids = spark.read.schema("doc_id long, ids binary").parquet(raw)
    rank = frequency_ranks(ids)
    ranks = spark.sparkContext.broadcast(rank)
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, named = ids.agg(F.count("*"), F.count("doc_id")).first()
    # parts of rows without doc_id, before those of the others
    nameless = -(-n * (rows - named) // max(1, rows))
    bounds = range_bounds(ids, "doc_id", n)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.steps(batch, "ids"):
                flat, sizes = tokens.from_binary(part.column("ids"))
                controls, datas = encode_streams(ranks.value[flat], sizes)
                keys = part.column("doc_id")
                spread = tokens.crc32s(flat, sizes).to_numpy() * nameless >> 32 if nameless else 0
                at = np.where(pc.is_null(keys).to_numpy(zero_copy_only=False), spread, nameless + np.searchsorted(bounds, pc.fill_null(keys, 0).to_numpy()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(at, pa.int32()), pa.array(sizes, pa.int64()), pa.array(controls, pa.binary()), pa.array(datas, pa.binary())], ["doc_id", "part", "n", "control", "data"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held, part, block, start = [], 0, 0, 0, 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            join = lambda name: b"".join(t.column(name).to_pylist())
            sizes = t.column("n").to_numpy()
            index = pa.array([t.column("doc_id").to_pylist()], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([int(sizes.sum())], pa.int64()), index, pa.array([sizes.tolist()], pa.list_(pa.int64())), pa.array([join("control")], pa.binary()), pa.array([join("data")], pa.binary())], BLOCK)

        for batch in batches:
            sizes = batch.column("n").to_numpy()
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), BLOCK_IDS - n_held, side="right")) + at)
                part = batch.column("part")[at].as_py()
                held.append(batch.slice(at, stop - at))
                n_held += int(sizes[at:stop].sum())
                at = stop
                if n_held >= BLOCK_IDS or at < batch.num_rows:
                    yield flush()
                    start, block, held, n_held = start + n_held, block + 1, [], 0
        if held:
            yield flush()

    # coded before it is dealt: what crosses the network is the compact form
    coded = ids.mapInArrow(words.tidied(encode), "doc_id long, part int, n long, control binary, data binary")
    dealt = coded.repartitionById(n + nameless, F.col("part")).sortWithinPartitions("doc_id", "n", "control", "data")
    dealt.mapInArrow(words.tidied(blocks), BLOCK_SCHEMA).write.option("compression", "none").parquet(path)
    vocabulary = np.argsort(rank).astype(np.uint32)
    spark.createDataFrame([(vocabulary.astype("<u4").tobytes(),)], "ids binary").coalesce(1).write.parquet(f"{path}-vocabulary")
    store.drop(spark, raw)
    return vocabulary


BLOCK = ["part", "block", "start", "n_ids", "doc_ids", "sizes", "control", "data"]
BLOCK_SCHEMA = "part int, block int, start long, n_ids long, doc_ids array<long>, sizes array<long>, control binary, data binary"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of a file set; start: ids of all documents before it in ascending doc_id order."""
    held = spark.read.parquet(f"{path}-vocabulary").first()["ids"]
    vocabulary = spark.sparkContext.broadcast(np.frombuffer(bytes(held), "<u4"))
    table = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    # one row per part, so this window is as small as the number of partitions
    totals = table.groupBy("part").agg(F.sum("n_ids").alias("ids_in_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("ids_in_part").over(before), F.lit(0)).alias("ids_before"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.asarray(row["sizes"], np.int64)
                out = decode_streams(row["control"], row["data"], sizes)
                ends = np.cumsum(sizes)
                first = row["ids_before"] + row["start"]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(first + ends - sizes, pa.int64()), tokens.as_binary(vocabulary.value[out], sizes)], ["doc_id", "start", "ids"])

    return table.join(offsets, "part").mapInArrow(words.tidied(decode), "doc_id long, start long, ids binary")
