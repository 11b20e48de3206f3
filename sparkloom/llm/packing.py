"""Best-fit packing of token pieces into sequences, by exact-complement hashing.

Pieces are known to the packer by length alone, so the plan is made on a histogram with one entry per length
(bounded by the capacity), however many pieces there are. The longest length left opens sequences; for its gap
single, pair and triple sums are found by their complements in the array of counts by length (no table of all sums is
kept), and a combination that fills it exactly is consumed as often as all its counts allow. Where none does, the longest length that fits goes in (best fit) and the smaller
gap is looked up again. Every step but the last of an opener uses up a length, so the plan has a few times as
many rows as there are lengths.

Defined results: null text is empty and has the end id alone; repeated rows are packed each; an empty table
gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store, tokens, words

CAPACITY = 2048


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, tokenizer: str | None = None, keep_ids: bool = True, narrow: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the texts' ids, cut only where longer than capacity.

    narrow: ids in two bytes each where all of a step fit; wide() undoes it."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer)
        for batch in batches:
            for part in tokens.steps(batch, "text"):
                ids, sizes = tokens.with_end(*enc.encode(part.column("text")), end_id)
                n = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                length = np.minimum(sizes[doc] - piece * capacity, capacity)
                out = [part.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(piece * capacity, pa.int64()), pa.array(length, pa.int64()), tokens.crc32s(ids, length)]
                if keep_ids:
                    out.append(_binary(ids.astype("<u2"), length) if narrow and ids.max(initial=0) < 1 << 16 else tokens.as_binary(ids, length))
                yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(words.tidied(run), schema)


def _binary(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes) * ids.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))])


def wide(ids: pa.Array, length: np.ndarray) -> pa.Array:
    """ids in four bytes each, whichever of the rows have them in two."""
    if pa.types.is_large_binary(ids.type):
        ids = ids.cast(pa.binary())
    rows = [np.frombuffer(x.as_buffer(), "<u2" if 2 * n == len(x.as_buffer()) else "<u4") for x, n in zip(ids, length.tolist())]
    return tokens.as_binary(np.concatenate(rows), length) if rows else ids


def _exact(left: np.ndarray, gap: int) -> list[int] | None:
    """Lengths that fill the gap: one, else two, else three, the longest first; left: counts by length."""
    if left[gap]:
        return [gap]

    def pair(g: int, top: int) -> list[int] | None:
        # sums a + b = g with a >= b, both there, and twice if they are the same
        a = np.arange(min(top, g - 1), (g - 1) // 2, -1)
        if not len(a):
            return None
        found = (left[a] > 0) & (left[g - a] > 0) & ((a != g - a) | (left[a] > 1))
        return [int(x := a[found.argmax()]), g - int(x)] if found.any() else None

    if found := pair(gap, gap - 1):
        return found
    for first in np.flatnonzero(left[: max(gap - 1, 0)])[::-1].tolist():
        if first * 3 < gap:
            break
        left[first] -= 1
        rest = pair(gap - first, first)
        left[first] += 1
        if rest:
            return [first, *rest]
    return None


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(times, lengths of one sequence): how pieces of these counts by length are packed."""
    left = np.zeros(capacity + 1, np.int64)
    left[: len(counts)] = counts
    out = []
    for opener in range(capacity, 0, -1):
        while left[opener]:
            # take one of each to learn the combination, then as many as there are
            taken, gap = [opener], capacity - opener
            left[opener] -= 1
            while gap:
                found = _exact(left, gap)
                if found is None:
                    fits = np.flatnonzero(left[: gap + 1])
                    found = [int(fits[-1])] if len(fits) else []
                if not found:
                    break
                for x in found:
                    left[x] -= 1
                taken += found
                gap -= sum(found)
            used = np.bincount(taken, minlength=capacity + 1)
            more = int((left[used > 0] // used[used > 0]).min())
            left -= used * more
            out.append((1 + more, taken))
    return out


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (with columns doc_id, piece, length).

    Pieces of a length are ranked over buckets of a hash, so no task holds all pieces of a common length, and
    a piece's place follows from its rank and the plan.
    """
    cells = Window.partitionBy("length", "bucket")
    n = found.count()
    bucketed = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(max(64, n // 20_000))).cast("int"))
    per_cell = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_cell.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in per_cell.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row per length
        counts[row["length"]] = row["n"]

    used = np.zeros(capacity + 1, np.int64)
    spans = []  # (key of the first rank, first sequence, offset)
    sequence = 0
    for times, lengths in plan(counts, capacity):
        at = 0
        for x in lengths:
            spans.append((x << 48 | int(used[x]), sequence, at))
            used[x] += times
            at += x
        sequence += times
    keys, first, at = (np.array(x, np.int64) for x in zip(*sorted(spans))) if spans else (np.zeros(0, np.int64),) * 3
    table = found.sparkSession.sparkContext.broadcast((keys, first, at))

    ranked = bucketed.withColumn("rank", F.row_number().over(cells.orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(offsets, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("ahead")).drop("ahead", "bucket")

    names = [*found.columns, "sequence_id", "offset"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id long, offset long"
    columns = found.columns

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, at = table.value
        for batch in (part for b in batches for part in (tokens.steps(b, "ids") if "ids" in columns else [b])):
            lengths = batch.column("length").to_numpy()
            key = lengths << 48 | batch.column("rank").to_numpy()
            k = np.searchsorted(keys, key, side="right") - 1
            kept = [wide(batch.column(c), lengths) if c == "ids" else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(first[k] + key - keys[k], pa.int64()), pa.array(at[k], pa.int64())], names)

    return ranked.mapInArrow(words.tidied(placed), schema)


def packed(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, tokenizer: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Documents to placed pieces. Without ids only their digests are carried."""
    return pack(store.saved(pieces(docs, capacity, end_id, tokenizer, keep_ids, narrow=True), "pieces"), capacity)


def digests(placed: DataFrame) -> DataFrame:
    """Placed pieces without their ids; length and ids_crc32 are worked out from the ids themselves."""
    found = {"length": F.floor(F.octet_length("ids") / 4).cast("long"), "ids_crc32": F.crc32("ids")}
    return placed.select(*[found[c].alias(c) if c in found else F.col(c) for c in placed.columns if c != "ids"])
