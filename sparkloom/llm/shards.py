"""Sharding by a k-d tree: nodes are split at weighted medians along their widest metadata dimension.

Coordinates are scaled to the whole table's range; a node that is to become m shards is cut so that the lower
side gets floor(m / 2) / m of its bytes. The cut is found on a 63-bit key (25 bits of the coordinate, 24 bits of a
hash of the row, 14 bits of its place in the table, so that any number of equal coordinates and of equal rows can
be cut) by refining a histogram of 1024 bins, in which each node's bin is found by its task: a round sends one row per
node to the driver. Cuts are a small table (a row per node), and rows go down the tree by one broadcast join per level.
Rows move once, into their shards' files; slots follow from what was written.

Defined results: null text has 8 bytes (an empty document's share), null coordinates count as the least,
repeated rows are cut like others, an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store

BINS = 1024
#: A cut is good when the bin that it falls into holds no more than this share of the node.
SLACK = 0.0005
COORDINATE_BITS, HASH_BITS, PLACE_BITS = 25, 24, 14
#: Bytes of documents that a file of a shard holds about, and the least number of files of one.
FILE_BYTES, FILES = 128 << 20, 4
DIMENSIONS = ["d0", "d1", "d2", "d3"]


def _name(c: Column) -> Column:
    """A string as a number in [0, 1]."""
    return F.crc32(F.coalesce(c, F.lit(""))) / F.lit(float(0xFFFFFFFF))


def document_rows(docs: DataFrame) -> DataFrame:
    """(row, place, doc_id, size, text_crc32, d0 ...): what the tree needs to know of documents; row has their
    columns, place tells equal rows apart."""
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("long") + 8
    dims = [F.log2(size), F.col("doc_id").cast("double"), _name(F.col("source")), _name(F.col("lang"))]
    facts = [F.monotonically_increasing_id().alias("place"), "doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")]
    return docs.select(F.struct("*").alias("row"), *facts, *[d.alias(n) for d, n in zip(dims, DIMENSIONS)])


def spans(rows: DataFrame, dims: list[str] = DIMENSIONS) -> dict[str, tuple]:
    """The least and the largest coordinate by dimension."""
    ends = rows.agg(*[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return {d: (ends[f"lo_{d}"], ends[f"hi_{d}"]) for d in dims}


def keyed(rows: DataFrame, ends: dict[str, tuple]) -> DataFrame:
    """rows with a 63-bit key in place of each dimension: the coordinate over the table's range, a row hash, a place."""
    mod = lambda c, bits: F.pmod(c, F.lit(1 << bits))
    tie = mod(F.xxhash64("doc_id", "size", "text_crc32"), HASH_BITS) * (1 << PLACE_BITS) + mod(F.xxhash64("place"), PLACE_BITS)

    def key(d: str) -> Column:
        lo, hi = ends[d]
        share = F.coalesce((F.col(d) - lo) / (hi - lo), F.lit(0.0)) if lo is not None and hi > lo else F.lit(0.0)
        return F.floor(share * float((1 << COORDINATE_BITS) - 1)).cast("long") * (1 << HASH_BITS + PLACE_BITS) + tie

    return rows.withColumns({d: key(d) for d in ends})


def _refined(inner: DataFrame, dims: list[str], cuts: dict[int, dict]) -> dict[int, dict]:
    """cuts (by node: dim, lo, hi, want, below, size) with the key to cut at, and how far off that is. inner has
    the rows of the nodes, with a column shard."""
    open_ = dict(cuts)
    while open_:
        for c in open_.values():
            c["width"] = (c["hi"] - c["lo"]) // BINS + 1
        rows = [(a, c["dim"], c["lo"], c["hi"], c["width"], float(c["want"] - c["below"])) for a, c in open_.items()]
        at = inner.sparkSession.createDataFrame(rows, "node int, dim int, lo long, hi long, width long, want double")
        # a row per node
        near = inner.join(F.broadcast(at), inner["shard"] == at["node"]).withColumn("k", F.element_at(F.array(*dims), F.col("dim"))).where("k between lo and hi")
        bins = near.groupBy("node", "want", F.expr("(k - lo) div width").alias("bin")).agg(F.sum("size").alias("size"))
        listed = bins.groupBy("node", "want").agg(F.array_sort(F.collect_list(F.struct("bin", "size"))).alias("bins"))
        # the bin in which the sum reaches what is wanted, and what lies before it
        state = lambda before, bin_, size, done: F.struct(before.alias("before"), bin_.alias("bin"), size.alias("size"), done.alias("done"))
        step = lambda s, x: F.when(s["done"], s).otherwise(state(s["before"] + s["size"], x["bin"], x["size"], s["before"] + s["size"] + x["size"] >= F.col("want")))
        start = state(*[F.lit(0).cast("long")] * 3, F.lit(False))
        found = {r["node"]: r["at"] for r in listed.select("node", F.aggregate("bins", start, step).alias("at")).collect()}
        for a, c in list(open_.items()):
            before, b, size = found[a][:3] if a in found else (0, 0, 0)
            c["below"] += before
            c["lo"] += b * c["width"]
            c["hi"] = min(c["hi"], c["lo"] + c["width"] - 1)
            if size <= SLACK * c["size"] or c["width"] == 1:
                # cut before or after the bin, whichever is nearer
                after = c["below"] + size - c["want"] < c["want"] - c["below"]
                c["cut"] = c["hi"] + 1 if after else c["lo"]
                c["off"] = abs(c["below"] + size * after - c["want"]) / c["size"]
                del open_[a]
    return cuts


def tree(rows: DataFrame, leaves: int, dims: list[str] = DIMENSIONS, tolerance: float | None = None) -> list[dict[int, tuple]]:
    """By level, {node: (dimension, key to cut at, right node)} for rows (size and dims, which hold keys). A node is known by
    its first leaf at each level: what lies below the key keeps the number, the rest goes to the right node.

    tolerance: where a document too large to share lies on the cut, so that it is off by more than this share of the
    node, the other dimensions are tried too, and the nearest cut is taken. None: always the widest dimension.
    Each level of rows is written, so its plan stays small.
    """
    rows = rows.withColumn("shard", F.lit(0))
    made: list[dict[int, tuple]] = []
    nodes = {0: leaves}
    while any(m > 1 for m in nodes.values()):
        split = {a: m for a, m in nodes.items() if m > 1}
        node = F.col("shard")
        inner = rows.where(node.isin(list(split)))
        found = inner.groupBy("shard").agg(F.sum("size").alias("size"), *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).collect()
        cuts: dict[int, dict] = {}
        for attempt in range(len(dims) if tolerance is not None else 1):
            open_ = {}
            for r in found:
                a = r["shard"]
                if a not in cuts or cuts[a]["off"] > tolerance:
                    # extents count by the coordinate alone
                    width = lambda d: (r[f"lo_{d}"] >> HASH_BITS + PLACE_BITS) - (r[f"hi_{d}"] >> HASH_BITS + PLACE_BITS)
                    d = sorted(dims, key=lambda d: (width(d), dims.index(d)))[attempt]
                    share = (split[a] // 2) / split[a]
                    open_[a] = {"dim": dims.index(d) + 1, "lo": r[f"lo_{d}"], "hi": r[f"hi_{d}"], "want": r["size"] * share, "below": 0, "size": r["size"]}
            for a, c in _refined(inner, dims, open_).items():
                if a not in cuts or c["off"] < cuts[a]["off"]:
                    cuts[a] = c
        made.append({a: (dims[c["dim"] - 1], c["cut"], a + split[a] // 2) for a, c in cuts.items()})
        if not cuts:
            break
        rows = store.saved(moved(rows, made[-1], dims), "shard-level")
        nodes = {a: m for a, m in nodes.items() if m == 1} | {b: n for a, m in split.items() for b, n in ((a, m // 2), (a + m // 2, m - m // 2))}
    return made


def moved(rows: DataFrame, cuts: dict[int, tuple], dims: list[str] = DIMENSIONS) -> DataFrame:
    """rows (with shard: the node of a level) with that of the next level."""
    held = [(a, dims.index(d) + 1, cut, right) for a, (d, cut, right) in cuts.items()]
    # a row per node of the level
    at = F.broadcast(rows.sparkSession.createDataFrame(held, "_node int, _dim int, _cut long, _right int"))
    beyond = F.element_at(F.array(*dims), F.col("_dim")) >= F.col("_cut")
    return rows.join(at, rows["shard"] == at["_node"], "left").withColumn("shard", F.when(beyond, F.col("_right")).otherwise(F.col("shard"))).drop("_node", "_dim", "_cut", "_right")


def into_shards(rows: DataFrame, levels: list[dict[int, tuple]]) -> DataFrame:
    """rows of keyed() with the shard that the levels of tree() give them."""
    rows = rows.withColumn("shard", F.lit(0))
    for cuts in levels:
        if cuts:
            rows = moved(rows, cuts)
    return rows


def write_shards(docs: DataFrame, leaves: int = 24, tolerance: float | None = None) -> str:
    """Writes the documents into shards, a folder of some files for each, and returns the path."""
    facts = document_rows(docs)
    with store.scratch(docs.sparkSession):
        slim = store.saved(facts.drop("row"), "shard-rows")
        ends = spans(slim)
        keys = store.saved(keyed(slim, ends).select("size", *ends), "shard-keys")
        levels = tree(keys, leaves, tolerance=tolerance)
        total = keys.agg(F.sum("size")).first()[0] or 0
    files = max(FILES, total // leaves // FILE_BYTES)
    # a task for each file, so that the hottest shard is as many tasks as it has files
    at = F.col("shard") * files + F.pmod(F.xxhash64("place"), F.lit(files)).cast("int")
    held = into_shards(keyed(facts, ends).select("row", "place", *ends), levels).select("row", "shard", at.cast("int").alias("file"))
    path = store.new_path(docs.sparkSession, "shards")
    held.repartitionById(leaves * files, F.col("file")).drop("file").write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return path


def read_shards(spark: SparkSession, path: str, columns: DataFrame) -> DataFrame:
    """(row, shard, slot): slots count gapless from 0 within each shard, through its files in order of name.
    columns: a table with the documents' columns."""
    kept = columns.select(F.struct("*").alias("row")).schema
    table = spark.read.schema(f"row {kept['row'].dataType.simpleString()}, shard int").parquet(path)
    table = table.select("row", "shard", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    before = Window.partitionBy("shard").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    ahead = table.groupBy("shard", "file").agg(F.count("*").alias("n")).select("shard", "file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    # a row per file, saved, so that the planner knows its size and texts aren't shuffled for it
    ahead = store.saved(ahead, "shard-files", keep=True)
    return table.join(ahead, ["shard", "file"]).select("row", "shard", (F.col("at") + F.col("ahead")).cast("long").alias("slot"))


def sharded(docs: DataFrame, leaves: int = 24, tolerance: float | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every document, read back from the shards, whose bytes are near equal."""
    held = read_shards(docs.sparkSession, write_shards(docs, leaves, tolerance), docs)
    text = F.coalesce("row.text", F.lit(""))
    size = F.octet_length(text).cast("long") + 8
    return held.select("row.doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "shard", "slot")
