"""A stored search index over nodes: an inverted index with block bounds, a vector index of cells, kept up by segments.

Nodes (node_id, a key such as their file's name, text, perhaps an embedding) come with a state (key, hash). A sync
compares the state with the index's own and writes one segment with the nodes of new and changed keys only, and
tombstones for the nodes that they and the removed keys had. The manifest that makes both count is written last (see
sources.versions). When tombstones or segments are many, they are compacted into one segment.

Postings: (token, block) rows; a block is BLOCK nodes of a segment at most, and has those with the token, how often
and how long they are, and the best score that any of them has for it. A task makes the rows of its own blocks whole, so
that tokens are shuffled once, as finished rows on their way to their folders. They lie in folders by a hash of the token, as many as the
segment's size asks for, sorted, so a question's plan reads its tokens' folders and row groups. Search adds up the blocks' bounds, scores the
most promising blocks, and then only those whose bound reaches the k-th best score found.

Vectors: unit vectors lie in folders by their nearest centre (cell), some cells in a folder where a segment is small; cells have radii. By the triangle inequality no
vector of a cell is nearer to the question than the centre's distance less the radius, so cells beyond the k-th
distance found are skipped at the scan. Both searches are exact. Centres are fitted on at most SAMPLE vectors, those with
the least hashes; there are at most CELLS of them, which a search collects.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import tokens
from sparkloom.functions.vectors import cosine
from sparkloom.operators import feedback
from sparkloom.operators.retrieval import embedded, term_score
from sparkloom.shipping import ship
from sparkloom.sources import versions

BLOCK = 1024
CELLS, SAMPLE, ROUNDS = 1024, 20_000, 6
#: Nodes of a segment for each folder of its postings, rows for each folder of its vectors, and folders at most.
BUCKET_NODES, PART_ROWS, FOLDERS = 20_000, 20_000, 1024
#: Blocks, or rows of cells, that the first look takes for each wanted hit.
FIRST_BLOCKS, FIRST_ROWS = 4, 256
#: Changed keys that a sync broadcasts at most; more meet the nodes by the planner's choice.
KEYS = 1 << 18
#: Share of dead nodes and number of segments from which a sync compacts.
DEAD, SEGMENTS = 0.25, 8
#: Slack of bounds that are worked out in doubles.
EPS = 1e-9


def unit(v: Column) -> Column:
    """The vector over its norm; null for a zero vector."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


class Index:
    """The index at a path of a shared folder. key: the column by which nodes come and go."""

    def __init__(self, spark: SparkSession, path: str, key: str = "file_name"):
        self.spark, self.path, self.key = spark, path, key
        self.refresh()

    def refresh(self) -> "Index":
        """Takes up the last version; a search sees the version that was current when it was made."""
        self.version, self.content = versions.current(self.spark, self.path)
        self._cells: dict | None = None
        return self

    # --- what is there ---

    @property
    def segments(self) -> list[int]:
        return self.content.get("segments", [])

    def _table(self, name: str, schema: str | None = None, segments: list[int] | None = None) -> DataFrame:
        kind = schema or self.content["schemas"][name]
        return versions.parts(self.spark, f"{self.path}/{name}", kind, segment=self.segments if segments is None else segments)

    def _tombs(self) -> DataFrame:
        """(node_id, segment) of nodes that no longer count."""
        held = self._table("tombs", segments=self.content["tombs"])
        return held.select("node_id", F.col("of").alias("segment"))

    def _live(self, rows: DataFrame) -> DataFrame:
        return rows if not self.content["tombs"] else rows.join(self._tombs(), ["segment", "node_id"], "left_anti")

    def nodes(self) -> DataFrame:
        """The nodes as they were given."""
        return self._live(self._table("nodes")).drop("segment", "place")

    def state(self) -> DataFrame:
        """(key, hash) of what is indexed."""
        if not self.segments:
            return self.spark.createDataFrame([], f"`{self.key}` string, hash string")
        kind = self.content["schemas"]["key"]
        held = self._table("state", f"{kind}, hash string, segment long")
        last = held.groupBy(self.key).agg(F.max(F.struct("segment", "hash")).alias("last"))
        if self.content["tombs"]:
            gone = self._table("gone", f"{kind}, segment long", self.content["tombs"]).groupBy(self.key).agg(F.max("segment").alias("gone"))
            last = last.join(gone, self.key, "left").where("gone is null or gone <= last.segment")
        return last.select(self.key, "last.hash")

    # --- keeping it up ---

    def sync(self, nodes: DataFrame, state: DataFrame, embed: Callable[[str], list[float]] | None = None, vectors: DataFrame | None = None, same_keys: bool = False) -> dict[str, int] | None:
        """Brings the index to nodes and state; says how many keys were added, changed and removed, None if none was.

        nodes need to hold the nodes of added and changed keys only; others are passed over. Roots (level 0; all
        nodes, if there are no levels) get an embedding if embed is given, and go to the vector table if they have one.
        vectors: (node_id, embedding), where they lie in a table of their own; those of nodes that come are taken.
        same_keys: nodes are of state's keys alone, so that a first sync, which takes them all, needn't look them up.
        """
        version, number = self._next()
        if self.segments:
            diff = feedback.changes(self.state(), state, self.key)
        else:
            diff = state.select(self.key, F.lit("added").alias("change"))
        diff.write.mode("overwrite").parquet(f"{self.path}/diff/segment={number}")
        diff = self.spark.read.schema(diff.schema).parquet(f"{self.path}/diff/segment={number}")
        told = {r["change"]: r["count"] for r in diff.groupBy("change").count().collect()}
        if not told:
            return None
        fresh = lambda rows: rows
        if self.segments or not same_keys:
            come = diff.where("change <> 'removed'").select(self.key)
            if sum(n for change, n in told.items() if change != "removed") <= KEYS:
                # the nodes with their texts stay where they are
                come = F.broadcast(come)
            fresh = lambda rows: rows.join(come, self.key, "left_semi")
        content = self._segment(number, fresh(nodes), fresh(state), embed, given=vectors)
        if self.segments:
            left = diff.where("change <> 'added'").select(self.key)
            left.write.mode("overwrite").parquet(f"{self.path}/gone/segment={number}")
            dead = self._live(self._table("nodes")).join(left, self.key, "left_semi")
            dead.select("node_id", F.col("segment").alias("of")).write.mode("overwrite").parquet(f"{self.path}/tombs/segment={number}")
            content["tombs"] = [*self.content["tombs"], number]
        self._commit(version, content)
        if len(self.segments) > SEGMENTS or self._dead_share() > DEAD:
            self.compact()
        return told

    def _dead_share(self) -> float:
        if not self.content["tombs"]:
            return 0.0
        return self._tombs().count() / max(1, sum(self.content["rows"].values()))

    def _next(self) -> tuple[int, int]:
        """The next version, and a segment's number that rises with it and that no other writer has."""
        version = max(self.version + 1, versions.following(self.spark, self.path))
        return version, version * 1_000_000 + random.SystemRandom().randrange(1_000_000)

    def _commit(self, version: int, content: dict) -> None:
        if versions.current(self.spark, self.path)[0] != self.version:
            raise versions.Conflict(f"version {self.version} of {self.path} isn't the last any more")
        versions.commit(self.spark, self.path, version, content)
        self.refresh()

    def compact(self) -> None:
        """Live nodes, postings and vectors become one segment, with centres of its own; nothing is embedded again."""
        version, number = self._next()
        nodes, state, vectors = self.nodes(), self.state(), self._live(self._table("vectors")).select("node_id", "embedding")
        content = self._segment(number, nodes, state, None, vectors)
        content |= {"segments": [number], "tombs": []} | {x: {k: v for k, v in content[x].items() if k == str(number)} for x in ("rows", "buckets", "widths", "centres")}
        self._commit(version, content)

    def _segment(self, number: int, nodes: DataFrame, state: DataFrame, embed, vectors: DataFrame | None = None, given: DataFrame | None = None) -> dict:
        """Writes a segment's tables and returns the manifest that has it besides the others. given: vectors of these
        nodes and perhaps others."""
        at = lambda name: f"{self.path}/{name}/segment={number}"
        plain = [c for c in nodes.columns if c != "embedding"]
        nodes.select(*plain).write.mode("overwrite").parquet(at("nodes"))
        state.select(self.key, "hash").write.mode("overwrite").parquet(at("state"))
        held = self.spark.read.parquet(at("nodes"))
        rows = held.count()
        buckets = min(FOLDERS, max(1, rows // BUCKET_NODES))
        self._postings(held, number, buckets)
        if given is not None:
            # ids go to the vectors, not texts; written, as they are read several times
            roots = held.where("level = 0") if "level" in held.columns else held
            given.select("node_id", "embedding").join(roots.select("node_id"), "node_id").write.mode("overwrite").parquet(at("given"))
            vectors = self.spark.read.parquet(at("given"))
        if vectors is None:
            vectors = nodes.where("level = 0") if "level" in nodes.columns else nodes
            if "embedding" not in vectors.columns and embed is not None:
                vectors = embedded(vectors, "text", embed)
        own, width = None, 1
        if "embedding" in vectors.columns:
            vectors = vectors.where("embedding is not null").select("node_id", "embedding")
            own, width = self._vectors(vectors, number)
        schemas = dict(self.content.get("schemas", {}))
        node_type = held.schema["node_id"].dataType.simpleString()
        schemas["nodes"] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema) + ", segment long"
        schemas["key"] = f"`{self.key}` {state.schema[self.key].dataType.simpleString()}"
        schemas["tombs"] = f"node_id {node_type}, of long, segment long"
        schemas["postings"] = f"token string, block long, best double, docs array<struct<node_id:{node_type},n:int,length:int>>, segment long, bucket int"
        if own is not None:
            schemas["vectors"] = f"node_id {node_type}, embedding {vectors.schema['embedding'].dataType.simpleString()}, reach double, cell int, segment long, part int"
        elif "vectors" not in schemas:
            schemas["vectors"] = f"node_id {node_type}, embedding array<double>, reach double, cell int, segment long, part int"
        return {
            "segments": [*self.segments, number], "tombs": self.content.get("tombs", []), "schemas": schemas,
            "rows": {**self.content.get("rows", {}), str(number): rows}, "buckets": {**self.content.get("buckets", {}), str(number): buckets}, "widths": {**self.content.get("widths", {}), str(number): width}, "centres": {**self.content.get("centres", {}), **({str(number): own} if own is not None else {})},
        }

    def _postings(self, held: DataFrame, number: int, buckets: int) -> None:
        kind = held.schema["node_id"].dataType.simpleString()
        size = BLOCK
        ship(self.spark)

        def inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = TaskContext.get().partitionId() << 33
            for batch in batches:
                for at in range(0, batch.num_rows, size):
                    yield _inverted(batch.slice(at, size), block)
                    block += 1

        ts = held.select("node_id", tokens(F.coalesce("text", F.lit(""))).alias("ts"))
        # arrays of numbers take less room in shuffle and sort than one of structs
        blocks = ts.mapInArrow(inverted, f"token string, block long, node_id array<{kind}>, n array<int>, length array<int>")
        bucketed = blocks.withColumn("bucket", self._bucket(F.col("token"), buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "token", "block")
        best = F.array_max(F.zip_with("n", "length", term_score))
        rows = bucketed.select("token", "block", best.alias("best"), F.arrays_zip("node_id", "n", "length").alias("docs"), "bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/segment={number}")

    @staticmethod
    def _bucket(token: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")

    def _vectors(self, vectors: DataFrame, number: int) -> tuple[int, int]:
        """Writes vectors by cell; says which segment's centres they lie by, and how many cells share a folder."""
        like = self.content.get("centres", {}).get(str(self.segments[-1])) if self.segments else None
        # a segment much larger than what there was gets centres of its own, and so does a compacted one
        if like is None:
            like = number
            self._fit(vectors, number)
        centres = self._centres(like)
        node_type = vectors.schema["node_id"].dataType.simpleString()
        numbered = vectors.withColumn("unit", unit(F.col("embedding")))

        @F.pandas_udf("cell int, reach double")
        def near(units: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for part in units:
                yield pd.DataFrame([_nearest(u, centres) for u in part], columns=["cell", "reach"])

        width = max(1, -(-max(1, len(centres)) // min(FOLDERS, max(1, vectors.count() // PART_ROWS))))
        placed = numbered.withColumn("at", near("unit")).select("node_id", "embedding", "at.reach", "at.cell", F.floor(F.col("at.cell") / width).cast("int").alias("part"))
        path = f"{self.path}/vectors/segment={number}"
        placed.hint("rebalance", "part").sortWithinPartitions("part", "cell", "reach").write.mode("overwrite").partitionBy("part").parquet(path)
        kind = vectors.schema["embedding"].dataType.simpleString()
        held = self.spark.read.schema(f"node_id {node_type}, embedding {kind}, reach double, cell int, part int").parquet(path)
        held.groupBy("cell").agg(F.min("reach").alias("least"), F.max("reach").alias("radius"), F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/cells/segment={number}")
        return like, width

    def _fit(self, vectors: DataFrame, number: int) -> None:
        """Centres by a few rounds of k-means on the vectors with the least hashes; those of the commonest length."""
        n = vectors.count()
        rows = vectors.select("node_id", unit(F.col("embedding")).alias("u")).where("u is not null").orderBy(F.xxhash64("node_id"), "node_id").limit(SAMPLE).select("u").collect()
        lengths = [len(r["u"]) for r in rows]
        found = np.zeros((0, 0))
        if rows:
            dim = max(set(lengths), key=lambda d: (lengths.count(d), -d))
            x = np.array([r["u"] for r in rows if len(r["u"]) == dim])
            found = x[np.linspace(0, len(x) - 1, max(1, min(CELLS, math.isqrt(n), len(x)))).astype(int)]
            for _ in range(ROUNDS):
                mine = np.argmax(x @ found.T - (found * found).sum(1) / 2, 1)
                sums = np.zeros_like(found)
                np.add.at(sums, mine, x)
                many = np.bincount(mine, minlength=len(found))
                found = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], found)
        held = [(i, c.tolist()) for i, c in enumerate(found)]
        self.spark.createDataFrame(held, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centres/segment={number}")

    def _centres(self, number: int) -> np.ndarray:
        rows = self.spark.read.schema("cell int, centre array<double>").parquet(f"{self.path}/centres/segment={number}").orderBy("cell").collect()
        return np.array([r["centre"] for r in rows]) if rows else np.zeros((0, 0))

    # --- search ---

    def postings(self, words: list[str]) -> DataFrame:
        """The rows of some tokens: their folders, and row groups, are all that is read."""
        named = self.spark.createDataFrame([(w,) for w in words], "token string")
        sizes = sorted(set(self.content["buckets"][str(s)] for s in self.segments))
        found = named.select([self._bucket(F.col("token"), n).alias(str(n)) for n in sizes]).collect()
        wanted = F.lit(False)
        for s in self.segments:
            n = str(self.content["buckets"][str(s)])
            wanted = wanted | ((F.col("segment") == s) & F.col("bucket").isin(sorted({r[n] for r in found})))
        return self._table("postings").where(wanted & F.col("token").isin(words))

    def lexical(self, question: str, k: int = 12, any_word: bool = False) -> DataFrame:
        """(node_id, score) of the k best nodes with all (or any) words of the question, as retrieval.lexical()."""
        words = self.spark.createDataFrame([(question,)], "q string").select(F.array_distinct(tokens(F.col("q")))).first()[0]
        if not words or not self.segments:
            kind = self.content["schemas"]["tombs"].split(",")[0] if self.segments else "node_id string"
            return self.spark.createDataFrame([], f"{kind}, score double")
        held = self.postings(words)
        bounds = held.groupBy("segment", "block").agg(F.sum("best").alias("bound"), F.count("*").alias("words"))
        if not any_word:
            bounds = bounds.where(F.col("words") == len(words))

        def scored(blocks: DataFrame) -> DataFrame:
            each = held.join(blocks, ["segment", "block"], "left_semi").select("segment", "token", F.explode("docs").alias("d"))
            # equal sums whatever the order: by token
            parts = each.groupBy("segment", "d.node_id").agg(F.array_sort(F.collect_list(F.struct("token", term_score(F.col("d.n"), F.col("d.length")).alias("s")))).alias("parts"))
            if not any_word:
                parts = parts.where(F.size("parts") == len(words))
            by_word = F.aggregate(F.array(*[F.lit(w) for w in words]), F.lit(0.0), lambda s, w: s + F.coalesce(F.get(F.filter("parts", lambda p: p["token"] == w), 0)["s"], F.lit(0.0)))
            return self._live(parts.select("segment", "node_id", by_word.alias("score"))).select("node_id", "score")

        if sum(self.content["rows"].values()) <= FIRST_BLOCKS * k * BLOCK:
            # the first look would take nearly all blocks there are
            return scored(bounds.select("segment", "block")).orderBy(F.desc("score"), "node_id").limit(k)
        first = bounds.orderBy(F.desc("bound"), "segment", "block").limit(FIRST_BLOCKS * k)
        best = scored(first.select("segment", "block")).orderBy(F.desc("score")).limit(k).agg(F.count("*"), F.min("score")).first()
        # fewer than k were found: any block may have more
        worth = bounds.where(F.col("bound") >= best[1] - EPS) if best[0] == k else bounds
        return scored(worth.select("segment", "block")).orderBy(F.desc("score"), "node_id").limit(k)

    def _known_cells(self) -> dict:
        """The cells of all segments with their centres: segments x CELLS at most, kept for the version."""
        if self._cells is None:
            held = self._table("cells", "cell int, least double, radius double, n long, segment long")
            centres = {like: self._centres(like) for like in set(self.content["centres"].values())}
            self._cells = {"rows": held.orderBy("segment", "cell").collect(), "centres": centres}
        return self._cells

    def near_cells(self, query: list[float], distance: float) -> list[tuple[int, int, float, int]]:
        """(segment, cell, distance of its centre, rows) of the cells that may have a unit vector within a distance."""
        known, q = self._known_cells(), np.asarray(query, float)
        q = q / np.linalg.norm(q)
        away = {like: np.sqrt(((c - q) ** 2).sum(1)) if c.shape[1:] == q.shape else np.zeros(len(c)) for like, c in known["centres"].items()}
        out = []
        for r in known["rows"]:
            if r["cell"] < 0:
                # a zero vector has cosine 0, as one at the distance of the root of 2 has; others are of another length
                least, d = (math.sqrt(2) if r["cell"] == -1 else 0.0), 0.0
            else:
                d = float(away[self.content["centres"][str(r["segment"])]][r["cell"]])
                least = max(0.0, d - r["radius"], r["least"] - d)
            if least <= distance + EPS:
                out.append((least, r["segment"], r["cell"], d, r["n"]))
        return [x[1:] for x in sorted(out)]

    def vectors(self) -> DataFrame:
        return self._live(self._table("vectors"))

    def _of_cells(self, cells: list[tuple[int, int, float, int]], query: list[float], distance: float) -> DataFrame:
        """(node_id, score) of the vectors of some cells that may lie within a distance."""
        wanted = F.lit(False)
        for s in {s for s, *_ in cells}:
            parts = sorted({c // self.content["widths"][str(s)] for t, c, _, _ in cells if t == s})
            wanted = wanted | ((F.col("segment") == s) & F.col("part").isin(parts))
        held = self._table("vectors").where(wanted & F.col("cell").isin(sorted({c for _, c, _, _ in cells})))
        by_place = F.create_map(*[F.lit(x) for s, c, d, _ in cells for x in (f"{s}.{c}", d)]) if cells else F.create_map().cast("map<string,double>")
        away = F.try_element_at(by_place, F.concat_ws(".", F.col("segment").cast("string"), F.col("cell").cast("string")))
        near = held.where(away.isNotNull() & ((F.col("cell") < 0) | (F.abs(F.col("reach") - away) <= distance + EPS)))
        q = F.array(*[F.lit(float(x)) for x in query])
        near = near.where(F.size("embedding") == len(query))
        return self._live(near.select("segment", "node_id", cosine(F.col("embedding"), q).alias("score"))).select("node_id", "score")

    def dense(self, query: list[float], k: int = 12) -> DataFrame:
        """(node_id, score) of the k nearest by cosine, as retrieval.dense()."""
        if not self.segments or not any(query):
            held = self.vectors() if self.segments else self.spark.createDataFrame([], "node_id string, embedding array<double>")
            return held.select("node_id", F.lit(0.0).alias("score")).orderBy("node_id").limit(k)
        every = self.near_cells(query, 2.0)
        first, rows = [], 0
        for cell in every:
            first.append(cell)
            rows += cell[3]
            if rows >= FIRST_ROWS * k:
                break
        if len(first) == len(every):
            return self._of_cells(every, query, 2.0).orderBy(F.desc("score"), "node_id").limit(k)
        # the k-th cosine there bounds the distance of what is sought
        found = self._of_cells(first, query, 2.0).orderBy(F.desc("score")).limit(k).agg(F.count("*"), F.min("score")).first()
        distance = math.sqrt(max(0.0, 2 - 2 * found[1])) + 1e-6 if found[0] == k else 2.0
        return self._of_cells(self.near_cells(query, distance), query, distance).orderBy(F.desc("score"), "node_id").limit(k)

    def share_read(self, query: list[float], k: int = 12) -> float:
        """The share of all vectors in cells that a dense search of this question reads."""
        worst = self.dense(query, k).agg(F.min("score")).first()[0]
        distance = math.sqrt(max(0.0, 2 - 2 * worst)) + 1e-6
        return sum(c[3] for c in self.near_cells(query, distance)) / max(1, sum(c[3] for c in self.near_cells(query, 2.0)))


def _inverted(rows: pa.RecordBatch, block: int) -> pa.RecordBatch:
    """(token, block, node_id, n, length) of the nodes (node_id, ts) of a block: a row for each token."""
    ts = rows.column("ts")
    length = pc.list_value_length(ts).to_numpy(zero_copy_only=False).astype(np.int64)
    words = ts.flatten().dictionary_encode()
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # in order of token and node
    pair, n = np.unique(code * len(ts) + np.repeat(np.arange(len(ts)), length), return_counts=True)
    code, node = np.divmod(pair, max(1, len(ts)))
    first = np.flatnonzero(np.diff(code, prepend=-1))
    ends = pa.array(np.append(first, len(code)), pa.int32())
    lists = [rows.column("node_id").take(pa.array(node)), pa.array(n, pa.int32()), pa.array(length[node], pa.int32())]
    columns = [words.dictionary.take(pa.array(code[first])), pa.array(np.full(len(first), block), pa.int64()), *(pa.ListArray.from_arrays(ends, x) for x in lists)]
    return pa.RecordBatch.from_arrays(columns, ["token", "block", "node_id", "n", "length"])


def _nearest(u: np.ndarray | None, centres: np.ndarray) -> tuple[int, float]:
    """The cell of a unit vector and its distance from the centre; -1: a zero vector, -2: one of another length."""
    if u is None:
        return -1, 0.0
    if centres.shape[1:] != np.shape(u):
        return -2, 0.0
    away = np.sqrt(((centres - u) ** 2).sum(1))
    cell = int(away.argmin())
    return cell, float(away[cell])


_opened: dict[tuple[str, str], Index] = {}


def of_table(spark: SparkSession, sf_dir: str, name: str, rows: Callable[[], tuple[DataFrame, DataFrame, DataFrame | None]]) -> Index:
    """The index of a given table, in the shared folder: built on first use, synced when the table's files have changed.
    rows: gives nodes, their state, and vectors where these lie elsewhere."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}/{name}")
    if key not in _opened:
        _opened[key] = Index(spark, f"{versions.shared_dir(spark)}/sparkloom/index-{key[0]}-{abs(hash(key))}-{name}", key="node_id")
        _opened[key].source = None
    index, source = _opened[key], versions.fingerprint(spark, f"{sf_dir}/{name}.parquet")
    if index.source != source:
        nodes, state, vectors = rows()
        index.sync(nodes, state, vectors=vectors, same_keys=True)
        index.source = source
    return index


__all__ = ["Index", "of_table", "unit"]
