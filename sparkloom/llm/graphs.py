"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph per shard.

Index: rows are dealt evenly over shards of SHARD_ROWS vectors (or SHARD_BYTES), and each shard's task builds its graph: equal
vectors are one node with all their ids; every node is in layer 0, and in each layer above with probability 1 / M. Layers are built
from the top, nodes in batches that grow with the layer: a batch goes down the layers above, searches the layer as it
stands (and itself) for its nearest, keeps diverse ones of them, and they link back. A layer is a flat array of
neighbours, 2 M a node in layer 0 and M above, -1 where there is none. Largest inner product isn't a metric: for
building, vectors get one more component that makes all norms of a shard equal, which queries leave at zero.
A node that pruning has cut off is linked again, so all can be reached from the root, and small shards are searched whole.

Search: a block of queries goes to all shards; each goes down the layers and keeps a beam of EF nodes, many queries and
BEAM_STEP nodes of each at a time. What the beams end with is scored in double precision on the original vectors.
A task merges its shards' results, and a window merges the tasks'.

Queries are searched in blocks of BLOCK_BYTES, which are collected and broadcast one after the other.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
without vec_id; a query finds no row of its own vec_id; of rows that repeat a query's vec_id, the one with the least
vector asks; vectors are compared with those of their own length only; equal scores go by rising vec_id; candidates
that repeat a row are found as often as they occur; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store, words

M, EF_BUILD, EF = 16, 96, 256
SHARD_ROWS, SHARD_BYTES = 1 << 14, 32 << 20
#: Bytes of the vectors of a block of queries.
BLOCK_BYTES = 16 << 20
#: Queries of a beam search, and nodes that each takes up in a step.
BEAM_ROWS, BEAM_STEP = 256, 6
SEED = 1


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, scores) of the ef best that a beam search finds for each query, not in order; -1: none. entries: a
    node or several for each query."""
    rows, n, width = len(queries), len(vectors), links.shape[1]
    node = np.full((rows, ef), -1, np.int32)
    score = np.full((rows, ef), -np.inf, np.float32)
    fresh = np.zeros((rows, ef), bool)
    seen = np.zeros((rows, n), bool)
    k = min(ef, entries.shape[1])
    # an entry that occurs twice counts once
    entries = np.sort(entries[:, :k], 1)
    entries[:, 1:][entries[:, 1:] == entries[:, :-1]] = -1
    node[:, :k] = entries
    score[:, :k] = np.where(node[:, :k] >= 0, np.einsum("rkd,rd->rk", vectors[node[:, :k]], queries), -np.inf)
    fresh[:, :k] = node[:, :k] >= 0
    row, col = np.nonzero(entries >= 0)
    seen[row, entries[row, col]] = True
    step = min(BEAM_STEP, ef)
    active = np.arange(rows)
    while len(active):
        open_ = np.where(fresh[active], score[active], -np.inf)
        at = np.argpartition(open_, ef - step, 1)[:, ef - step :] if step < ef else np.tile(np.arange(ef), (len(active), 1))
        real = np.take_along_axis(open_, at, 1) > -np.inf
        going = real.any(1)
        active, at, real = active[going], at[going], real[going]
        if not len(active):
            break
        fresh[active[:, None], at] = False
        near = np.where(real[:, :, None], links[node[active[:, None], at]], -1).reshape(len(active), step * width)
        row, col = np.nonzero(near >= 0)
        found = near[row, col]
        new = ~seen[active[row], found]
        row, col, found = row[new], col[new], found[new]
        # a node that two others name counts once
        _, first = np.unique(row.astype(np.int64) * n + found, return_index=True)
        row, col, found = row[first], col[first], found[first]
        seen[active[row], found] = True
        gain = np.full(near.shape, -np.inf, np.float32)
        gain[row, col] = np.einsum("kd,kd->k", vectors[found], queries[active[row]])
        all_scores = np.concatenate([score[active], gain], 1)
        kept = np.argpartition(all_scores, all_scores.shape[1] - ef, 1)[:, -ef:]
        score[active] = np.take_along_axis(all_scores, kept, 1)
        node[active] = np.take_along_axis(np.concatenate([node[active], near], 1), kept, 1)
        fresh[active] = np.take_along_axis(np.concatenate([fresh[active], gain > -np.inf], 1), kept, 1)
    return np.where(score > -np.inf, node, -1), score


def diverse(vectors: np.ndarray, node: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (falling scores; -1: none) up to most that are nearer to the row's own than to those
    chosen before; where these are fewer, the nearest of the others fill up."""
    held = vectors[node]
    among = held @ held.transpose(0, 2, 1)
    rows, width = node.shape
    real = node >= 0
    chosen = np.zeros((rows, width), bool)
    nearest = np.full((rows, width), -np.inf, np.float32)
    size = np.zeros(rows, np.int64)
    for k in range(width):
        take = real[:, k] & (score[:, k] > nearest[:, k]) & (size < most)
        chosen[take, k] = True
        size += take
        nearest[take] = np.maximum(nearest[take], among[take, k])
    order = np.argsort(~chosen * 2 + ~real, axis=1, kind="stable")[:, :most]
    return np.where(np.take_along_axis(real, order, 1), np.take_along_axis(node, order, 1), -1)


def _sorted(node: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-score, 1, kind="stable")
    return np.take_along_axis(node, order, 1), np.take_along_axis(score, order, 1)


def _link_back(vectors: np.ndarray, links: np.ndarray, own: np.ndarray, chosen: np.ndarray) -> None:
    """Each chosen node gets its own as neighbour; where there are too many, diverse ones stay."""
    width = links.shape[1]
    row, col = np.nonzero(chosen >= 0)
    to, back = chosen[row, col], own[row]
    order = np.lexsort((back, to))
    to, back = to[order], back[order]
    at = words.starts(to)
    target, many = to[at[:-1]], np.diff(at)
    have = (links[target] >= 0).sum(1)
    place = np.arange(len(to)) - np.repeat(at[:-1], many) + np.repeat(have, many)
    fits = np.repeat(have + many <= width, many)
    links[to[fits], place[fits]] = back[fits]
    full = np.flatnonzero(have + many > width)
    for part in np.array_split(full, max(1, len(full) // 256)):
        if not len(part):
            continue
        wide = int((have + many)[part].max())
        node = np.full((len(part), wide), -1, np.int32)
        node[:, :width] = links[target[part]]
        r = np.repeat(np.arange(len(part)), many[part])
        src = np.concatenate([np.arange(at[p], at[p + 1]) for p in part])
        node[r, place[src]] = back[src]
        score = np.where(node >= 0, np.einsum("rkd,rd->rk", vectors[node], vectors[target[part]]), -np.inf).astype(np.float32)
        node, score = _sorted(node, score)
        links[target[part]] = diverse(vectors, node, score, width)


def build(vectors: np.ndarray, m: int = M, ef: int = EF_BUILD) -> list[tuple[np.ndarray, np.ndarray]]:
    """The layers from 0 up: (nodes, their neighbours by number of node). vectors: distinct, of equal norms."""
    n = len(vectors)
    level = np.floor(-np.log(1 - np.random.default_rng(SEED).random(n)) / np.log(m)).astype(int)
    order = np.argsort(-level, kind="stable")
    layers: list[tuple[np.ndarray, np.ndarray]] = []
    for height in range(int(level.max()), -1, -1):
        nodes = order[: int((level >= height).sum())].astype(np.int32)
        width = 2 * m if height == 0 else m
        links = np.full((n, width), -1, np.int32)
        done = 0
        while done < len(nodes):
            batch = nodes[done : done + max(32, min(BEAM_ROWS, done))]
            mates = vectors[batch] @ vectors[batch].T
            np.fill_diagonal(mates, -np.inf)
            node, score = np.tile(batch, (len(batch), 1)), mates
            if done:
                entry = descended(vectors, layers, vectors[batch], nodes[:1])
                found, how = beam(vectors, links, vectors[batch], entry, ef)
                how[found == batch[:, None]] = -np.inf
                node, score = np.concatenate([found, node], 1), np.concatenate([how, score], 1)
            node, score = _sorted(node, score)
            node, score = node[:, :ef], score[:, :ef]
            chosen = diverse(vectors, np.where(score > -np.inf, node, -1), score, m)
            links[batch, : chosen.shape[1]] = chosen
            _link_back(vectors, links, batch, chosen)
            done += len(batch)
        layers.insert(0, (nodes, links[np.sort(nodes)] if height else connected(links, int(order[0]))))
    return layers


def connected(links: np.ndarray, root: int) -> np.ndarray:
    """links with those put in that every node can be reached by from the root: a node that pruning has cut off is
    linked from one of its own neighbours, in a place that is free or in a further column."""
    reached = np.zeros(len(links), bool)
    reached[root] = True
    front = np.array([root])
    while True:
        while len(front):
            near = links[front].ravel()
            near = np.unique(near[near >= 0])
            front = near[~reached[near]]
            reached[front] = True
        lost = np.flatnonzero(~reached)
        if not len(lost):
            return links
        near = links[lost]
        good = (near >= 0) & reached[near]
        some = good.any(1)
        # where none of the lost has a neighbour that is reached, the root takes one up
        own = lost[some] if some.any() else lost[:1]
        to = near[some][np.arange(int(some.sum())), good[some].argmax(1)] if some.any() else np.array([root])
        order = np.argsort(to, kind="stable")
        own, to = own[order], to[order]
        at = words.starts(to)
        place = (links[to] >= 0).sum(1) + np.arange(len(to)) - np.repeat(at[:-1], np.diff(at))
        more = int(place.max()) + 1 - links.shape[1]
        if more > 0:
            links = np.concatenate([links, np.full((len(links), more), -1, np.int32)], 1)
        links[to, place] = own
        reached[own] = True
        front = own


def _layer(n: int, nodes: np.ndarray, links: np.ndarray) -> np.ndarray:
    """A layer's neighbours as an array over all nodes."""
    if len(links) == n:
        return links
    out = np.full((n, links.shape[1]), -1, np.int32)
    out[np.sort(nodes)] = links
    return out


def descended(vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Nodes near each query after going down the layers (from the one above layer 0 up), one by one."""
    at = np.repeat(entry[None, :1], len(queries), 0).astype(np.int32)
    for nodes, links in reversed(layers):
        found, _ = beam(vectors, _layer(len(vectors), nodes, links), queries, at, 8)
        at = found
    return at


INDEX = "shard long, dim int, wide boolean, ids binary, bounds binary, vectors binary, nodes array<binary>, links array<binary>"
NAMES = ["shard", "dim", "wide", "ids", "bounds", "vectors", "nodes", "links"]


def _augmented(vectors: np.ndarray) -> np.ndarray:
    """Vectors, scaled so that the longest has norm 1, with a component that gives all of them norm 1."""
    held = vectors.astype(np.float64)
    square = (held * held).sum(1)
    most = square.max()
    return np.column_stack([held / np.sqrt(most), np.sqrt(np.maximum(0, 1 - square / most))]).astype(np.float32)


def _row(shard: int, ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
    """The index row of vectors of one length."""
    order = np.lexsort((ids, *vectors.T[::-1]))
    ids, vectors = ids[order], vectors[order]
    bounds = words.starts(*vectors.T)
    distinct = vectors[bounds[:-1]]
    layers = build(_augmented(distinct))
    one = lambda x: pa.array([x.tobytes()], pa.binary())
    lists = lambda xs: pa.array([[x.tobytes() for x in xs]], pa.list_(pa.binary()))
    columns = [
        pa.array([shard]), pa.array([vectors.shape[1]], pa.int32()), pa.array([vectors.dtype == np.float64]), one(ids), one(bounds.astype(np.int64)), one(distinct),
        lists([nodes for nodes, _ in layers]), lists([links for _, links in layers]),
    ]
    return pa.RecordBatch.from_arrays(columns, NAMES)


def write_index(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index of rows (vec_id, embedding), written: a row for each shard and length of vectors."""
    held = rows.select(F.col("vec_id").cast("long"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    n, size = held.agg(F.count("*"), F.sum(F.size("embedding").cast("long"))).first()
    shards = max(1, -(-n // shard_rows), -(-(size or 0) * 4 // SHARD_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        table = pa.Table.from_batches(held).combine_chunks()
        column = table.column("embedding").chunk(0)
        ids, flat, offsets = table.column("vec_id").to_numpy(), column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        sizes = np.diff(offsets)
        for dim in np.unique(sizes):
            mine = np.flatnonzero(sizes == dim)
            yield _row(TaskContext.get().partitionId(), ids[mine], flat[offsets[mine][:, None] + np.arange(dim)])

    return store.saved(held.repartition(shards).mapInArrow(run, INDEX), "vector-index")


def _exact(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products row by row in doubles, summed in order of the components."""
    out = np.zeros(len(vectors))
    for d in range(vectors.shape[1]):
        out += vectors[:, d].astype(np.float64) * queries[:, d].astype(np.float64)
    return out


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which rows are the k best of their query, in order."""
    order = np.lexsort((ids, -score, query))
    at = words.starts(query[order])
    rank = np.arange(len(order)) - np.repeat(at[:-1], np.diff(at))
    return order[rank < k]


def _searched(row: dict, query_ids: np.ndarray, queries: np.ndarray, k: int, ef: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, id, score) of what a shard has for the queries, a group of them at a time."""
    kind = np.float64 if row["wide"] else np.float32
    ids, bounds = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["bounds"], np.int64)
    vectors = np.frombuffer(row["vectors"], kind).reshape(-1, row["dim"])
    layers = []
    for nodes, links in zip(row["nodes"], row["links"]):
        nodes = np.frombuffer(nodes, np.int32)
        layers.append((nodes, np.frombuffer(links, np.int32).reshape(len(nodes), -1)))
    like = vectors.astype(np.float32)
    longest = np.abs(like).max()
    ground = layers[0][1]
    for s in range(0, len(queries), BEAM_ROWS):
        asked = queries[s : s + BEAM_ROWS]
        # directions count alone, so scales far from 1 do no harm
        q = (asked / np.abs(asked).max(1, keepdims=True)).astype(np.float32)
        # from the root every node can be reached
        entry = np.column_stack([np.full(len(q), layers[-1][0][0], np.int32), descended(like / longest, layers[1:], q, layers[-1][0][:1])])
        node, _ = beam(like / longest, ground, q, entry, max(ef, k + 1))
        r, c = np.nonzero(node >= 0)
        found = node[r, c]
        score = _exact(vectors[found], asked[r])
        # of equal vectors the first k + 1 ids, as one may be the query's own
        many = np.minimum(np.diff(bounds)[found], k + 1)
        at = np.repeat(bounds[found], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        query, score, found = np.repeat(r, many), np.repeat(score, many), ids[at]
        other = found != query_ids[s + query]
        query, score, found = query[other], score[other], found[other]
        best = _best(query, found, score, k)
        yield query[best] + s, found[best], score[best]


RESULT = "query_id long, vec_id long, score double"


def nearest(index: DataFrame, asking: DataFrame, k: int = 20, ef: int = EF, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of the asking rows (vec_id, embedding) the k rows of the index with
    the largest inner product that the search finds, nearest first."""
    spark = index.sparkSession
    held = asking.select(F.col("vec_id").cast("long"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    held = store.saved(held.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vector-queries")
    size = held.agg(F.sum(F.size("embedding").cast("long") * 8)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    path = store.new_path(spark, "nearest")
    for b in range(blocks):
        mine = held.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow().combine_chunks()
        by_dim = {}
        if mine.num_rows:
            column = mine.column("embedding").chunk(0)
            flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            for dim in np.unique(np.diff(offsets)).tolist():
                at = np.flatnonzero(np.diff(offsets) == dim)
                by_dim[dim] = (mine.column("vec_id").to_numpy()[at], flat[offsets[at][:, None] + np.arange(dim)])
        sent = spark.sparkContext.broadcast(by_dim)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            merged: dict[int, tuple] = {}
            for batch in batches:
                for at in range(batch.num_rows):
                    row = batch.slice(at, 1).to_pylist()[0]
                    if row["dim"] not in sent.value:
                        continue
                    names, vectors = sent.value[row["dim"]]
                    parts = list(_searched(row, names, vectors, k, ef))
                    found = tuple(np.concatenate(x) for x in zip(*parts))
                    if row["dim"] in merged:
                        both = tuple(np.concatenate(x) for x in zip(merged[row["dim"]], found))
                        best = _best(*both, k)
                        found = tuple(x[best] for x in both)
                    merged[row["dim"]] = found
            for dim, (query, ids, score) in merged.items():
                names = sent.value[dim][0]
                for s in range(0, len(query), 100_000):
                    part = slice(s, s + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(names[query[part]]), pa.array(ids[part]), pa.array(score[part])], ["query_id", "vec_id", "score"])

        index.mapInArrow(run, RESULT).write.mode("append").parquet(path)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = spark.read.schema(RESULT).parquet(path).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
