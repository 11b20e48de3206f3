"""N-gram Jaccard join by set-relation skipping, for sets of word shingles; exact up to collisions of hashes.

Sets are held as 64-bit hashes of shingles; sets are equal if size and two 64-bit sums over them are. The work goes down in steps, each of which only loses what provably
has no link:

1. Equal sets become one class, known by its smallest doc_id. Copies within a batch send their elements once.
2. Of each set the elements lowest in hash order are counted over the corpus (extended prefix: a linked pair
   shares at least as many of them as `need` says), by hash range. A slice of documents sends an element once.
3. For the classes left all elements are counted in the same way; elements of one set alone are dropped, the others
   are sorted by rising frequency. A set with too few shared elements has no link.
4. The index has the sets' prefixes by element, with positions and sizes. Each set is first compared with one
   centre, a set it meets in most of its lists; linked ones form stars around centres, and components.
5. Index lists are then read by block, not by posting: a list whose sets are all of one component is skipped
   whole, what remains is one entry per star with the range of its positions and sizes. Entries are joined by size block,
   and one whose position comes too late in its set to reach the threshold with a block's sizes never goes there.
6. A star's answers follow from its centre's: two centres further apart than the threshold and both radii have
   no linked members (Jaccard distance is a metric), linked centres join the components, and only in between
   are members compared: with the other centre first, and with its members only where that leaves it open.

So no group of near copies is ever expanded into its pairs, and no link between different texts is lost.

Defined results: null or blank text has an empty set and is linked with nothing; texts below n words have
their whole sequence as one shingle; rows that repeat a doc_id get the same result each (the larger set's, if
their texts differ); rows without doc_id have no component; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store, tokens
from . import words as words_

WORDS = 5
PERCENT = 80
#: Bytes of text of a slice.
STEP_BYTES = 4 << 20
#: Odd multipliers of the words of a shingle, from a rule.
MULTIPLIERS = np.array([xxhash.xxh64_intdigest(b"place", i) | 1 for i in range(64)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array, n: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    values = words.values.slice(words.offsets[0].as_py(), words.offsets[-1].as_py() - words.offsets[0].as_py())
    offsets = words.offsets.to_numpy().astype(np.int64)
    real = pc.not_equal(values, "").to_numpy(zero_copy_only=False)
    kept = np.concatenate([[0], np.cumsum(real)])
    offsets = kept[offsets - offsets[0]]
    coded = values.filter(pa.array(real)).dictionary_encode()
    h = xxhash.xxh64_intdigest
    names = np.fromiter((h(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    word = names[coded.indices.to_numpy()] if len(names) else np.zeros(0, np.uint64)
    hashes = np.zeros(max(0, len(word) - n + 1), np.uint64)
    for k in range(n):
        hashes += word[k : k + len(hashes)] * MULTIPLIERS[k]
    hashes = _mix(hashes)
    out = []
    for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if e - s >= n:
            out.append(np.unique(hashes[s : e - n + 1]))
        elif e > s:
            out.append(_mix(np.array([int((word[s:e] * MULTIPLIERS[: e - s]).sum(dtype=np.uint64)) ^ (e - s)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def least_shared(n, percent: int = PERCENT):
    """Elements that a set of n shares with any linked set."""
    return -(-n * percent // 100)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys start, and the end."""
    return np.concatenate([np.flatnonzero(np.concatenate([[True], np.diff(keys) != 0])), [len(keys)]]) if len(keys) else np.zeros(1, np.int64)


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """values cut at bounds, one run of raw bytes a row."""
    offsets = pa.py_buffer((bounds * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(values))])


def _joined(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """All rows' bytes of a binary column as one array."""
    out = []
    for chunk in column.chunks:
        at = np.frombuffer(chunk.buffers()[1], np.int32, len(chunk) + 1, 4 * chunk.offset)
        if at[-1] > at[0]:
            out.append(np.frombuffer(chunk.buffers()[2], np.uint8)[at[0] : at[-1]])
    return np.concatenate(out).view(dtype) if out else np.zeros(0, dtype)


def _rows_of(column: pa.ChunkedArray, itemsize: int) -> np.ndarray:
    """How many values each row of a binary column has."""
    return pc.binary_length(column).to_numpy().astype(np.int64) // itemsize


PACKED = "bucket int, tokens binary, counts binary, owners binary, doc_ids binary, sizes binary, sigs binary, settled binary"
PACKED_NAMES = ["bucket", "tokens", "counts", "owners", "doc_ids", "sizes", "sigs", "settled"]


def _packed(bucket: np.ndarray, *columns: pa.Array) -> pa.RecordBatch:
    none = pa.nulls(len(bucket), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *[none if c is None else c for c in columns]], PACKED_NAMES)


def _packs(ids: np.ndarray, sets: list[np.ndarray], sent: list[int], bits: int) -> Iterator[pa.RecordBatch]:
    """What a slice of documents sends: a row per hash range that it has elements in, and a row on its documents.

    An element that several sets of the slice hold is settled here: its owners know that it is shared, and the
    range is told once, without owners, so what a range gets of an element is one entry per slice, however many
    sets hold it. The work is that of sorting the slice's elements, however many ranges there are.
    """
    known: set[tuple] = set()
    sigs = [(int(s.sum(dtype=np.uint64)), int(_mix(s ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64))) for s in sets]
    mine, parts = [], []
    for i, (s, k) in enumerate(zip(sets, sent)):
        if len(s) and (len(s), sigs[i]) not in known:
            known.add((len(s), sigs[i]))
            mine.append(np.full(k, i, np.int64))
            parts.append(s[:k])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    owner = np.concatenate(mine) if mine else np.zeros(0, np.int64)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = _runs(flat)
    counts = np.diff(starts)
    found = flat[starts[:-1]]
    alone = counts == 1
    settled = np.bincount(owner[np.repeat(~alone, counts)], minlength=len(sets)).astype(np.int64)
    bucket = (found >> np.uint64(64 - bits)).astype(np.int64)
    bounds = _runs(bucket)
    owner_bounds = np.concatenate([[0], np.cumsum(alone)])[bounds]
    if len(found):
        yield _packed(bucket[bounds[:-1]], _binary(found, bounds), _binary(counts.astype(np.uint32), bounds), _binary(ids[owner[starts[:-1][alone]]], owner_bounds), None, None, None, None)
    if len(sets):
        one = np.array([0, len(sets)])
        sig = np.array(sigs, np.uint64).reshape(-1, 2)
        home = np.array([int(_mix(ids[:1].view(np.uint64))[0]) & (1 << bits) - 1])
        yield _packed(home, None, None, None, _binary(ids, one), _binary(np.array([len(x) for x in sets], np.int64), one), _binary(sig.ravel(), one * 2), _binary(settled, one))


def _slices(docs: DataFrame, n: int) -> Iterator:
    """Documents (doc_id, text) as one row per slice of some MiB of text: (slice, doc_ids, sizes, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        k = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in tokens.steps(batch, "text", STEP_BYTES):
                sets = shingle_sets(part.column("text"), n)
                sizes = np.array([len(x) for x in sets], np.int64)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                ids = part.column("doc_id").to_numpy()
                columns = [_binary(x, np.array([0, len(x)])) for x in (ids, sizes, flat)]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), *columns], ["slice", "doc_ids", "sizes", "tokens"])
                k += 1

    return docs.mapInArrow(words_.tidied(run), "slice long, doc_ids binary, sizes binary, tokens binary")


def _link(a: str, b: str, percent: int) -> tuple[Column, Column]:
    """Intersection size, and whether two sets (columns n_ and tokens_ of each) are linked."""
    both = F.size(F.array_intersect(f"tokens_{a}", f"tokens_{b}"))
    return both, both * 100 >= (F.col(f"n_{a}") + F.col(f"n_{b}") - both) * percent


def compared(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """pairs (a, b, ...) with distance and linked, from sets (rep, n, tokens)."""
    for side in ("a", "b"):
        one = sets.select(F.col("rep").alias(side), F.col("n").alias(f"n_{side}"), F.col("tokens").alias(f"tokens_{side}"))
        pairs = pairs.join(one, side)
    both, linked = _link("a", "b", percent)
    pairs = pairs.withColumn("both", both)
    union = F.col("n_a") + F.col("n_b") - F.col("both")
    return pairs.withColumns({"distance": 1 - F.col("both") / union, "linked": F.col("both") * 100 >= union * percent}).drop("n_a", "n_b", "tokens_a", "tokens_b", "both")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes on edges (a, b): the smallest node reachable. Labels spread to neighbours
    and then jump to their label's label, so the rounds grow with the logarithm of a path."""
    both = store.saved(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = store.saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        stepped = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        new = store.saved(stepped.join(jump, "mid", "left").select("node", "old", F.coalesce(F.least("mid", "far"), F.col("mid")).alias("component")), "labels")
        if new.where("component <> old").isEmpty():
            return new.drop("old")
        labels = store.saved(new.drop("old"), "labels")


def document_sets(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, size, s1, s2, shared, need): size and digest of each document's set, how many elements of its
    extended prefix other sets' have too, and how many a set with a link has there."""
    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    bits = max(8, int(np.ceil(np.log2(known.count() / 250 + 1))))
    extra = lambda size: max(1, size // 10)

    def share(size: int) -> int:
        return min(size, size - least_shared(size, percent) + extra(size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.steps(batch, "text", STEP_BYTES):
                sets = shingle_sets(part.column("text"), n)
                yield from _packs(part.column("doc_id").to_numpy(), sets, [share(len(x)) for x in sets], bits)

    def reduce(table: pa.Table) -> pa.Table:
        flat, counts = _joined(table.column("tokens"), np.uint64), _joined(table.column("counts"), np.uint32).astype(np.int64)
        _, back = np.unique(flat, return_inverse=True)
        total = np.bincount(back, counts)[back] if len(flat) else np.zeros(0)
        owner = _joined(table.column("owners"), np.int64)[total[counts == 1] > 1]
        ids, shared = np.unique(owner, return_counts=True)
        doc, size, settled = (_joined(table.column(c), np.int64) for c in ("doc_ids", "sizes", "settled"))
        sig = _joined(table.column("sigs"), np.int64).reshape(-1, 2)
        none = pa.nulls(len(ids), pa.int64())
        columns = [(ids, doc), (none, size), (none, sig[:, 0]), (none, sig[:, 1]), (shared, settled)]
        del flat, back, total
        words_.release()
        return pa.table([pa.chunked_array([pa.array(x, pa.int64()), pa.array(y, pa.int64())]) for x, y in columns], ["doc_id", "size", "s1", "s2", "shared"])

    found = known.mapInArrow(words_.tidied(run), PACKED).groupBy("bucket").applyInArrow(reduce, "doc_id long, size long, s1 long, s2 long, shared long")
    # rows that repeat a doc_id: the larger set stands for it
    best = F.max(F.when(F.col("size").isNotNull(), F.struct("size", "s1", "s2"))).alias("set")
    held = found.groupBy("doc_id").agg(best, F.sum("shared").alias("shared"))
    least = F.ceil(F.col("set.size") * F.lit(percent) / 100)
    return held.select("doc_id", F.col("set.size").alias("size"), "set.s1", "set.s2", "shared", F.greatest(F.lit(1), F.floor(least / 10)).cast("long").alias("need"))


def shared_sets(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(rep, n, tokens) of documents (doc_id, text): each set's size, and its elements that others have too by
    rising frequency. Sets with too few of them are left out.

    Sets stay in their slices; what travels is each slice's distinct elements, to be counted by hash range, and
    back come the frequencies. A range gets an element once per slice, however many sets hold it.
    """
    held = store.saved(_slices(docs, n), "slices", "lz4")
    elements = held.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    bits = max(6, int(np.ceil(np.log2(elements / 8 / 100_000 + 1))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                found, counts = np.unique(_joined(pa.chunked_array([row.column("tokens")]), np.uint64), return_counts=True)
                bucket = (found >> np.uint64(64 - bits)).astype(np.int64)
                bounds = _runs(bucket)
                slices = pa.array(np.full(len(bounds) - 1, row.column("slice")[0].as_py()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(bucket[bounds[:-1]], pa.int32()), slices, _binary(found, bounds), _binary(counts.astype(np.uint32), bounds)], ["bucket", "slice", "tokens", "counts"])

    def count(table: pa.Table) -> pa.Table:
        flat, counts = _joined(table.column("tokens"), np.uint64), _joined(table.column("counts"), np.uint32).astype(np.int64)
        home = np.repeat(table.column("slice").to_numpy(), _rows_of(table.column("tokens"), 8))
        _, back = np.unique(flat, return_inverse=True)
        total = np.bincount(back, counts)[back].astype(np.uint32) if len(flat) else np.zeros(0, np.uint32)
        keep = np.flatnonzero(total > 1)
        keep = keep[np.argsort(home[keep], kind="stable")]
        bounds = _runs(home[keep])
        words_.release()
        return pa.table([pa.array(home[keep][bounds[:-1]], pa.int64()), _binary(flat[keep], bounds), _binary(total[keep], bounds)], ["slice", "tokens", "dfs"])

    def gather(mine: pa.Table, counted: pa.Table) -> pa.Table:
        doc, size = _joined(mine.column("doc_ids"), np.int64), _joined(mine.column("sizes"), np.int64)
        flat = _joined(mine.column("tokens"), np.uint64)
        known, df = _joined(counted.column("tokens"), np.uint64), _joined(counted.column("dfs"), np.uint32)
        order = np.argsort(known)
        known, df = known[order], df[order]
        at = np.searchsorted(known, flat)
        shared = np.concatenate([known, [0]])[at] == flat if len(known) else np.zeros(len(flat), bool)
        shared &= at < len(known)
        owner = np.repeat(np.arange(len(doc)), size)[shared]
        flat, freq = flat[shared], df[at[shared]]
        order = np.lexsort((flat.view(np.int64), freq, owner))
        lengths = np.bincount(owner, minlength=len(doc))
        keep = (lengths >= least_shared(size, percent)) & (size > 0)
        values = flat[order][np.repeat(keep, lengths)].view(np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths[keep])])
        words_.release()
        return pa.table([pa.array(doc[keep]), pa.array(size[keep]), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))], ["rep", "n", "tokens"])

    dealt = held.select("slice", "tokens").mapInArrow(words_.tidied(deal), "bucket int, slice long, tokens binary, counts binary")
    counted = dealt.groupBy("bucket").applyInArrow(count, "slice long, tokens binary, dfs binary")
    return held.groupBy("slice").cogroup(counted.groupBy("slice")).applyInArrow(gather, "rep long, n long, tokens array<long>")


def _size_block(n: Column, percent: int) -> Column:
    """Linked sets lie in the same block of sizes or in neighbouring ones."""
    return F.floor(F.log(n) / float(np.log(100 / percent)) + 1e-9).cast("int")


def links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges (a, b) between linked sets (rep, n, tokens) whose components are those of all links."""
    least = F.ceil(F.col("n") * F.lit(percent) / 100)
    alone = F.col("n") - F.size("tokens")
    prefix = F.slice("tokens", 1, F.greatest(F.lit(0), (F.col("n") - least + 1 - alone).cast("int")))
    index = sets.select("rep", "n", alone.alias("alone"), F.posexplode(prefix).alias("at", "token"))
    index = store.saved(index.select("token", "rep", "n", (F.col("alone") + F.col("at")).cast("int").alias("pos")), "index")
    # stars: the smallest set of a list offers itself as centre; a set takes the one offered most often
    offers = store.saved(index.groupBy("token").agg(F.min("rep").alias("b"), F.count("*").alias("k")).where("k > 1").drop("k"), "offers")
    votes = index.join(offers, "token").where("rep <> b").groupBy(F.col("rep").alias("a"), "b").agg(F.count("*").alias("k"))
    chosen = votes.groupBy("a").agg(F.max(F.struct("k", -F.col("b"))).alias("best")).select("a", (-F.col("best.col2")).alias("b"))
    first = store.saved(compared(chosen, sets, percent), "stars")
    spokes = first.where("linked").select("a", "b")
    store.release(sets.sparkSession)
    found = components(spokes).withColumnRenamed("node", "rep")
    star = first.where("linked").select(F.col("a").alias("rep"), F.col("b").alias("star"), F.col("distance").alias("spoke"))
    placed = sets.select("rep").join(star, "rep", "left").join(found, "rep", "left")
    placed = store.saved(placed.select("rep", F.coalesce("star", "rep").alias("star"), F.coalesce("component", "rep").alias("component"), F.coalesce("spoke", F.lit(0.0)).alias("spoke")), "placed")
    # skip lists of one component; of the others keep one entry per star
    posts = index.join(placed, "rep")
    open_ = store.saved(posts.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token"), "open-lists")
    posts = store.saved(posts.join(open_, "token"), "open-posts")
    block = _size_block(F.col("n"), percent)
    entry = posts.groupBy("token", "star", "component", block.alias("block")).agg(F.min("pos").alias("pos"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    entry = store.saved(entry, "entries")
    # an entry goes only to blocks of sizes that its position can still reach the threshold with
    least_of = lambda b: F.pow(F.lit(100 / percent), b) * (1 - 1e-6)
    reaches = lambda b, s: F.expr(f"(hi{s} - pos{s}) * {100 + percent}") >= (F.col(f"lo{s}") + least_of(b)) * percent
    left = entry.select("token", *[F.col(c).alias(f"{c}_a") for c in ("star", "component", "pos", "lo", "hi")], F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block")).where(reaches(F.col("block"), "_a"))
    right = entry.where(reaches(F.col("block") - 1, "")).select("token", "block", *[F.col(c).alias(f"{c}_b") for c in ("star", "component", "pos", "lo", "hi")])

    def may(lo_a, hi_a, pos_a, lo_b, hi_b, pos_b) -> Column:
        rest = F.least(F.expr(f"{hi_a} - {pos_a}"), F.expr(f"{hi_b} - {pos_b}"))
        return F.expr(f"{hi_a} * 100 >= {lo_b} * {percent} and {hi_b} * 100 >= {lo_a} * {percent}") & (rest * (100 + percent) >= F.expr(f"{lo_a} + {lo_b}") * percent)

    near = may("lo_a", "hi_a", "pos_a", "lo_b", "hi_b", "pos_b")
    pairs = left.join(right, ["token", "block"]).where((F.col("component_a") < F.col("component_b")) & near)
    pairs = pairs.select(F.col("star_a").alias("a"), F.col("star_b").alias("b")).distinct()
    centres = store.saved(compared(pairs, sets, percent), "centres")
    store.release(sets.sparkSession)
    radius = placed.groupBy("star").agg(F.max("spoke").alias("radius"))
    between = centres.where("not linked")
    for side in ("a", "b"):
        between = between.join(radius.select(F.col("star").alias(side), F.col("radius").alias(f"radius_{side}")), side, "left")
    limit = 1 - percent / 100 + 1e-9
    between = between.na.fill(0.0, ["radius_a", "radius_b"])
    between = between.where((F.col("radius_a") + F.col("radius_b") > 0) & (F.col("distance") <= limit + F.col("radius_a") + F.col("radius_b")))
    between = store.saved(between.select("a", "b", "distance", "radius_a", "radius_b"), "between")
    last = []
    for own, other in (("a", "b"), ("b", "a")):
        # members of one star against the other's centre, but those too near their own centre to reach over
        member = placed.select(F.col("rep"), F.col("star").alias(own), F.col("spoke")).where("rep <> star")
        reach = F.col("spoke") >= F.col("distance") - limit - F.col(f"radius_{other}")
        pairs = between.join(member, own).where(reach)
        pairs = pairs.select(F.col("rep").alias("a"), F.col(other).alias("b"), F.col(own).alias("own"), "spoke", F.col(f"radius_{other}").alias("radius"))
        last.append(store.saved(compared(pairs, sets, percent), "members"))
    # what neither shows: members of both, each near enough to the other's centre
    x, y = (t.where((~F.col("linked")) & (F.col("radius") > 0) & (F.col("distance") <= limit + F.col("radius"))) for t in last)
    x = x.select(F.col("a").alias("x"), F.col("own").alias("star_x"), F.col("b").alias("star_y"), F.col("spoke").alias("spoke_x"), F.col("distance").alias("far_x"))
    y = y.select(F.col("a").alias("y"), F.col("own").alias("star_y"), F.col("b").alias("star_x"), F.col("spoke").alias("spoke_y"), F.col("distance").alias("far_y"))
    near = (F.col("far_x") - F.col("spoke_y") <= limit) & (F.col("far_y") - F.col("spoke_x") <= limit)
    pairs = store.saved(x.join(y, ["star_x", "star_y"]).where(near).select(F.col("x").alias("a"), F.col("y").alias("b")), "member-pairs")
    for found in (*last, compared(pairs, sets, percent)):
        spokes = spokes.union(found.where("linked").select("a", "b"))
    return spokes.union(centres.where("linked").select("a", "b"))


def classes(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) of every document."""
    spark = docs.sparkSession
    known = store.saved(document_sets(docs, n, percent), "document-sets")
    store.release(spark)
    same = known.where("size > 0").groupBy("size", "s1", "s2").agg(F.min("doc_id").alias("class_id"), F.max("shared").alias("shared"), F.max("need").alias("need"), F.count("*").alias("copies"))
    same = store.saved(same, "classes")
    with store.scratch(spark):
        reps = store.saved(same.where("shared >= need").select(F.col("class_id").alias("doc_id")), "candidates")
        wanted = docs.select(F.col("doc_id").cast("long"), "text").join(reps, "doc_id", "left_semi")
        sets = store.saved(shared_sets(wanted, n, percent), "shared-sets")
        store.release(spark)
        found = store.saved(components(store.saved(links(sets, percent), "links")), "components", keep=True)
    many = store.saved(same.where("copies > 1").select("size", "s1", "s2", "class_id"), "copied")
    held = known.join(many, ["size", "s1", "s2"], "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    held = held.join(found.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
    held = held.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component", "class_id").alias("component_id"), "class_id")
    # a row for each of the table's rows, however often a doc_id occurs
    out = docs.where("doc_id is not null").select(F.col("doc_id").cast("long")).join(held, "doc_id")

    def nameless(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(s) for s in shingle_sets(batch.column("text"), n)]
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(sizes, pa.int64()), none, none], ["doc_id", "n_shingles", "component_id", "class_id"])

    lost = docs.where("doc_id is null").select("text")
    return out if lost.isEmpty() else out.union(lost.mapInArrow(nameless, "doc_id long, n_shingles long, component_id long, class_id long"))
