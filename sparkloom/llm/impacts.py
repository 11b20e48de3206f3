"""Ranked lexical search by an impact-ordered index, score at a time.

Index: documents lie in shards of some MiB of text. A row per shard and term has its postings grouped by exact impact, the
greatest first: the impacts, how many documents have each, and those documents by their number in the shard. One
more row per shard, without a term, has the documents' ids. An impact here is (1000000000 * tf) div (1000 * tf +
12 * m); a term's weight multiplies all of its impacts alike and so keeps their order, and comes with the search.

Search: only rows of the questions' terms are read, and meet in their shard. For each question the groups of all its
terms are taken by falling impact, and their documents' sums grow. What any document can still gain is the
sum of the greatest impacts left of each term. Once no document outside the k best can reach the k-th best sum, not
even a tie, the k are proven; their scores are then completed from the groups left. Shards' results are merged.

Questions are searched in blocks of BLOCK_TERMS terms, whose terms and weights are sent to all tasks: the bound of what is
collected and broadcast (a question of more terms is a block of its own). A shard has SHARD_BYTES of text, or one
longer text. All else is a table: document frequencies, weights, postings, results.

Defined results: null and empty texts have no term and are never found; questions without a known term find
nothing; equal scores go by rising doc_id, without one last; rows that repeat a doc_id are documents of their own,
rows that repeat an item_id questions of their own; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store, words

#: What separates terms: ASCII but digits and letters.
TABLE = words.kinds(bytes(b for b in range(128) if not chr(b).isalnum()))
SHARD_BYTES = 32 << 20
BLOCK_TERMS = 1 << 20
#: Postings of the first round of a question; each round doubles.
ROUND = 4096
INDEX = "shard long, term string, df int, impacts binary, sizes binary, docs binary"
NAMES = ["shard", "term", "df", "impacts", "sizes", "docs"]


def collection(docs: DataFrame) -> tuple[int, int]:
    """N and L: documents with a term, and all their terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = words.counts(batch.column(0), TABLE)
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], ["docs", "terms"])

    found = docs.select("text").mapInArrow(run, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return found[0] or 0, found[1] or 0


def _postings(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms in order of bytes, and by term and row: code of the term, row, how often."""
    parts = list(words.words(texts, TABLE))
    held = pa.chunked_array([pa.DictionaryArray.from_arrays(pa.array(w.codes, pa.int32()), w.vocabulary) for w in parts], pa.dictionary(pa.int32(), pa.string())).unify_dictionaries()
    vocabulary = held.chunk(0).dictionary if held.num_chunks else pa.array([], pa.string())
    order = pc.sort_indices(vocabulary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    keys, times = [], []
    for chunk, w in zip(held.chunks, parts):
        k, n = np.unique(rank[chunk.indices.to_numpy()] * len(texts) + w.rows, return_counts=True)
        keys.append(k)
        times.append(n)
    key, back = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_inverse=True)
    tf = np.bincount(back, np.concatenate(times)).astype(np.int64) if len(key) else np.zeros(0, np.int64)
    return vocabulary.take(pa.array(order)), key // max(1, len(texts)), key % max(1, len(texts)), tf


def impact(tf, m):
    """The impact of a term that a document with norm m has tf times, without the term's weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _shard(number: int, ids: pa.Array, texts: pa.Array, n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
    terms, code, doc, tf = _postings(texts)
    if not len(terms):
        return
    length = np.bincount(doc, tf, minlength=len(texts)).astype(np.int64)
    m = 75 + (25 * length * n_docs) // n_terms
    found = impact(tf, m[doc])
    order = np.lexsort((doc, -found, code))
    code, found, doc = code[order], found[order], doc[order].astype(np.uint32)
    groups, by_term = words.starts(code, found), words.starts(code)
    cut = np.searchsorted(groups, by_term)
    columns = [
        pa.array(np.full(len(terms), number)), terms, pa.array(np.diff(by_term), pa.int32()),
        words.binary(found[groups[:-1]].astype(np.uint32), cut), words.binary(np.diff(groups).astype(np.uint32), cut), words.binary(doc, by_term),
    ]
    held = pa.RecordBatch.from_arrays(columns, NAMES)
    for at in range(0, len(terms), 10_000):
        yield held.slice(at, 10_000)
    # the shard's documents: which have an id, and the ids
    known = words.binary(pc.is_valid(ids).to_numpy(zero_copy_only=False).astype(np.uint8), np.array([0, len(ids)]))
    named = words.binary(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64), np.array([0, len(ids)]))
    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([None], pa.string()), pa.array([len(ids)], pa.int32()), known, pa.nulls(1, pa.binary()), named], NAMES)


def write_index(docs: DataFrame, n_docs: int, n_terms: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of documents (doc_id, text), written; n_docs and n_terms: of collection()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from . import tokens

        number = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in batches:
            for part in tokens.steps(batch, "text", shard_bytes):
                more = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
                if held and size + more > shard_bytes:
                    yield from _shard(number, *_columns(held), n_docs, n_terms)
                    number, held, size = number + 1, [], 0
                held.append(part)
                size += more
        if held:
            yield from _shard(number, *_columns(held), n_docs, n_terms)

    return store.saved(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INDEX), "impact-index")


def _columns(parts: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
    whole = pa.Table.from_batches(parts).combine_chunks()
    return tuple(c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in (whole.column("doc_id"), whole.column("text")))


def questions(items: DataFrame) -> DataFrame:
    """(item, item_id, term, times) of questions (item_id, text), written; item is a number of the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, code, row, tf = _postings(batch.column("text"))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("item").take(at), batch.column("item_id").take(at), terms.take(pa.array(code)), pa.array(tf)], ["item", "item_id", "term", "times"])

    numbered = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long"), "text")
    return store.saved(numbered.mapInArrow(run, "item long, item_id long, term string, times long"), "ranked-questions")


def weights(index: DataFrame, asked: DataFrame, n_docs: int) -> DataFrame:
    """(term, w) of the questions' terms that documents have, written."""
    wanted = asked.select("term").distinct()
    df = index.where("term is not null").select("term", "df").join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    w = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    return store.saved(df.select("term", w.alias("w")), "term-weights")


class Block:
    """A block of questions: terms by number, their weights, and the questions' terms with their repeats."""

    def __init__(self, rows: pa.Table):
        coded = rows.column("term").combine_chunks().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        self.terms = {t: i for i, t in enumerate(coded.dictionary.to_pylist())}
        item = rows.column("item").to_numpy()
        order = np.argsort(item, kind="stable")
        self.code = coded.indices.to_numpy(zero_copy_only=False)[order]
        self.factor = (rows.column("w").to_numpy() * rows.column("times").to_numpy())[order]
        self.bounds = words.starts(item[order])
        self.items = item[order][self.bounds[:-1]] if len(item) else item
        ids = rows.column("item_id").to_pylist()
        self.names = [ids[order[at]] for at in self.bounds[:-1]]


def best(groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int, k: int, first: int = ROUND) -> tuple[np.ndarray, np.ndarray]:
    """The k documents (of n, by number) with the highest sums, more if the k-th ties, and their sums. groups: of
    each term the impacts, falling, where each group's documents start in docs, with the end, and docs."""
    sums = np.zeros(n, np.int64)
    gain = np.concatenate([g[0] for g in groups])
    slot = np.repeat(np.arange(len(groups)), [len(g[0]) for g in groups])
    base = np.cumsum([0, *[len(g[2]) for g in groups]])
    docs = np.concatenate([g[2] for g in groups])
    lo = np.concatenate([g[1][:-1] + b for g, b in zip(groups, base)])
    size = np.concatenate([np.diff(g[1]) for g in groups])
    order = np.argsort(-gain, kind="stable")
    gain, slot, lo, size = gain[order], slot[order], lo[order], size[order]
    ends = np.cumsum(size)

    def posted(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of the groups from a to b."""
        many = size[a:b]
        at = np.repeat(lo[a:b] - (ends[a:b] - many), many) + np.arange(ends[a - 1] if a else 0, ends[b - 1])
        return docs[at], np.repeat(gain[a:b], many)

    done, step = 0, first
    while done < len(gain):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + step, "right")))
        np.add.at(sums, *posted(done, upto))
        done, step = upto, step * 2
        if done < len(gain) and n > k:
            # of each term the greatest impact that is left; a term's groups come in order
            left, at = np.unique(slot[done:], return_index=True)
            rest = int(gain[done:][at].sum())
            reach = np.partition(sums, n - k)[n - k] - rest
            if reach > 0 and np.count_nonzero(sums >= reach) <= k:
                break
    if done < len(gain):
        chosen = np.flatnonzero(sums >= reach)
        mine = np.zeros(n, bool)
        mine[chosen] = True
        doc, more = posted(done, len(gain))
        keep = mine[doc]
        np.add.at(sums, doc[keep], more[keep])
    else:
        kth = np.partition(sums, n - k)[n - k] if n > k else 1
        chosen = np.flatnonzero(sums >= max(1, kth))
    return chosen, sums[chosen]


FOUND = "item long, item_id long, doc_id long, score long"


def search(index: DataFrame, asked: DataFrame, weight: DataFrame, k: int = 20, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item, item_id, rank, doc_id, score): the k best documents of each question of questions()."""
    spark = index.sparkSession
    blocks = -(-asked.count() // block_terms)
    path = store.new_path(spark, "ranked")
    for b in range(max(1, blocks)):
        mine = asked.where(F.pmod(F.xxhash64("item"), F.lit(max(1, blocks))) == b).join(weight, "term")
        sent = spark.sparkContext.broadcast(Block(mine.toArrow()))
        mine_terms = mine.select("term").distinct()

        def run(table: pa.Table) -> pa.Table:
            block = sent.value
            names = table.column("term").to_pylist()
            if None not in names:
                return _none()
            own = names.index(None)
            ids, _ = words.numbers(table.column("docs").slice(own, 1), np.int64)
            known, _ = words.numbers(table.column("impacts").slice(own, 1), np.uint8)
            rows = [i for i, t in enumerate(names) if t is not None]
            held = table.take(pa.array(rows, pa.int64()))
            gains, gain_at = words.numbers(held.column("impacts"), np.uint32)
            sizes, _ = words.numbers(held.column("sizes"), np.uint32)
            docs, doc_at = words.numbers(held.column("docs"), np.uint32)
            place = {names[i]: r for r, i in enumerate(rows)}
            gains, inner = gains.astype(np.int64), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            at = np.full(len(block.terms), -1)
            for t, j in block.terms.items():
                at[j] = place.get(t, -1)
            out = []
            # documents without an id come last among equals
            rank_key = np.where(known.astype(bool), ids, np.iinfo(np.int64).max)
            for q in range(len(block.items)):
                s, e = block.bounds[q], block.bounds[q + 1]
                groups = []
                for j, factor in zip(at[block.code[s:e]].tolist(), block.factor[s:e].tolist()):
                    if j >= 0 and factor > 0:
                        a, z = gain_at[j], gain_at[j + 1]
                        groups.append((gains[a:z] * factor, inner[a : z + 1] - inner[a], docs[doc_at[j] : doc_at[j + 1]]))
                if groups:
                    chosen, score = best(groups, len(ids), k)
                    order = np.lexsort((rank_key[chosen], -score))[:k]
                    out.append((np.full(len(order), q), chosen[order], score[order]))
            if not out:
                return _none()
            q, doc, score = (np.concatenate(x) for x in zip(*out))
            doc_ids = pa.array(ids[doc], mask=~known[doc].astype(bool))
            return pa.table([pa.array(block.items[q]), pa.array([block.names[i] for i in q.tolist()], pa.int64()), doc_ids, pa.array(score)], ["item", "item_id", "doc_id", "score"])

        hits = index.where("term is not null").join(mine_terms, "term", "left_semi").select(index.columns)
        found = hits.unionAll(index.where("term is null")).groupBy("shard").applyInArrow(run, FOUND)
        found.write.mode("append").parquet(path)
    best_first = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    merged = spark.read.schema(FOUND).parquet(path).withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    return merged.select("item", "item_id", "rank", "doc_id", "score")


def _none() -> pa.Table:
    return pa.table([pa.array([], pa.int64())] * 4, ["item", "item_id", "doc_id", "score"])


def ranked(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents (doc_id, text) for each question (item_id, text)."""
    n_docs, n_terms = collection(docs)
    index = write_index(docs, n_docs, n_terms)
    asked = questions(items)
    return search(index, asked, weights(index, asked, n_docs), k).drop("item")
