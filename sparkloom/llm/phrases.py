"""Phrase collocations by suffix-sigma: count all phrases of up to max_n words in one shuffle of truncated suffixes.

1. Slices of some MiB of text are cut into pieces and words, each with its own dictionary, and written. The words
   of all dictionaries are counted by (lang, word); words that are frequent enough get a number. Up to SENT_WORDS of
   them are sent to all tasks; more come back to their slices by a join. A phrase with a rare word is rare, so rare words end suffixes.
2. A slice sends, for each place, the numbers of the words from there to the piece's end, max_n at most; equal
   suffixes of a slice are one with a count. They are dealt by their first word (its number stands for language
   and word). A first word that alone would fill more than its part of the buckets is dealt by its second too, and so
   on while words are hot, so no word, pair or passage meets in one task.
3. A bucket sorts its suffixes in falling order, so that what extends a prefix stands before it. The prefixes that
   are open at a place are a stack; whenever the next suffix parts from it, those beyond the common part are closed with
   their counts. The stack is worked out for all places at once: a prefix of length d closes where one of the first
   d words changes, and its count is the sum of the run. Prefixes that hot words spread over buckets are summed up.
4. Parts are joined afterwards: each cut of a candidate finds the counts of its two sides, by hash joins on phrases.

A phrase is dropped for a longer one as frequent; as counts fall with length, it is enough to look at those longer by
one word. Ranks are found in salted parts of a language first.

Defined results: null text is empty, null lang is "und" and together with rows whose lang says so; equal scores
go by count, then by phrase in order of bytes; repeated rows count each; an empty table gives an empty result; other
columns are not read. A row of any length is cut at its pieces, so a task holds a few MiB of it at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store, words

MAX_WORDS, MIN_COUNT, TOP = 5, 100, 2000
#: Ends of pieces, and what stands between words.
TABLE = words.kinds(b" \t", b".,;:!?\n\v\f\r")
STEP_BYTES, SLICE_BYTES = 2 << 20, 16 << 20
#: Places of a slice whose suffixes are sorted at a time.
PART_ROWS = 500_000
#: Words with numbers that are collected and broadcast at most.
SENT_WORDS = 1 << 20
#: Suffixes that a bucket gets about, and the least number of buckets.
BUCKET_ROWS, BUCKETS = 1_000_000, 32
#: Parts in which a language's candidates are ranked first.
SALTS = 16


class _Slice:
    """What a slice has gathered: chunks of codes with their dictionaries."""

    def __init__(self) -> None:
        self.parts: list[pa.DictionaryArray] = []
        self.runs: list[np.ndarray] = []
        self.size = 0

    def add(self, w: words.Words, size: int) -> None:
        self.parts.append(pa.DictionaryArray.from_arrays(pa.array(w.codes, pa.int32()), w.vocabulary))
        # runs of another chunk are others
        self.runs.append(words.starts(w.runs)[1:])
        self.size += size

    def row(self, number: int, lang: str) -> pa.RecordBatch:
        held = pa.chunked_array(self.parts).unify_dictionaries()
        vocabulary = held.chunk(0).dictionary
        codes = [c.indices.to_numpy() for c in held.chunks]
        counts = np.bincount(np.concatenate(codes), minlength=len(vocabulary))
        # the commonest words have the least numbers
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(1, len(order) + 1)
        flat = np.concatenate([np.insert(rank[c], at, np.uint32(0)) for c, at in zip(codes, self.runs)])
        one = np.array([0, len(vocabulary)], np.int32)
        columns = [pa.array([number]), pa.array([lang]), pa.ListArray.from_arrays(one, vocabulary.take(pa.array(order))), pa.ListArray.from_arrays(one, pa.array(counts[order], pa.int64())), pa.array([words.packed(flat)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["slice", "lang", "words", "counts", "codes"])


def slices(docs: DataFrame) -> DataFrame:
    """(slice, lang, words, counts, codes): the words of a slice's texts in one language, written. codes: numbers
    into words from 1, and 0 where a piece ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from . import tokens

        number = TaskContext.get().partitionId() << 32
        open_: dict[str, _Slice] = {}
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                mine = batch.filter(pc.equal(langs.indices, k))
                for part in tokens.steps(mine, "text", STEP_BYTES):
                    for w in words.words(part.column("text"), TABLE, STEP_BYTES):
                        if len(w.codes):
                            open_.setdefault(lang, _Slice()).add(w, w.size)
                        # all that is open, in however many languages, is bounded
                        full = [x for x, s in open_.items() if s.size >= SLICE_BYTES]
                        if sum(s.size for s in open_.values()) >= 2 * SLICE_BYTES:
                            full = full or [max(open_, key=lambda x: open_[x].size)]
                        for x in full:
                            yield open_.pop(x).row(number, x)
                            number += 1
            words.release()
        for lang, held in open_.items():
            yield held.row(number, lang)
            number += 1

    held = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return store.saved(held.mapInArrow(run, "slice long, lang string, words array<string>, counts array<long>, codes binary"), "phrase-slices")


def vocabulary(cut: DataFrame, min_count: int) -> tuple[DataFrame, DataFrame]:
    """(id, lang, word, f) of words that occur min_count times, ids from 1 without gaps, the commonest first, as small
    numbers compress better; (lang, n) of all words."""
    each = cut.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy("lang", F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("f"))
    each = store.saved(each, "phrase-words")
    totals = store.saved(each.groupBy("lang").agg(F.sum("f").alias("n")), "phrase-totals")
    frequent = each.where(F.col("f") >= min_count).orderBy(F.desc("f"), "lang", "word").select(F.monotonically_increasing_id().alias("at"), "lang", "word", "f")
    frequent = store.saved(frequent, "phrase-frequent")
    part = F.shiftright("at", 33)
    # as many rows as tasks wrote the table
    sizes = sorted((r["part"], r["count"]) for r in frequent.groupBy(part.alias("part")).count().collect())
    before = np.cumsum([0, *[n for _, n in sizes]]).tolist()
    if not sizes:
        return frequent.select(F.lit(1).alias("id"), "lang", "word", "f"), totals
    ahead = F.element_at(F.create_map(*[F.lit(x) for (p, _), b in zip(sizes, before) for x in (p, b)]), part)
    return frequent.select((F.col("at").bitwiseAND((1 << 33) - 1) + ahead + 1).cast("long").alias("id"), "lang", "word", "f"), totals


def suffixes(ids: np.ndarray, n: int, start: int = 0, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct suffixes of up to n words that start at the places from start to end of ids and end before the
    next 0, those of two words or more, one row each in falling order, and how often each occurs."""
    held = ids[start : None if end is None else end + n - 1]
    size = len(held) if end is None else min(end - start, len(held))
    padded = np.concatenate([held, np.zeros(n, ids.dtype)])
    rows = np.empty((size, n), ids.dtype)
    open_ = np.ones(size, bool)
    for k in range(n):
        rows[:, k] = np.where(open_, padded[k : k + size], 0)
        open_ = rows[:, k] != 0
    return combined(rows[(rows[:, 0] != 0) & (rows[:, 1] != 0)])


def _falling(rows: np.ndarray) -> np.ndarray:
    """The order that sorts rows of 32-bit numbers from the greatest to the least."""
    n = rows.shape[1]
    keys = [rows[:, k].astype(np.uint64) << np.uint64(32) | (rows[:, k + 1] if k + 1 < n else np.uint64(0)) for k in range(0, n, 2)]
    return np.lexsort([~k for k in reversed(keys)])


def combined(rows: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in falling order, with the sums of their counts."""
    order = _falling(rows)
    rows = rows[order]
    at = words.starts(*rows.T)
    total = np.diff(at) if counts is None else np.add.reduceat(counts[order], at[:-1]) if len(rows) else np.zeros(0)
    return rows[at[:-1]], total.astype(np.int64)


def closed(rows: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(d, first rows, counts) of the prefixes of each length d from 2 of distinct rows in falling order: of the
    stack of open prefixes, the one of length d is closed where one of the first d words changes."""
    for d in range(2, rows.shape[1] + 1):
        at = words.starts(*rows.T[:d])
        if not len(rows):
            continue
        total = np.add.reduceat(counts, at[:-1])
        real = rows[at[:-1], d - 1] != 0
        yield d, at[:-1][real], total[real]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def depth(rows: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """How many words a suffix is dealt by: up to the first that isn't hot, or all of them."""
    heat = np.isin(rows, hot) & (rows != 0)
    return np.minimum(np.argmin(np.column_stack([heat, np.zeros(len(rows), bool)]), 1) + 1, rows.shape[1])


def counted(cut: DataFrame, known: DataFrame, total: int, max_n: int, min_count: int) -> DataFrame:
    """(ids, a): phrases of two words or more that occur min_count times, with their counts, written."""
    buckets = max(BUCKETS, -(-total // BUCKET_ROWS))
    # a word is hot when it has more than a bucket's part of all words: fewer of them than buckets
    hot = np.array([r["id"] for r in known.where(F.col("f") > total // buckets).select("id").collect()], np.uint32)
    names = ["bucket", "counts", *[f"w{d}" for d in range(max_n)]]

    def dealt(ids: np.ndarray) -> pa.Table:
        """What a slice sends: by bucket the columns of its distinct suffixes."""
        out = [pa.table([pa.array([], pa.int32()), *[pa.array([], pa.binary())] * (max_n + 1)], names)]
        for start in range(0, len(ids), PART_ROWS):
            rows, counts = suffixes(ids, max_n, start, start + PART_ROWS)
            deep = depth(rows, hot)
            key = np.zeros(len(rows), np.uint64)
            for d in range(max_n):
                key = np.where(d < deep, _mixed(key + rows[:, d] + np.uint64(1)), key)
            bucket = (_mixed(key) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            at = words.starts(bucket[order])
            # by columns of words, not rows: they compress better
            columns = [counts[order].astype(np.uint32), *rows[order].T]
            whole = [pa.array([words.packed(c[s:e]) for s, e in zip(at[:-1], at[1:])], pa.binary()) for c in columns]
            out.append(pa.table([pa.array(bucket[order][at[:-1]], pa.int32()), *whole], names))
        words.release()
        return pa.concat_tables(out)

    schema = f"bucket int, counts binary, {', '.join(f'w{d} binary' for d in range(max_n))}"
    if known.count() <= SENT_WORDS:
        table = known.select("lang", "word", "id").toArrow()
        by_lang = {lang: table.filter(pc.equal(table.column("lang"), lang)) for lang in pc.unique(table.column("lang")).to_pylist()}
        vocabularies = cut.sparkSession.sparkContext.broadcast({lang: (t.column("word").combine_chunks(), t.column("id").to_numpy()) for lang, t in by_lang.items()})

        def send_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    row = batch.slice(at, 1)
                    if row.column("lang")[0].as_py() in vocabularies.value:
                        vocabulary, numbers = vocabularies.value[row.column("lang")[0].as_py()]
                        place = pc.fill_null(pc.index_in(row.column("words").flatten(), vocabulary), len(vocabulary)).to_numpy()
                        ids = np.append(numbers, 0).astype(np.uint32)[place]
                        yield from dealt(np.append(np.uint32(0), ids)[words.unpacked(row.column("codes")[0].as_py())]).to_batches()

        sent = cut.select("lang", "words", "codes").mapInArrow(send_all, schema)
    else:
        named = cut.select("slice", "lang", F.posexplode("words").alias("code", "word")).join(known.select("id", "lang", "word"), ["lang", "word"]).select("slice", "code", "id")
        named = store.saved(named, "phrase-numbers")

        def send(mine: pa.Table, numbers: pa.Table) -> pa.Table:
            if not mine.num_rows or not numbers.num_rows:
                return dealt(np.zeros(0, np.uint32))
            codes = words.unpacked(mine.column("codes")[0].as_py())
            ids = np.zeros(int(codes.max()) + 1, np.uint32)
            ids[numbers.column("code").to_numpy() + 1] = numbers.column("id").to_numpy()
            return dealt(ids[codes])

        sent = cut.select("slice", "codes").groupBy("slice").cogroup(named.groupBy("slice")).applyInArrow(send, schema)

    def close(table: pa.Table) -> pa.Table:
        columns = [np.concatenate([words.unpacked(x) for x in table.column(c).to_pylist()]) for c in names[1:]]
        rows, counts = combined(np.stack(columns[1:], 1), columns[0].astype(np.int64))
        del columns
        out, sizes, totals = [], [], []
        for d, at, n in closed(rows, counts):
            # complete unless all its words are hot, as then other buckets may have some of it
            keep = (n >= min_count) | np.isin(rows[at, :d], hot).all(1)
            out.append(rows[at[keep], :d].ravel())
            sizes.append(np.full(int(keep.sum()), d))
            totals.append(n[keep])
        ids = np.concatenate(out) if out else np.zeros(0, np.uint32)
        ends = np.cumsum(np.concatenate([[0], *sizes])).astype(np.int32)
        words.release()
        return pa.table([pa.ListArray.from_arrays(ends, pa.array(ids, pa.int64())), pa.array(np.concatenate(totals) if totals else [], pa.int64())], ["ids", "a"])

    found = sent.groupBy("bucket").applyInArrow(close, "ids array<long>, a long")
    whole = found.groupBy("ids").agg(F.sum("a").alias("a")).where(F.col("a") >= min_count)
    return store.saved(whole, "phrase-counts")


def scored(found: DataFrame, known: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates (ids, lang, a, l, r, n, score): by their lowest-scoring cut, of these the first."""
    one = known.select(F.array("id").alias("part"), F.col("f").alias("count"))
    counts = store.saved(found.select(F.col("ids").alias("part"), F.col("a").alias("count")).unionByName(one), "phrase-parts")
    langs = known.select(F.col("id").alias("first"), "lang").join(totals, "lang")
    held = found.join(langs, found["ids"][0] == langs["first"]).drop("first")
    size = F.size("ids")
    cuts = held.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("ids", F.lit(1), F.col("k")), "right": F.slice("ids", F.col("k") + 1, size - F.col("k"))})
    cuts = cuts.join(counts.select(F.col("part").alias("left"), F.col("count").alias("l")), "left").join(counts.select(F.col("part").alias("right"), F.col("count").alias("r")), "right")
    # counts are below 10^17, so products have 38 digits at most
    score = F.expr("(cast(a as decimal(17,0)) * cast(n as decimal(17,0)) * 1000BD) div (cast(l as decimal(17,0)) * cast(r as decimal(17,0)))")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    return cuts.groupBy("ids", "lang", "a", "n").agg(best.alias("b")).select("ids", "lang", "a", "b.l", "b.r", "n", "b.score")


def maximal(candidates: DataFrame) -> DataFrame:
    """Candidates but those within one that is longer by a word and as frequent."""
    n = F.size("ids")
    sides = F.array(F.slice("ids", F.lit(1), n - 1), F.slice("ids", F.lit(2), n - 1))
    longer = candidates.where(n > 2).select(F.explode(sides).alias("ids"), F.col("a").alias("outer"))
    most = longer.groupBy("ids").agg(F.max("outer").alias("outer"))
    return candidates.join(most, "ids", "left").where(F.col("outer").isNull() | (F.col("outer") < F.col("a"))).drop("outer")


def phrases_of(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """candidates with their words, joined by spaces."""
    each = candidates.select("ids", F.posexplode("ids").alias("at", "id")).join(known.select("id", "word"), "id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    return candidates.join(each.groupBy("ids").agg(text.alias("phrase")), "ids")


def top(candidates: DataFrame, n: int = TOP) -> DataFrame:
    """The first n of each language by score, count and phrase, with their rank from 1; first in parts."""
    order: list[Column] = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = candidates.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= n)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= n).drop("part")


def collocations(docs: DataFrame, max_n: int = MAX_WORDS, min_count: int = MIN_COUNT, n: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases of documents (text, lang)."""
    cut = slices(docs)
    known, totals = vocabulary(cut, min_count)
    known = store.saved(known, "phrase-ids")
    total = totals.agg(F.sum("n")).first()[0] or 0
    found = counted(cut, known, total, max_n, min_count)
    best = store.saved(maximal(scored(found, known, totals)), "phrase-candidates")
    return top(phrases_of(best, known), n).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
