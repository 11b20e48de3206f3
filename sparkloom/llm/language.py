"""Language identification of whole texts, by Viterbi decoding over words.

A word's script narrows its candidate languages to those seen in that script; a naive Bayes model over hashed
byte trigrams scores the word in each candidate; the best path over all words of a text, with a penalty for
each switch, labels spans. A document's language is the one whose spans have most letters, its score their
share of all letters.

The model is fitted on a bounded sample of labelled rows (SAMPLE documents of a language in expectation, drawn
by a hash); every row is labelled. What is broadcast is one table of FEATURES rows by the number of languages.

Defined results: texts that are null or have no letter are `und` with score 0 and no spans; without any
labelled row all texts are `und`; rows without label aren't learned from; ties go to the first language by
name; repeated rows get equal results; an empty table gives an empty table; letters are code points. Decoding takes
a step per word of the longest text of a batch: a text of ten million words some minutes of its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.shipping import ship

from . import tokens
from . import words as words_

FEATURES = 1 << 16
#: Labelled documents per language that are learned from, in expectation.
SAMPLE = 3000
#: Labels that are learned at most, the commonest ones.
MOST_LANGUAGES = 256
#: Cost of a switch of language between neighbouring words, in nats.
SWITCH = 12.0
#: Share of a language's sampled words that a script needs to count as one of its scripts.
SCRIPT_SHARE = 0.01
STEP_BYTES = 4 << 20
#: First code points of ranges, and the script from there on. 0: none in particular.
SCRIPTS = [
    (0x0, 1), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x780, 0), (0x900, 7), (0x980, 8), (0xA00, 0), (0xB80, 9), (0xC00, 0),
    (0xE00, 10), (0xE80, 0), (0x10A0, 11), (0x1100, 12), (0x1200, 13), (0x13A0, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x2C60, 1), (0x2C80, 0),
    (0x3040, 14), (0x3100, 0), (0x3400, 15), (0xA000, 0), (0xA720, 1), (0xA800, 0), (0xAC00, 12), (0xD7B0, 0), (0xF900, 15), (0xFB00, 1), (0xFB1D, 5), (0xFB50, 6), (0xFE00, 0), (0x20000, 15), (0x30000, 0),
]
SCRIPT_STARTS = np.array([s for s, _ in SCRIPTS])
SCRIPT_IDS = np.array([i for _, i in SCRIPTS])
N_SCRIPTS = 16


@dataclass
class Model:
    languages: list[str]
    #: [feature, language]: log probability, less its mean over the languages
    scores: np.ndarray
    #: [script, language]: whether the language is a candidate
    candidates: np.ndarray


@dataclass
class Words:
    """The letter runs of texts, lower-cased: the distinct ones, and for each text the run of them."""

    names: pa.Array
    at: np.ndarray
    offsets: np.ndarray


def words_of(texts: pa.Array) -> Words:
    lowered = pc.utf8_lower(pc.fill_null(texts, ""))
    found = pc.ascii_split_whitespace(pc.replace_substring_regex(lowered, "[^\\pL]+", " "))
    offsets = found.offsets.to_numpy().astype(np.int64)
    values = found.values.slice(offsets[0], offsets[-1] - offsets[0])
    real = pc.not_equal(values, "")
    kept = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    coded = values.filter(real).dictionary_encode()
    return Words(coded.dictionary.cast(pa.string()), coded.indices.to_numpy(), kept[offsets - offsets[0]])


def features(names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed byte trigrams of words, their edges marked; each word's first; how many it has; scripts."""
    offsets = np.frombuffer(names.buffers()[1], np.int32, len(names) + 1, 4 * names.offset).astype(np.int64)
    raw = np.frombuffer(names.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    # one mark before each word and one after all: a word of n bytes has n trigrams around its bytes
    starts = offsets[:-1] - offsets[0]
    marked = np.zeros(len(raw) + len(sizes) + 1, np.uint64)
    marked[np.arange(len(raw)) + np.repeat(np.arange(len(sizes)), sizes) + 1] = raw
    grams = marked[:-2] << np.uint64(16) | marked[1:-1] << np.uint64(8) | marked[2:]
    inner = np.ones(len(grams), bool)
    inner[(starts + np.arange(len(sizes)))[1:] - 1] = False
    hashed = (grams[inner] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64)
    pad = np.concatenate([raw, np.zeros(4, np.uint8)]).astype(np.int64)
    b0, b1, b2, b3 = (pad[starts + i] for i in range(4))
    point = np.select([b0 < 0x80, b0 < 0xE0, b0 < 0xF0], [b0, (b0 & 31) << 6 | b1 & 63, (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63], (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | b3 & 63)
    scripts = SCRIPT_IDS[np.searchsorted(SCRIPT_STARTS, point, side="right") - 1]
    return hashed, starts, sizes, scripts


def learning_rows(docs: DataFrame) -> DataFrame:
    """Labelled documents that may be learned from: crc32(doc_id) mod 3 is not 1."""
    return docs.where("lang is not null and text is not null and crc32(cast(doc_id as string)) % 3 <> 1")


def fit(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of labelled rows (doc_id, text, lang)."""
    ship(rows.sparkSession)
    # the commonest labels alone: a column of anything else must not fill the driver
    common = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES)
    counts = {r["lang"]: r["count"] for r in common.collect()}
    rows = rows.where(F.col("lang").isin(list(counts)))
    languages = sorted(counts)
    n = len(languages)
    if not n:
        return Model([], np.zeros((FEATURES, 0), np.float32), np.zeros((N_SCRIPTS, 0), bool))
    share = F.element_at(F.create_map(*[x for k, v in counts.items() for x in (F.lit(k), F.lit(min(1.0, sample / v)))]), F.col("lang"))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) < share * float(1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + N_SCRIPTS, n), np.int64)
        for batch in batches:
            for part in tokens.steps(batch, "text", STEP_BYTES):
                lang = np.array([languages.index(x) for x in part.column("lang").to_pylist()], np.int64)
                words = words_of(part.column("text"))
                if not len(words.names):
                    continue
                hashed, starts, sizes, scripts = features(words.names)
                often = np.zeros((len(words.names), n), np.int64)
                np.add.at(often, (words.at, np.repeat(lang, np.diff(words.offsets))), 1)
                np.add.at(total, hashed, np.repeat(often, sizes, axis=0))
                np.add.at(total, FEATURES + scripts, often)
        f, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), pa.array(k, pa.int32()), pa.array(total[f, k], pa.int64())], ["feature", "k", "n"])

    found = drawn.select("text", "lang").mapInArrow(words_.tidied(count), "feature int, k int, n long").groupBy("feature", "k").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros((FEATURES + N_SCRIPTS, n))
    total[found.feature.to_numpy(int), found.k.to_numpy(int)] = found.n
    grams, scripts = total[:FEATURES] + 0.1, total[FEATURES:]
    log = np.log(grams / grams.sum(axis=0))
    candidates = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
    return Model(languages, (log - log.mean(axis=1, keepdims=True)).astype(np.float32), candidates)


def word_scores(names: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """[word, language] scores, and the words' letters."""
    hashed, starts, _, scripts = features(names)
    scores = np.add.reduceat(model.scores[hashed], starts, axis=0)
    allowed = model.candidates[scripts]
    # a script that no language has leaves all of them
    allowed |= ~allowed.any(axis=1, keepdims=True)
    return np.where(allowed, scores, np.float32(-1e4)), pc.utf8_length(names).to_numpy().astype(np.int64)


def viterbi(scores: np.ndarray, offsets: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word: all texts take a step together, the long ones go on."""
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    first, sizes = offsets[:-1][order], sizes[order]
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(1, steps + 1), side="right")
    n = scores.shape[1]
    stay = np.zeros((len(scores), n), bool)
    best = np.zeros(len(scores), np.uint16)
    value = np.zeros((len(sizes), n), np.float32)
    for t in range(steps):
        k = active[t]
        at, v = first[:k] + t, value[:k]
        top = v.argmax(axis=1)
        limit = v[np.arange(k), top, None]
        keeps = v >= limit - switch
        stay[at], best[at] = keeps, top
        value[:k] = scores[at] + np.where(keeps, v, limit - switch) - limit
    labels = np.zeros(len(scores), np.uint16)
    state = value.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at, s = first[:k] + t, state[:k]
        labels[at] = s
        state[:k] = np.where(stay[at, s], s, best[at])
    return labels


SPANS = "array<struct<first:int,last:int,lang:string>>"


def identified(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """row (all columns of docs, as a struct), lang_pred, score, and spans: runs of letter words, numbered from
    0, with their language."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    # a step holds a number for each word and language
    step = max(1 << 18, STEP_BYTES * 8 // max(8, len(model.languages)))
    names = np.array([*model.languages, "und"], object)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = held.value
        n = len(model.languages)
        for batch in batches:
            for part in tokens.steps(pa.RecordBatch.from_arrays([batch], ["text"]), "text", step):
                words = words_of(part.column("text"))
                docs_n = part.num_rows
                pred, score = np.full(docs_n, n), np.zeros(docs_n)
                spans = pa.array([[]] * docs_n, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())])))
                if n and len(words.names):
                    scores, letters_of = word_scores(words.names, model)
                    labels = viterbi(scores[words.at], words.offsets, switch)
                    doc = np.repeat(np.arange(docs_n), np.diff(words.offsets))
                    letters = np.bincount(doc * n + labels, letters_of[words.at], docs_n * n).reshape(docs_n, n)
                    whole = letters.sum(axis=1)
                    some = whole > 0
                    pred[some] = letters.argmax(axis=1)[some]
                    score[some] = letters.max(axis=1)[some] / whole[some]
                    starts = np.flatnonzero(np.concatenate([[True], (np.diff(labels) != 0) | (np.diff(doc) != 0)]))
                    ends = np.concatenate([starts[1:], [len(labels)]]) - 1
                    base = words.offsets[doc[starts]]
                    columns = [pa.array(starts - base, pa.int32()), pa.array(ends - base, pa.int32()), pa.array(names[labels[starts]], pa.string())]
                    bounds = np.searchsorted(doc[starts], np.arange(docs_n + 1))
                    spans = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(columns, ["first", "last", "lang"]))
                yield pa.StructArray.from_arrays([pa.array(names[pred], pa.string()), pa.array(score), spans], ["lang_pred", "score", "spans"])

    @F.arrow_udf(f"lang_pred string, score double, spans {SPANS}")
    def found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from words_.tidied(run)(texts)

    # rows wait in Spark: workers get texts alone and give none back. A filter on the result must not run it twice
    held_rows = docs.select(F.struct("*").alias("row"), found.asNondeterministic()("text").alias("found"))
    return held_rows.select("row", "found.lang_pred", "found.score", "found.spans")


def kept(docs: DataFrame, least: float = 0.4, sample: int = SAMPLE) -> DataFrame:
    """The documents, their columns as they were, that have a language: those without letters and those of
    which no language has at least this share are rejected."""
    found = identified(docs, fit(learning_rows(docs), sample))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")
