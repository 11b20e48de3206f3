"""Many questions at once, and models that workers load once.

Questions go in blocks of BLOCK_BYTES to all tasks, where Arrow batches of nodes are multiplied with them; a task keeps
the k best of each question, and a window merges the tasks'. Models are loaded once in a worker and get batches; a
batch that fails is asked text by text, and a text that fails alone has no result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.sources import versions

#: Bytes of question vectors that are collected and broadcast at a time.
BLOCK_BYTES = 8 << 20
#: Slack of products of matrices against sums in order.
SLACK = 1e-9


def _cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines row by row, summed in order of the components; 0 if a norm is 0."""
    dot, xx, qq = (np.zeros(len(x)) for _ in range(3))
    for d in range(x.shape[1]):
        a, b = x[:, d].astype(float), q[:, d].astype(float)
        dot += a * b
        xx += a * a
        qq += b * b
    norm = np.sqrt(xx) * np.sqrt(qq)
    return np.divide(dot, norm, out=np.zeros(len(x)), where=norm > 0)


class Heaps:
    """The k best (score, id) of each of some questions."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.question, self.ids, self.score = np.zeros(0, int), np.zeros(0, int), np.zeros(0)

    def add(self, question: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        q, i, s = np.concatenate([self.question, question]), np.concatenate([self.ids, ids]), np.concatenate([self.score, score])
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        first = np.searchsorted(q, q)
        keep = np.arange(len(q)) - first < self.k
        self.question, self.ids, self.score = q[keep], i[keep], s[keep]
        full = np.arange(len(q)) - first == self.k - 1
        self.least[q[full]] = s[full]


def nearest(nodes: DataFrame, questions: DataFrame, k: int, node: str = "node_id", question: str = "question_id", vector: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(question_id, rank, node_id, score): for each question (a long id, embedding) the k nodes (a long id, embedding)
    nearest by cosine; equal scores by rising id. Null vectors, and those of another length, take no part."""
    spark = nodes.sparkSession
    asked = questions.select(F.col(question).cast("long").alias("q"), F.col(vector).alias("v")).where("q is not null and v is not null and size(v) > 0")
    size = asked.agg(F.sum(F.size("v").cast("long") * 8)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    path = versions.new_path(spark, "many-nearest")
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).toArrow().combine_chunks()
        names, by_dim = np.array(mine.column("q").to_pylist(), int), {}
        vectors = mine.column("v").to_pylist()
        for dim in {len(v) for v in vectors}:
            at = [i for i, v in enumerate(vectors) if len(v) == dim]
            by_dim[dim] = (np.array(at), np.array([vectors[i] for i in at], float))
        sent = spark.sparkContext.broadcast((names, by_dim))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, by_dim = sent.value
            heaps = Heaps(len(names), k)
            for batch in batches:
                column = batch.column("v")
                offsets, flat, ids = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False), batch.column("i").to_numpy()
                sizes = np.diff(offsets)
                for dim in np.unique(sizes).tolist():
                    if dim not in by_dim:
                        continue
                    at, q = by_dim[dim]
                    rows = np.flatnonzero(sizes == dim)
                    x = flat[offsets[rows][:, None] + np.arange(dim)].astype(float)
                    unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)
                    scores = unit(q) @ unit(x).T
                    least = heaps.least[at]
                    if len(rows) > k:
                        least = np.maximum(least, np.partition(scores, len(rows) - k, 1)[:, len(rows) - k])
                    a, r = np.nonzero(scores >= (least - SLACK)[:, None])
                    heaps.add(at[a], ids[rows[r]], _cosines(x[r], q[a]))
            yield pa.RecordBatch.from_arrays([pa.array(names[heaps.question], pa.int64()), pa.array(heaps.ids, pa.int64()), pa.array(heaps.score, pa.float64())], ["q", "i", "s"])

        held = nodes.select(F.col(node).cast("long").alias("i"), F.col(vector).alias("v")).where("i is not null and v is not null")
        held.mapInArrow(run, "q long, i long, s double").write.mode("append").parquet(path)
    order = Window.partitionBy("q").orderBy(F.desc("s"), "i")
    found = spark.read.schema("q long, i long, s double").parquet(path).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select(F.col("q").alias(question), "rank", F.col("i").alias(node), F.col("s").alias("score"))


_loaded: dict[str, object] = {}


def _model(key: str, load: Callable[[], object]):
    """The worker's model of a key, loaded on first use."""
    if key not in _loaded:
        _loaded[key] = load()
    return _loaded[key]


def _answers(model: Callable[[list], list], items: list) -> list:
    """What a model says of items; None where it fails for an item alone, and for items that are None."""
    real = [i for i, x in enumerate(items) if x is not None]
    out: list = [None] * len(items)
    try:
        found = list(model([items[i] for i in real])) if real else []
        if len(found) != len(real):
            raise ValueError(f"{len(found)} results for {len(real)} items")
        for i, v in zip(real, found):
            out[i] = v
    except Exception:  # noqa: BLE001  one item must not lose the batch
        for i in real:
            try:
                out[i] = list(model([items[i]]))[0]
            except Exception:  # noqa: BLE001
                continue
    return out


def embedding(text: Column | str, load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Column:
    """The embedding of a text by a model that load gives: a function of a list of texts."""
    key = uuid.uuid4().hex

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _model(key, load)
        for texts in parts:
            yield pd.Series([None if v is None else [float(x) for x in v] for v in _answers(model, texts.tolist())], dtype=object)

    return run(text)


def pair_score(question: Column, text: Column, load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]) -> Column:
    """The score of (question, text) by a model that load gives: a function of a list of pairs. Null without a text."""
    key = uuid.uuid4().hex

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = _model(key, load)
        for questions, texts in parts:
            pairs = [None if t is None else (q, t) for q, t in zip(questions.tolist(), texts.tolist())]
            yield pd.Series([None if v is None else float(v) for v in _answers(model, pairs)], dtype=float)

    return run(question, text)


def scorer(load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]) -> Callable[[str], Callable[[Column], Column]]:
    """A scorer for retrieval.rerank() from a model of pairs; a text that has no score comes last."""
    return lambda question: lambda text: F.coalesce(pair_score(F.lit(question), text, load), F.lit(float("-inf")))
