"""Questions in blocks, models in workers, maps, exact splits, results compared in one pass, trees."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import maps
from sparkloom.operators import evaluation, many, retrieval, trees
from sparkloom.sources.tables import views


def test_many_questions_equal_one_by_one(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(300)] + [(400 + i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(20)] + [(500, None), (501, [0.0] * 5), (502, [1.0, 2.0])]
    nodes = spark.createDataFrame(rows, "node_id long, embedding array<double>").repartition(3)
    asked = [(7, rows[7][1]), (8, rows[300][1]), (9, None), (10, [0.0] * 5), (None, rows[3][1]), (11, [1.0, 1.0])]
    found = many.nearest(nodes, spark.createDataFrame(asked, "question_id long, embedding array<double>"), 4, block_bytes=60)
    got = {}
    for r in found.orderBy("question_id", "rank").collect():
        got.setdefault(r["question_id"], []).append((r["node_id"], round(r["score"], 9)))
    alone = lambda v, n: [(r[0], round(r[1], 9)) for r in retrieval.dense(nodes.where(F.size("embedding") == n), v, 4).collect()]
    assert got == {7: alone(rows[7][1], 5), 8: alone(rows[300][1], 5), 10: alone([0.0] * 5, 5), 11: alone([1.0, 1.0], 2)}
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and many.nearest(nodes, spark.createDataFrame([], "question_id long, embedding array<double>"), 4).collect() == []


class Counting:
    """A model that writes down each load and each batch."""

    def __init__(self, path):
        self.path = path
        self.note("load")

    def note(self, what):
        with open(self.path, "a") as f:
            f.write(what + "\n")

    def __call__(self, texts):
        self.note(f"call {len(texts)}")
        if any("bad" in str(t) for t in texts):
            raise ValueError("bad")
        return [[float(len(t)), 1.0] for t in texts] if isinstance(texts[0], str) else [float(len(t)) for _, t in texts]


def test_models_load_once_and_take_batches(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.createDataFrame([(i, None if i == 5 else "x" * i) for i in range(40)], "i int, t string").coalesce(1)
    got = {r["i"]: r["v"] for r in df.select("i", many.embedding("t", lambda: Counting(path)).alias("v")).collect()}
    assert got[3] == [3.0, 1.0] and got[5] is None and len(got) == 40
    assert (tmp_path / "log").read_text().splitlines() == ["load", "call 39"]


def test_a_failing_batch_is_asked_one_by_one(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "ccc")], "i int, t string").coalesce(1)
    got = {r["i"]: r["v"] for r in df.select("i", many.pair_score(F.lit("q"), F.col("t"), lambda: Counting(path)).alias("v")).collect()}
    assert got == {1: 1.0, 2: None, 3: 3.0}
    assert (tmp_path / "log").read_text().splitlines() == ["load", "call 3", "call 1", "call 1", "call 1"]
    nodes = df.select(F.col("i").alias("node_id"), F.col("t").alias("text"))
    best = retrieval.rerank(nodes, nodes, many.scorer(lambda: Counting(path))("q"), 3)
    assert [r["node_id"] for r in best.collect()] == [3, 1, 2]


def test_maps(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("a", "y", 1), ("b", None, 1)], "g string, k string, h int")
    held = maps.counters(df, ["g"], "k")
    assert {r["g"]: r["counts"] for r in held.collect()} == {"a": {"x": 2, "y": 1}, "b": {"": 1}}
    c = F.col("counts")
    got = held.select("g", maps.lookup(c, "x", 0), maps.text(maps.merged(c, F.create_map(F.lit("x"), F.lit(5).cast("long")))), maps.text(maps.merged(c, F.lit(None).cast("map<string,long>"))), maps.lookup(F.lit(None).cast("map<string,long>"), "x", -1))
    assert {tuple(r) for r in got.collect()} == {("a", 2, "x:7,y:1", "x:2,y:1", -1), ("b", 0, ":1,x:5", ":1", -1)}
    two = maps.nested(maps.counters(df, ["g", "h"], "k"), "g", "h")
    assert {r["g"]: r["counts"] for r in two.collect()}["a"] == {"1": {"x": 1, "y": 1}, "2": {"x": 1}}
    assert maps.counters(df.limit(0), ["g"], "k").count() == 0


@pytest.mark.parametrize("few", [4, 4096])
def test_split_equals_a_window(spark, monkeypatch, few):
    monkeypatch.setattr(evaluation, "FEW_ROWS", few)
    monkeypatch.setattr(evaluation, "ROUND_BITS", 7)
    r = random.Random(2)
    rows = [(i, r.choice(["a", "a", "a", "b", None, "c"]), "x") for i in range(400)] + [(999, "d", "y")] + [(7, "e", "twin")] * 11 + [(7, "e", t) for t in "uvw"]
    df = spark.createDataFrame(rows, "id long, s string, part_ string").repartition(3)
    split = evaluation.stratified_split(df, "s", "id")
    assert split.columns == ["id", "s", "part_", "part"] and "Window" not in split._jdf.queryExecution().toString()
    per = Window.partitionBy("s")
    order = per.orderBy(evaluation._hash(F.col("id"), 42), F.to_json(F.struct(F.col("id").alias("k"), F.struct("id", "s", "part_").alias("row")), {"ignoreNullFields": "false"}))
    want = df.withColumn("part", F.when(F.row_number().over(order) <= F.ceil(F.count("*").over(per) * 0.2), "test").otherwise("pool"))
    assert sorted(map(str, split.collect())) == sorted(map(str, want.collect()))
    assert evaluation.stratified_split(df.limit(0), "s", "id").count() == 0


def test_results_compared_in_one_pass(spark):
    sql = spark.sql
    same = lambda a, b, **k: evaluation.same_rows(sql(a), sql(b), **k)
    assert same("SELECT 1 AS x, NULL AS y UNION ALL SELECT 2, 'a'", "SELECT 'A ' AS y, 2.0D AS x UNION ALL SELECT NULL, 1")
    assert not same("SELECT 'a' AS x, NULL AS y", "SELECT NULL AS x, 'a' AS y") and same("SELECT 0.0D AS x", "SELECT -0.0D AS x")
    assert same("SELECT 1 AS x UNION ALL SELECT 1", "SELECT 1 AS x") and not same("SELECT 1 AS x UNION ALL SELECT 1", "SELECT 1 AS x", bag=True)
    assert not same("SELECT 1 AS x UNION ALL SELECT 3", "SELECT 2 AS x UNION ALL SELECT 2", bag=True)
    assert same("SELECT 1 AS x WHERE false", "SELECT 'a' AS x WHERE false") and not same("SELECT 1 AS x WHERE false", "SELECT 1 AS x") and not same("SELECT 1 AS x", "SELECT 1 AS z")
    assert same("SELECT double('nan') AS x", "SELECT CAST(NULL AS DOUBLE) AS x") and same("SELECT 1 AS `a.b`", "SELECT 1 AS `a.b`")


def test_a_generated_cross_join_ends_at_the_limit(spark):
    views(spark, "/root/testdata/sf0.01", "lineitem")
    slow, began = "SELECT sum(a.l_quantity * b.l_tax + c.l_tax) AS x FROM lineitem a CROSS JOIN lineitem b CROSS JOIN lineitem c", time.perf_counter()
    assert evaluation.execution_accuracy(spark, slow, "SELECT 1 AS x", 3.0) == 0
    assert evaluation.valid_efficiency(spark, slow, "SELECT 1 AS x", 1, n=1, limit=3.0) == 0.0
    assert time.perf_counter() - began < 40
    assert evaluation.limited(spark, lambda: 5, 2.0) == 5
    with pytest.raises(ValueError):
        evaluation.limited(spark, lambda: int("x"), 2.0)


def test_trees(spark):
    rows = [("r", None), ("a", "r"), ("b", "r"), ("a1", "a"), ("a2", "a"), ("a2x", "a2"), ("cut", "gone"), ("cut1", "cut"), ("alone", None)]
    nodes = spark.createDataFrame(rows, "node_id string, parent_id string")
    held = trees.numbered(nodes)
    got = {r["node_id"]: (r["root"], r["depth"], r["first"], r["last"]) for r in held.collect()}
    assert got == {
        "r": ("r", 0, 0, 2), "a": ("r", 1, 0, 1), "b": ("r", 1, 2, 2), "a1": ("r", 2, 0, 0), "a2": ("r", 2, 1, 1), "a2x": ("r", 3, 1, 1),
        "cut": ("cut", 0, 0, 0), "cut1": ("cut", 1, 0, 0), "alone": ("alone", 0, 0, 0),
    }
    hits = spark.createDataFrame([("r", 1.0), ("a2", 0.5), ("cut", 2.0), ("alone", 3.0), ("none", 4.0)], "node_id string, score double")
    assert sorted(map(tuple, trees.leaves(hits, held).collect())) == [("a1", 1.0), ("a2x", 0.5), ("a2x", 1.0), ("alone", 3.0), ("b", 1.0), ("cut1", 2.0)]
    assert trees.numbered(nodes.limit(0)).count() == 0
    with pytest.raises(ValueError):
        trees.numbered(spark.createDataFrame([("x", "y"), ("y", "x")], nodes.schema))
