"""The stored index gives what scans give, and what a rebuild gives after it was kept up."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom import registry
from sparkloom.operators import indexes, retrieval
from sparkloom.sources import versions
from sparkloom.sources.tables import table

SF = "/root/testdata/sf0.001"


def texts(spark, rows):
    nodes = spark.createDataFrame(rows, "node_id string, file_name string, text string, embedding array<double>")
    return nodes, nodes.groupBy("file_name").agg(F.sha2(F.concat_ws("|", F.sort_array(F.collect_list(F.coalesce("text", F.lit("-"))))), 256).alias("hash"))


def sample(n, seed=1):
    rng = np.random.default_rng(seed)
    word = lambda: f"w{min(int(rng.zipf(1.3)), 200)}"
    return [(f"n{i}", f"f{i // 3}", " ".join(word() for _ in range(int(rng.integers(0, 40)))), [float(x) for x in rng.normal(size=6)]) for i in range(n)]


def pairs(df):
    return [(r[0], round(r[1], 9)) for r in df.collect()]


@pytest.mark.parametrize("folders", [1, 30])
def test_same_hits_as_scans(spark, tmp_path, monkeypatch, folders):
    monkeypatch.setattr(indexes, "BUCKET_NODES", 400 // folders)
    monkeypatch.setattr(indexes, "PART_ROWS", 400 // folders)
    if folders > 1:
        # small blocks and first looks, so that bounds count
        monkeypatch.setattr(indexes, "BLOCK", 8)
        monkeypatch.setattr(indexes, "FIRST_BLOCKS", 1)
        monkeypatch.setattr(indexes, "FIRST_ROWS", 4)
    rows = sample(400) + [("none", "fx", None, None), ("zero", "fx", "w1 w1", [0.0] * 6), ("odd", "fx", "", [1.0, 2.0])]
    nodes, state = texts(spark, rows)
    index = indexes.Index(spark, f"file://{tmp_path}/i")
    assert index.sync(nodes, state) == {"added": 135}
    assert index.sync(nodes, state) is None
    for question in ("w1", "w1 w2", "w3 w1 w2", "w9 nowhere", "", "w150"):
        for any_word in (False, True):
            assert pairs(index.lexical(question, 7, any_word)) == pairs(retrieval.lexical(nodes, question, 7, any_word)), question
    short = nodes.where("embedding is null or size(embedding) = 6")
    for k in range(6):
        query = rows[k * 31][3]
        assert pairs(index.dense(query, 5)) == pairs(retrieval.dense(short, query, 5))
    assert len(pairs(index.dense(rows[0][3], 1000))) == 401


def test_plans_read_the_tokens_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(indexes, "BUCKET_NODES", 5)
    nodes, state = texts(spark, sample(60))
    index = indexes.Index(spark, f"file://{tmp_path}/i")
    index.sync(nodes, state)
    files = index.postings(["w1"])
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0] and "In(token" in plan.replace("EqualTo(token", "In(token")
    assert files.select("token").distinct().count() == 1 and len(files.inputFiles()) > 5
    assert files.select(F.input_file_name()).distinct().count() == 1


def test_hundred_questions_on_all_vectors(spark):
    index = registry.vector_index(spark, SF)
    rows = table(spark, SF, "embeddings")
    vectors = {r["vec_id"]: list(r["embedding"]) for r in rows.collect()}
    ids, x = list(vectors), np.array(list(vectors.values()), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in ids[::25]:
        got = [(r["node_id"], round(r["score"], 6)) for r in index.dense(vectors[i], 12).collect()]
        score = x @ x[ids.index(i)]
        expected = sorted(((-s, j) for s, j in zip(score, ids)))[:12]
        assert [g[0] for g in got] == [j for _, j in expected]


def test_kept_up_equals_a_rebuild(spark, tmp_path):
    rows = sample(300)
    index = indexes.Index(spark, f"file://{tmp_path}/i")
    index.sync(*texts(spark, rows))
    first = index.segments
    # one file edited, one gone, one new; a text becomes null
    later = [r for r in rows if r[1] != "f5"] + [("new", "f999", "w1 w2 w3 w7", rows[0][3])]
    later = [(a, b, t + " w2 edited", e) if b == "f7" else (a, b, None, e) if a == "n60" else (a, b, t, e) for a, b, t, e in later]
    nodes, state = texts(spark, later)
    assert index.sync(nodes, state) == {"added": 1, "changed": 2, "removed": 1}
    assert index.segments[:-1] == first and index.content["rows"][str(index.segments[-1])] == 7
    again = indexes.Index(spark, f"file://{tmp_path}/again")
    again.sync(nodes, state)
    for _ in range(2):
        assert sorted(map(tuple, index.state().collect())) == sorted(map(tuple, again.state().collect()))
        assert sorted(r["node_id"] for r in index.nodes().collect()) == sorted(a for a, *_ in later)
        for question in ("w1 w2", "edited", "w7"):
            assert pairs(index.lexical(question, 9)) == pairs(again.lexical(question, 9)) == pairs(retrieval.lexical(nodes, question, 9))
        assert pairs(index.dense(rows[0][3], 6)) == pairs(again.dense(rows[0][3], 6)) == pairs(retrieval.dense(nodes, rows[0][3], 6))
        index.compact()
        assert len(index.segments) == 1 and index.content["tombs"] == []
    # what was removed may come back
    index.sync(*texts(spark, rows))
    assert pairs(index.lexical("w1 w2", 9)) == pairs(retrieval.lexical(texts(spark, rows)[0], "w1 w2", 9))
    assert index.sync(*texts(spark, rows)) is None


def test_two_writers(spark, tmp_path):
    path = f"file://{tmp_path}/v"
    assert versions.current(spark, path) == (0, {})
    versions.commit(spark, path, 1, {"a": "é"})
    with pytest.raises(versions.Conflict):
        versions.commit(spark, path, 1, {"a": 2})
    (tmp_path / "v/versions/0000000002.json").write_text('{"a"')  # broken off
    assert versions.current(spark, path) == (1, {"a": "é"}) and versions.following(spark, path) == 3


def test_of_two_syncs_the_second_is_told(spark, tmp_path):
    index, other = (indexes.Index(spark, f"file://{tmp_path}/i") for _ in range(2))
    index.sync(*texts(spark, sample(9)))
    with pytest.raises(versions.Conflict):
        other.sync(*texts(spark, sample(12)))
    assert other.refresh().sync(*texts(spark, sample(12))) == {"added": 1}
    assert sorted(r["node_id"] for r in other.nodes().collect()) == sorted(f"n{i}" for i in range(12))


def test_empty_index(spark, tmp_path):
    index = indexes.Index(spark, f"file://{tmp_path}/i")
    assert index.sync(*texts(spark, [])) is None
    assert index.lexical("w1").collect() == [] and index.dense([1.0]).collect() == []


def shuffled(spark, run):
    """(records, bytes) that stages write to shuffles while run() runs."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    total = lambda: np.array([[x.shuffleWriteRecords(), x.shuffleWriteBytes()] for x in (held.apply(i) for held in [stages()] for i in range(held.size()))] or [[0, 0]]).sum(0)
    before = total()
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return tuple(int(x) for x in total() - before)


def test_tokens_are_shuffled_as_finished_rows(spark, tmp_path):
    nodes = table(spark, SF, "documents").select(F.col("doc_id").alias("node_id"), "text")
    state = nodes.select("node_id", F.sha2("text", 256).alias("hash"))
    index = indexes.Index(spark, f"file://{tmp_path}/i", key="node_id")
    records, _ = shuffled(spark, lambda: index.sync(nodes, state))
    held = index._table("postings")
    rows, entries = held.count(), held.agg(F.sum(F.size("docs"))).first()[0]
    # a row for each token of a block, not one for each token of a node
    assert entries > 1.5 * rows and records < rows + 3000
    assert held.groupBy("segment", "block", "token").count().where("count > 1").isEmpty()
    assert held.select(F.max(F.size("docs"))).first()[0] <= indexes.BLOCK


@pytest.fixture
def no_broadcasts(spark):
    """As where all tables are too large for the planner to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def opaque(spark, n=60):
    """Nodes with long texts of no tokens, which can't be compressed, their state and vectors."""
    rng = np.random.default_rng(3)
    rows = [(i, "".join(rng.choice(list("!@#$%^&*()[]{}<>?/|~"), 6000))) for i in range(n)]
    nodes = spark.createDataFrame(rows, "node_id long, text string")
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(1, n + 9)], "node_id long, embedding array<double>")
    return nodes, vectors, lambda x: x.select("node_id", F.sha2("text", 256).alias("hash"))


def test_a_first_sync_moves_no_texts(spark, tmp_path, no_broadcasts):
    nodes, vectors, state = opaque(spark)
    index = indexes.Index(spark, f"file://{tmp_path}/i", key="node_id")
    _, size = shuffled(spark, lambda: index.sync(nodes, state(nodes), vectors=vectors, same_keys=True))
    assert size < 60 * 6000 / 10
    # all nodes are there, and the vectors of those that have one
    assert index.nodes().count() == 60 and sorted(r["node_id"] for r in index.vectors().collect()) == list(range(1, 60))
    assert pairs(index.dense([1.0, 5.0], 3)) == pairs(retrieval.dense(nodes.join(vectors, "node_id"), [1.0, 5.0], 3))


def test_a_later_sync_moves_no_texts_for_few_changes(spark, tmp_path, no_broadcasts, monkeypatch):
    nodes, _, state = opaque(spark)
    index = indexes.Index(spark, f"file://{tmp_path}/i", key="node_id")
    index.sync(nodes, state(nodes), same_keys=True)
    later = nodes.where("node_id <> 7").withColumn("text", F.when(F.col("node_id") == 5, F.lit("w1 w2")).otherwise(F.col("text")))
    _, size = shuffled(spark, lambda: index.sync(later, state(later), same_keys=True))
    assert size < 60 * 6000 / 10
    assert pairs(index.lexical("w1", 3)) == pairs(retrieval.lexical(later, "w1", 3)) and index.nodes().count() == 59
    # more changes than are broadcast
    monkeypatch.setattr(indexes, "KEYS", 0)
    assert index.sync(nodes, state(nodes), same_keys=True) == {"added": 1, "changed": 1}
    assert sorted(map(tuple, index.nodes().collect())) == sorted(map(tuple, nodes.collect()))
