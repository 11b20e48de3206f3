"""The stored table of answers: folds, touched buckets, conflicts, the cache that reads it."""

import pytest

from sparkloom.operators import answers, feedback
from sparkloom.sources import versions

A = "pergunta string, sql_gerado string, resposta_final string, em long"


def stored(store):
    return {r["pergunta"]: (r["sql_gerado"], r["resposta_final"], r["status_validacao"], r["uso_count"], r["data_criacao"]) for r in store.rows().collect()}


def test_merges_fold_in_order(spark, tmp_path):
    store = answers.Answers(spark, f"file://{tmp_path}/a", "bigint", buckets=8)
    assert stored(store) == {}
    first = [("q1", "s1", "a1", 1), ("q1", "s2", "a2", 2), ("q2", "s3", None, 5), (None, "s", "a", 1), ("", "s4", "a4", 3)]
    store.merge(spark.createDataFrame(first, A))
    assert stored(store) == {"q1": ("s1", "a2", "PENDENTE", 1, 2), "q2": ("s3", None, "PENDENTE", 0, 5), "": ("s4", "a4", "PENDENTE", 0, 3)}
    store.validate(spark.createDataFrame([("q1",), ("nowhere",)], "pergunta string"))
    assert stored(store)["q1"][2] == "VALIDADO" and "nowhere" not in stored(store)
    store.merge(spark.createDataFrame([("q1", "s9", "a9", 9), ("q1", "s8", "a8", 8)], A))
    assert stored(store)["q1"] == ("s1", "a9", "PENDENTE", 3, 9)
    assert [r["resposta_final"] for r in store.lookup(spark.createDataFrame([("q1",), ("x",)], "pergunta string")).collect()] == ["a9"]
    assert store.merge(spark.createDataFrame([], A)) == 3


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = answers.Answers(spark, f"file://{tmp_path}/a", "bigint", buckets=16)
    store.merge(spark.createDataFrame([(f"q{i}", "s", "a", i) for i in range(200)], A))
    store.merge(spark.createDataFrame([("q7", "s", "b", 300)], A))
    _, content = versions.current(spark, store.path)
    writes = sorted(content["places"].values())
    assert len(set(writes[:15])) == 1 and writes[15] > writes[0]
    assert len(list((tmp_path / "a/rows" / writes[15]).glob("bucket=*"))) == 1
    assert len(stored(store)) == 200 and stored(store)["q7"][1] == "b"


def test_a_conflict_loses_nothing(spark, tmp_path, monkeypatch):
    store, other = (answers.Answers(spark, f"file://{tmp_path}/a", "bigint") for _ in range(2))
    store.merge(spark.createDataFrame([("q", "s", "a", 1)], A))
    real, done = answers.merged, []

    def slow(there, fresh):
        if not done:
            done.append(1)
            other.merge(spark.createDataFrame([("q", "s", "theirs", 2), ("r", "s", "r", 2)], A))
        return real(there, fresh)

    monkeypatch.setattr(answers, "merged", slow)
    store.merge(spark.createDataFrame([("q", "s", "mine", 3)], A))
    assert stored(store)["q"] == ("s", "mine", "PENDENTE", 2, 3) and stored(store)["r"][1] == "r"


def test_the_cache_reads_what_was_remembered(spark, tmp_path):
    embed = lambda q: [float(len(q)), 1.0, float(q.count("a"))]
    store = answers.Answers(spark, f"file://{tmp_path}/a")
    store.remember(embed)("quanto vendemos?", "SELECT 1", "10")
    assert store.cached(embed("quanto vendemos?")).collect() == []
    store.validate(spark.createDataFrame([("quanto vendemos?",)], "pergunta string"))
    assert [r["resposta_final"] for r in store.cached(embed("quanto vendemos?")).collect()] == ["10"]
    assert [r["sql"] for r in store.validated().collect()] == ["SELECT 1"]
    store.remember(embed)("quanto vendemos?", "SELECT 2", "11")
    r = store.rows().first()
    assert (r["sql_gerado"], r["resposta_final"], r["uso_count"], r["pergunta_embedding"]) == ("SELECT 1", "11", 1, embed("quanto vendemos?"))


def test_upsert_folds_repeats(spark):
    held = spark.createDataFrame([("q", "s", "old", "VALIDADO", 4, 1)], "pergunta string, sql_gerado string, resposta_final string, status_validacao string, uso_count int, data_criacao long")
    got = feedback.upsert(held, spark.createDataFrame([("q", "x", "one", 2), ("q", "y", "two", 3), ("n", "z", "three", 1)], A))
    assert sorted(map(tuple, got.collect())) == [("n", "z", "three", "PENDENTE", 0, 1), ("q", "s", "two", "PENDENTE", 6, 3)]


def test_gives_up_after_some_conflicts(spark, tmp_path, monkeypatch):
    store = answers.Answers(spark, f"file://{tmp_path}/a", "bigint")
    monkeypatch.setattr(versions, "commit", lambda *a: (_ for _ in ()).throw(versions.Conflict("again")))
    with pytest.raises(versions.Conflict):
        store.merge(spark.createDataFrame([("q", "s", "a", 1)], A))
