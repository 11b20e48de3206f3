"""Question files: evaluated, split and read in whichever form they come; known embeddings are taken."""

import json

from pyspark.sql import functions as F

from sparkloom import agent
from sparkloom.operators import answers, evaluation, retrieval
from sparkloom.sources import files


def test_question_files(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("three")
    cases = [
        {"id": 7, "dificuldade": "EASY", "pergunta": "n?", "sql_esperado": "", "sql": "SELECT count(*) AS n FROM three", "resposta_esperada": "três"},
        {"dificuldade": "EASY", "pergunta": "other?", "query": "SELECT 9 AS n"}, {"pergunta": " ", "sql": "SELECT 1"}, {"id": 9, "pergunta": "none?"},
    ]
    path = f"file://{tmp_path}/cases.json"
    files.write_json(cases, path, spark)
    held = files.questions(spark, path)
    assert [(c["id"], c["sql_esperado"]) for c in held] == [(7, "SELECT count(*) AS n FROM three"), (2, "SELECT 9 AS n"), (9, "")]
    reply = lambda q: agent.Response("3", {"sql": "SELECT count(id) AS n FROM three", "tool": "t", "context": "ddl", "schema_cols_original": 4, "schema_cols_pruned": 1, "schema_shortening_rate": 0.75})
    got = evaluation.evaluate_file(spark, reply, path, f"file://{tmp_path}/out.json", ves_runs=0)
    assert [(r["id"], r["execution_accuracy"], r["status_avaliacao"]) for r in got] == [(7, 1, "OK"), (2, 0, "ERRO_LOGICO_SQL"), (9, 0, "ERRO_LOGICO_SQL")]
    assert got[0]["resposta_esperada"] == "três" and got[0]["contexto_recuperado"] == "ddl" and got[0]["schema_shortening_rate"] == 0.75 and got[0]["schema_cols_original"] == 4
    assert json.loads((tmp_path / "out.json").read_text()) == got


def test_split_files(spark, tmp_path):
    cases = [{"id": i, "dificuldade": ["EASY", "NESTED", None][i % 3], "pergunta": f"q{i}"} for i in range(32)]
    paths = [f"file://{tmp_path}/{x}.json" for x in ("all", "pool", "test")]
    files.write_json(cases, paths[0], spark)
    assert evaluation.split_file(spark, *paths) == {"pool": 24, "test": 8}  # 3 of 11, 3 of 11, 2 of 10
    pool, test = (json.loads((tmp_path / f"{x}.json").read_text()) for x in ("pool", "test"))
    assert sorted(c["id"] for c in pool + test) == list(range(32))
    assert [sum(c["dificuldade"] == d for c in test) for d in ("EASY", "NESTED", None)] == [3, 3, 2]


def test_known_embeddings_are_taken(spark, tmp_path):
    log = tmp_path / "log"

    def embed(t):
        with open(log, "a") as f:
            f.write(t + "\n")
        return [float(len(t))]

    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, None)], "id long, pergunta string")
    known = spark.createDataFrame([("bb", [9.0]), ("a", None), ("c", [1.0])], "pergunta string, embedding array<double>")
    assert {r["id"]: r["embedding"] for r in retrieval.with_embeddings(rows, known, embed).collect()} == {1: [1.0], 2: [9.0], 3: None}
    assert log.read_text().split() == ["a"]
    store = answers.Answers(spark, f"file://{tmp_path}/a")
    store.remember(lambda q: [5.0])("stored", "SELECT 1", "x")
    a = agent.Agent(spark, None, lambda *x: "", embed=embed, store=store)
    assert {r["pergunta"]: r["embedding"] for r in a.with_vectors(spark.createDataFrame([("stored",), ("new",)], "pergunta string")).collect()} == {"stored": [5.0], "new": [3.0]}
    assert store.rows().where(F.col("pergunta_embedding").isNull()).count() == 0
