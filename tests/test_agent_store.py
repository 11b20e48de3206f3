"""The agent on what is stored: its index is kept up, its answers are remembered, validated and found again."""

from pyspark.sql import functions as F

from sparkloom import agent
from sparkloom.operators import answers, indexes, many, retrieval, rollup
from sparkloom.plans import schema, validate


def tables_of(spark, texts):
    nodes = spark.createDataFrame(list(texts.items()), "node_id string, text string").withColumn("table_name", F.col("node_id"))
    return nodes, nodes.select("table_name", F.sha2("text", 256).alias("hash"))


def test_agent_on_index_and_answers(spark, tmp_path):
    spark.sql("SELECT 7 AS id, 'A' AS status").createOrReplaceTempView("movement")
    index = indexes.Index(spark, f"file://{tmp_path}/tables", key="table_name")
    store = answers.Answers(spark, f"file://{tmp_path}/answers")
    asked = []
    a = agent.Agent(spark, None, lambda q, tried, context: asked.append(context) or "SELECT id FROM movement", index=index, store=store, settings=agent.Settings(cache=True, top_k=1), examples=None)
    assert a.sync(*tables_of(spark, {"movement": "CREATE TABLE movement of sales", "orders": "CREATE TABLE orders"})) == {"added": 2}
    assert a.ask("movement of sales?").response == "7" and "CREATE TABLE movement" in asked[0] and "orders" not in asked[0]
    assert store.rows().first()["status_validacao"] == "PENDENTE"
    # pending answers aren't found; validated ones are, without the model
    assert a.ask("movement of sales?").response == "7" and len(asked) == 2 and store.rows().first()["uso_count"] == 1
    store.validate(store.rows())
    found = a.ask("movement of sales?")
    assert found.metadata == {"cached": True} and found.response == "7" and len(asked) == 2
    assert a.sync(*tables_of(spark, {"movement": "CREATE TABLE movement of sales", "orders": "CREATE TABLE orders"})) is None
    assert a.sync(*tables_of(spark, {"movement": "CREATE TABLE movement (now other)", "region": "CREATE TABLE region"})) == {"changed": 1, "added": 1, "removed": 1}
    assert sorted(r["node_id"] for r in a.known().collect()) == ["movement", "region"]


def test_manuals_of_a_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "manual of orders: press the button to close an order " * 60), (2, "something else entirely")], "doc_id long, text string")
    nodes = retrieval.chunks(docs, (100, 20), 5).withColumn("file_name", F.col("doc_id").cast("string"))
    manuals = indexes.Index(spark, f"file://{tmp_path}/docs")
    manuals.sync(nodes, nodes.groupBy("file_name").agg(F.sha2(F.max("text"), 256).alias("hash")), agent.hashed_vector)
    assert manuals.vectors().count() == nodes.where("level = 0").count()
    a = agent.Agent(spark, None, lambda *x: "", manuals=manuals, index=manuals, scorer=many.scorer(lambda: lambda pairs: [float("button" in t) for _, t in pairs]))
    assert "press the button" in a.ask("how to close an order").response


def test_hybrid_switch_and_retriever(spark):
    pool = spark.createDataFrame([(1, "EASY", "alpha beta", "SELECT count(*) FROM t"), (2, "EASY", "gamma", "SELECT a FROM t JOIN u ON t.x = u.x GROUP BY a HAVING count(*) > 1")], "id long, dificuldade string, pergunta string, sql string")
    pool = pool.select("id", "dificuldade", "pergunta", F.lit(None).cast("string").alias("sql_esperado"), "sql", F.lit(None).cast("string").alias("query"), F.lit(None).cast("string").alias("sql_gerado"), F.lit(None).cast("string").alias("resposta_esperada"))
    guess = "SELECT b FROM v JOIN w ON v.x = w.x GROUP BY b HAVING count(*) > 2"
    for hybrid, first in ((True, "gamma"), (False, "alpha beta")):
        a = agent.Agent(spark, None, lambda *x: "", examples=pool, settings=agent.Settings(hybrid=hybrid, few_shots=1), embed=lambda t: [1.0, float("gamma" in t)], hypothesise=lambda q: guess)
        # the question is more like the first, the guess more like the second in structure
        assert first in a.shots("alpha", guess, agent.QUERY_TOOL, "EASY")
    nodes = spark.createDataFrame([("a", "CREATE TABLE a", [1.0]), ("b", "CREATE TABLE b", [1.0])], "node_id string, text string, embedding array<double>")
    a = agent.Agent(spark, nodes, lambda *x: "", retriever=lambda q, g: spark.createDataFrame([("b", 1.0)], "node_id string, score double"))
    assert a.context("?")[0] == "CREATE TABLE b"
    a = agent.Agent(spark, nodes, lambda *x: "", hypothesise=lambda q: 1 / 0)
    assert a.guess("what?") == "what?"


def test_rates_count_what_was_left_out(spark):
    nodes = spark.createDataFrame([(f"public.T{i}", f"CREATE TABLE t{i} words", [1.0, float(i)]) for i in range(4)], "node_id string, text string, embedding array<double>")
    catalog = spark.createDataFrame([(f"t{i}", k, f"c{k}", "INT", False, k == 1, False, None) for i in range(4) for k in range(1, 4)], "table_name string, ordinal int, column_name string, data_type string, nullable boolean, is_pk boolean, is_fk boolean, comment string")
    fks = spark.createDataFrame([], "table_name string, column_name string, ref_table string, ref_column string")
    a = agent.Agent(spark, nodes, lambda *x: "", embed=lambda t: [1.0, 0.0], catalog=catalog, fks=fks, settings=agent.Settings(top_k=1))
    *_, rates = a.context("words", "")
    assert rates == {"table_pruning_rate": 0.75, "schema_shortening_rate": round(1 - 1 / 12, 4), "column_pruning_rate": round(1 - 1 / 3, 4), "schema_cols_original": 12, "schema_cols_pruned": 1}


def test_dashboard_is_worked_out_once(spark, monkeypatch):
    spark.sql("SELECT id AS id_movimento, 2 AS tipo_movimento, DATE'2020-01-05' AS data_movimento, 'I' AS situacao, CAST(id AS DECIMAL(18,4)) AS valor_total_liquido FROM range(10)").createOrReplaceTempView("movement")
    made, real = [], rollup.Rollup.refresh
    monkeypatch.setattr(rollup.Rollup, "refresh", lambda self, dates=None: made.append(1) or real(self, dates))
    board = agent.Dashboard(spark, "SELECT * FROM movement")
    assert board.kpis().first()["net_revenue"] == "R$ 45,00" and board.charts()["types"].first()["n"] == 10 and board.charts("year")["revenue"].first()["revenue"] == 45.0
    assert made == [1]


def test_more_roots_are_queries(spark):
    spark.range(3).createOrReplaceTempView("three")
    for sql in ("SELECT /*+ BROADCAST(three) */ id FROM three", "VALUES (1), (2)", "TABLE three", "SELECT id FROM three DISTRIBUTE BY id", "FROM three SELECT id", "SELECT * FROM range(3)"):
        assert validate.check(spark, sql)[0], sql
    for sql in ("SET x = 1", "CACHE TABLE three", "CREATE TABLE t AS SELECT 1", "EXPLAIN SELECT 1"):
        assert validate.check(spark, sql)[1] == "NOT_A_QUERY", sql


def test_names_of_tables(spark):
    df = spark.createDataFrame([("Public.Orders", "orders"), ("a.orders", "b.ORDERS"), ("orders", "order")], "a string, b string")
    assert [r[0] for r in df.select(schema.same_table(F.col("a"), F.col("b"))).collect()] == [True, True, False]


def test_indexes_follow_the_catalog_and_a_folder(spark, tmp_path):
    columns = [("t", 1, "a", "INT", False, True, False, None), ("u", 1, "b", "INT", False, True, False, None)]
    kind = "table_name string, ordinal int, column_name string, data_type string, nullable boolean, is_pk boolean, is_fk boolean, comment string"
    fks = spark.createDataFrame([], "table_name string, column_name string, ref_table string, ref_column string")
    a = agent.Agent(spark, None, lambda *x: "", index=indexes.Index(spark, f"file://{tmp_path}/i", key="table_name"), manuals=indexes.Index(spark, f"file://{tmp_path}/m"), catalog=spark.createDataFrame(columns, kind), fks=fks)
    assert a.sync_catalog() == {"added": 2} and a.sync_catalog() is None
    a.catalog = spark.createDataFrame([*columns, ("u", 2, "c", "DATE", True, False, False, "day")], kind)
    assert a.sync_catalog() == {"changed": 1} and {r["node_id"]: "c DATE -- day" in r["text"] for r in a.known().collect()} == {"t": False, "u": True}
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.txt").write_text("how to close an order: press the button")
    (folder / "b.txt").write_text("other things")
    assert a.sync_manuals(f"file://{folder}") == {"added": 2} and a.sync_manuals(f"file://{folder}") is None
    (folder / "b.txt").write_text("how to close a shop: turn the key")
    (folder / "a.txt").unlink()
    assert a.sync_manuals(f"file://{folder}") == {"changed": 1, "removed": 1}
    assert a.manual("how to close") == "how to close a shop: turn the key"
