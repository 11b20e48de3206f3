"""Pure operators with values worked out by hand, and their properties."""

import datetime as dt
import json
import time
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom import agent
from sparkloom.functions import text
from sparkloom.operators import evaluation, feedback, movement, retrieval
from sparkloom.plans import schema, sqlast, validate
from sparkloom.sources import files, tables

TWO = "SELECT c.name, SUM(o.total) FROM orders o JOIN customer c ON o.cid=c.id GROUP BY c.name HAVING SUM(o.total)>10"
quick = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def test_complexity_and_similarity(spark):
    a, b = sqlast.skeleton(spark, TWO), sqlast.skeleton(spark, "SELECT COUNT(*) FROM orders")
    assert (a["complexity"], b["complexity"]) == (19, 4)
    s = sqlast.skeletons(spark, [(1, TWO), (2, "SELECT COUNT(*) FROM orders")])
    pairs = s.alias("a").crossJoin(s.alias("b"))
    got = {(r[0], r[1]): r[2:] for r in pairs.select("a.id", "b.id", sqlast.similarity("a", "b"), sqlast.similarity("a", "b", compat=True)).collect()}
    assert got[1, 2][0] == pytest.approx(0.360526, abs=1e-6) and got[1, 2][1] == pytest.approx(0.379501, abs=1e-6)
    assert got[1, 1][0] == pytest.approx(1) and got[1, 1][1] == pytest.approx(20 / 19) and got[1, 2] == got[2, 1]


def test_broken_sql_has_no_skeleton(spark):
    assert sqlast.skeleton(spark, "SELECT (") is None and sqlast.components(spark, "") is None
    assert sqlast.skeletons(spark, [(1, "SELECT (")]).count() == 0


def test_components(spark):
    c = sqlast.components(spark, "SELECT DISTINCT t.a AS z FROM t WHERE t.b BETWEEN 1 AND 2 AND NOT t.c IN (1, 2) ORDER BY a DESC LIMIT 5")
    assert c["select"] == {"a"} and c["distinct"] and c["from"] == {"t"} and c["limit"] == "5" and c["order_by"] == ("a desc",)
    assert c["where"] == {("b", "between"), ("c", "not_in")}
    assert evaluation.exact_match(spark, TWO, TWO.replace(">10", ">99")) == 1


@pytest.mark.parametrize("sql", [TWO, "SELECT 1", "WITH t AS (SELECT 1 AS x) SELECT x FROM t", "SELECT a FROM b UNION SELECT c FROM d"])
def test_exact_match_of_itself(spark, sql):
    assert evaluation.exact_match(spark, sql, sql) == 1


def test_rrf(spark):
    hits = lambda ids: spark.createDataFrame([(i, 1.0 - k / 10) for k, i in enumerate(ids)], "node_id string, score double")
    got = {r["node_id"]: r["rrf"] for r in retrieval.fuse(hits(["a", "b"]), hits(["x", "y", "a"])).collect()}
    assert got["a"] == pytest.approx(0.032266, abs=1e-6) and got["b"] == pytest.approx(0.016129, abs=1e-6)


def test_gap_fill(spark):
    rows = [(1, 2, dt.date(2025, 1, 5), Decimal(1)), (2, 2, dt.date(2025, 3, 9), Decimal(2)), (3, 1, dt.date(2025, 5, 1), Decimal(9)), (4, 2, None, Decimal(7))]
    df = spark.createDataFrame(rows, "movement_id long, movement_type int, movement_date date, net_total decimal(18,4)")
    assert [(r["label"], r["revenue"]) for r in movement.revenue_by(df, "month").orderBy("period").collect()] == [("Jan 2025", 1.0), ("Feb 2025", 0.0), ("Mar 2025", 2.0)]
    assert movement.revenue_by(df.limit(0), "day").count() == 0


def test_empty_kpis(spark):
    df = spark.createDataFrame([], "movement_type int, net_total string, gross_total string, due_total string")
    assert tuple(movement.kpis(df).first()) == (0.0, 0.0, 0.0, 0.0, 0.0)
    bad = spark.createDataFrame([(2, "10.5", "x", None)], df.schema)
    assert tuple(movement.kpis(bad).first())[:3] == (10.5, 0.0, 0.0)


def test_formats(spark):
    one = spark.createDataFrame([(1234567.891, 12.345678)], "v double, p double")
    assert tuple(one.select(movement.currency(F.col("v")), movement.percent(F.col("p"))).first()) == ("R$ 1.234.567,89", "12,35%")
    assert movement.envelope(101, 2, 50) == {"page": 2, "page_size": 50, "total": 101, "total_pages": 3, "has_next": True, "has_previous": True}


def test_rows_need_an_id(spark):
    with pytest.raises(ValueError):
        movement.as_rows(spark.createDataFrame([(1,)], "x int"))
    r = movement.as_rows(spark.createDataFrame([(1, 5)], "movement_id long, extra int")).first()
    assert r["net_total"] == 0 and r["customer"] is None and "extra" not in r.asDict()


@quick
@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=30))
def test_split_is_exact(spark, strata):
    df = spark.createDataFrame(list(enumerate(strata)), "id long, s string")
    rows = evaluation.stratified_split(df, "s", "id").collect()
    assert len(rows) == len(strata)
    for s in set(strata):
        assert sum(r["s"] == s and r["part"] == "test" for r in rows) == -(-strata.count(s) // 5)


def test_efficiency_and_shortening(spark):
    assert evaluation.efficiency(1, 4) == 0.5 and evaluation.efficiency(4, 1) == 1.0
    assert spark.range(1).select(evaluation.shortening(F.lit(40), F.lit(12)), evaluation.shortening(F.lit(0), F.lit(0))).first()[:] == (0.7, 0.0)
    assert evaluation.valid_efficiency(spark, "SELECT 1", "SELECT 1", 0) == 0.0
    assert 0 < evaluation.valid_efficiency(spark, "SELECT 1", "SELECT 1", 1, n=1) <= 1


def test_execution_accuracy(spark):
    assert evaluation.execution_accuracy(spark, "SELECT ' A' AS x", "SELECT 'a' AS x") == 1
    assert evaluation.execution_accuracy(spark, "SELECT CAST(NULL AS STRING) AS x", "SELECT 'none' AS x") == 0
    assert evaluation.execution_accuracy(spark, "SELECT 1 AS x UNION ALL SELECT 1", "SELECT 1.0 AS x") == 1


def test_budget_is_a_prefix(spark):
    df = spark.createDataFrame([(i, "abcd") for i in range(3)], "i int, line string")
    assert movement.running_budget(df, "line", "i", 10).count() == 2
    assert text.rows_to_text(df.select("line"), 10) == "abcd\nabcd\n" + text.NOTE
    assert text.markdown(df.limit(1)).splitlines()[1] == "| --- | --- |"


def test_sanitiser_is_stable(spark):
    assert spark.range(1).select(text.sanitised(F.lit("[/IN[INST]ST]x"))).first()[0] == "x"


def test_choice_and_missing_name(spark):
    r = spark.range(1).select(text.choice(F.lit("Choice: 2\nReason: it fits")).alias("c"), text.missing_name(F.lit("ERROR: column x.y does not exist")).alias("m")).first()
    assert (r["c"]["choice"], r["c"]["reason"], r["m"]) == (2, "it fits", "x.y")


def test_ddl_columns_and_names(spark):
    cols, fks = tables.catalog_columns(spark, "/root/testdata/sf0.001", ["nation", "region"]), tables.catalog_fks(spark)
    rows = schema.ddl(cols, fks).select("table_name", schema.ddl_columns(F.col("ddl")), text.table_names(F.col("ddl"))).collect()
    assert {tuple(r[:2]) for r in rows} == {("nation", 3), ("region", 2)} and rows[0][2] == [rows[0][0]]


def test_audit_columns_go_unless_keys(spark):
    cols = spark.createDataFrame([("t", "x_session_id", "STRING", False), ("t", "session_id", "INT", True), ("t", "a", "DATE", False)], "table_name string, column_name string, data_type string, is_pk boolean").withColumn("is_fk", F.lit(False))
    assert {r["column_name"] for r in schema.pruned(cols).collect()} == {"session_id", "a"}
    assert {r["column_name"] for r in schema.linked(schema.pruned(cols), [("T", "A")]).collect()} == {"session_id", "a"}


def test_upsert_keeps_sql_and_demotes(spark):
    old = spark.createDataFrame([("q", "S1", "r1", "VALIDADO", 3, 1), ("p", "S2", "r2", "VALIDADO", 0, 1)], "pergunta string, sql_gerado string, resposta_final string, status_validacao string, uso_count int, data_criacao long")
    new = spark.createDataFrame([("q", "S9", "r9", 5), ("n", "S3", "r3", 5)], "pergunta string, sql_gerado string, resposta_final string, em long")
    got = {r[0]: tuple(r[1:]) for r in feedback.upsert(old, new).collect()}
    assert got == {"q": ("S1", "r9", "PENDENTE", 4, 5), "p": ("S2", "r2", "VALIDADO", 0, 1), "n": ("S3", "r3", "PENDENTE", 0, 5)}


def test_cache_needs_a_validated_near_question(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], "VALIDADO"), ("b", [1.0, 0.01], "PENDENTE"), ("c", [0.0, 1.0], "VALIDADO")], "pergunta string, pergunta_embedding array<float>, status_validacao string")
    assert [r["pergunta"] for r in retrieval.cached_answer(df, [1.0, 0.02]).collect()] == ["a"]
    assert retrieval.cached_answer(df, [1.0, 1.0]).count() == 0


def test_pool_files(spark, tmp_path):
    path = tmp_path / "pool.json"
    files.write_json([{"id": 1, "dificuldade": "EASY", "pergunta": "é?", "sql_esperado": "", "sql": "SELECT 1"}], str(path))
    assert "é" in path.read_text() and json.loads(path.read_text())[0]["id"] == 1
    pool = files.few_shot_pool(spark, str(path), str(tmp_path / "none.json"))
    assert [r[0] for r in pool.select(files.example_sql("sql_esperado", "sql")).collect()] == ["SELECT 1"]
    assert files.hash_state(spark, str(tmp_path / "none")).count() == 0 and files.index_table(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.txt").write_text("olá")
    assert tuple(files.text_files(spark, str(tmp_path / "docs")).first()) == ("a.txt", "olá")


def test_missing_view_says_what_there_is(spark):
    spark.range(1).createOrReplaceTempView("something_there")
    with pytest.raises(NameError, match="something_there"):
        tables.base_view(spark, "nowhere")


def test_only_queries_are_valid(spark):
    assert not validate.check(spark, "WITH d AS (SELECT 1) INSERT INTO t SELECT * FROM d")[0]
    assert validate.capped(spark, "SELECT * FROM range(500);", 100).count() == 100


def agent_of(spark, replies, **kw):
    spark.sql("SELECT 1 AS id, 'A' AS status").createOrReplaceTempView("movement")
    nodes = spark.createDataFrame([(t, f"CREATE TABLE {t}", agent.hashed_vector(t)) for t in ("orders", "movement", "region", "nation")], "node_id string, text string, embedding array<double>")
    it = iter(replies)
    return agent.Agent(spark, nodes, lambda q, tried, context: next(it), **kw)


def test_agent_paths(spark):
    kept = []
    a = agent_of(spark, ["SELECT nope FROM movement", "SELECT id FROM movement"], classify=lambda q: "EASY", remember=lambda *x: kept.append(x))
    r = a.ask("which movement is there?")
    assert r.response == "1" and r.metadata["attempts"] == 2 and r.metadata["difficulty"] == "EASY" and kept[0][1] == "SELECT id FROM movement"
    r = agent_of(spark, ["SELECT * FROM movement WHERE status = 'A'"]).ask("filter the dashboard by active")
    assert r.response.startswith("SELECT *") and r.rows.count() == 1
    assert "CREATE TABLE" in agent_of(spark, []).ask("how to see orders").response
    assert agent_of(spark, ["x", "y", "z"]).ask("sum?").response.startswith("Desculpe")

    def late(*_):
        raise TimeoutError("90 s")

    a.generate = late
    assert a.ask("sum?").response == "Timed out"
    assert agent.combined([r, r]).response.count("SELECT") == 2 and agent.prompt(agent.FILTER_TOOL, "?") == agent.RULES["filter", ""]


def test_json_replies(spark):
    rows = [(1, 'x ```json\n[{"a": 1}, {"a": 2}]\n``` y'), (2, '[{"a": 3}]'), (3, "nothing")]
    got = spark.createDataFrame(rows, "id int, t string").select("id", text.json_list(F.col("t"), "struct<a:int>").alias("l")).collect()
    assert {r["id"]: [x["a"] for x in r["l"]] for r in got} == {1: [1, 2], 2: [3], 3: []}


def test_evaluation_loop(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("three")
    cases = [{"id": 1, "pergunta": "n?", "sql_esperado": "SELECT count(*) AS n FROM three"}, {"id": 2, "pergunta": "late?", "sql_esperado": "SELECT 1"}, {"id": 3, "pergunta": "wrong?", "sql_esperado": "SELECT 2 AS n"}]

    def ask(q):
        if q == "late?":
            raise TimeoutError
        return agent.Response("3", {"sql": "SELECT count(id) AS n FROM three", "tool": "t"})

    out = tmp_path / "r.json"
    got = evaluation.evaluate(spark, ask, cases, str(out), ves_runs=1)
    assert [r["status_avaliacao"] for r in got] == ["OK", "TIMEOUT_API", "ERRO_LOGICO_SQL"] and json.loads(out.read_text()) == got
    counts = spark.createDataFrame([("a", 1), ("b", 0), ("c", 2)], "table_name string, row_count long")
    ddls = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "table_name string, ddl string")
    made = evaluation.generated_cases(spark, counts, ddls, lambda d: [{"pergunta": d}] * 5, skip=("c",))
    assert [m["id"] for m in made] == [1, 2, 3] and {m["pergunta"] for m in made} == {"A"}


def test_embedding_survives_bad_texts(spark):
    def embed(t):
        return [float(len(t)), 1 / len(t)]

    df = spark.createDataFrame([("ab",), ("",), (None,)], "t string")
    assert [r["embedding"] for r in retrieval.embedded(df, "t", embed).collect()] == [[2.0, 0.5], None, None]


def test_pools_are_kept_apart(spark):
    a = sqlast.pool_skeletons(spark, [(1, "SELECT 1")])
    assert sqlast.pool_skeletons(spark, [(1, "SELECT 1")]) is a and sqlast.pool_skeletons(spark, [(2, TWO)]).first()["complexity"] == 19


def examples(spark):
    rows = [(1, "EASY", "how many movements are there", "SELECT count(*) FROM movement"), (2, "NESTED", "movements in subqueries", "SELECT id FROM movement WHERE id IN (SELECT id FROM movement)"), (3, "EASY", None, "SELECT 1"), (4, "EASY", "empty one", " "), (5, None, "no class", "SELECT 2")]
    return spark.createDataFrame([(i, d, q, None, x, None, None, None) for i, d, q, x in rows], files.POOL)


def test_prompts_hold_what_the_agent_knows(spark, tmp_path):
    spark.sql("SELECT 1 AS id, 'A' AS status, 2 AS hr_modificacao, DATE'2020-01-01' AS day").createOrReplaceTempView("movement")
    nodes = spark.createDataFrame([(t, f"CREATE TABLE {t}", agent.hashed_vector(t)) for t in ("movement", "region")], "node_id string, text string, embedding array<double>")
    columns = [("movement", 1, "id", "INT", False, True, False, None), ("movement", 2, "status", "STRING", True, False, False, "state"), ("movement", 3, "hr_modificacao", "INT", True, False, False, None), ("movement", 4, "day", "DATE", True, False, False, None), ("region", 1, "r_id", "INT", False, True, False, None), ("region", 2, "r_name", "STRING", True, False, False, None)]
    catalog = spark.createDataFrame(columns, "table_name string, ordinal int, column_name string, data_type string, nullable boolean, is_pk boolean, is_fk boolean, comment string")
    fks = spark.createDataFrame([], "table_name string, column_name string, ref_table string, ref_column string")
    seen, asked = [], []

    def ask(settings=None, replies=("SELECT nope FROM movement", "SELECT id FROM movement"), **kw):
        seen.clear()
        it = iter(replies)

        def generate(question, tried, context):
            seen.append(context)
            return next(it)

        a = agent.Agent(spark, nodes, generate, hypothesise=lambda q: "SELECT id FROM movement WHERE status = 'A'", classify=lambda q: asked.append(q) or "EASY", examples=examples(spark), catalog=catalog, fks=fks, settings=settings, **kw)
        return a.ask("which movement is there?")

    validated = spark.createDataFrame([("what was asked before", "SELECT 7")], "pergunta string, sql string")
    r = ask(feedback=validated)
    assert "Classificação Correta: EASY" in asked[0] and "no class" not in asked[0] and "empty one" not in asked[0]
    first, second = seen
    # examples of the class and of the answers, linked columns alone; then all columns, the column that isn't there, and the missing keys
    assert "how many movements" in first and "what was asked before" in first and "in subqueries" not in first
    assert "status STRING" in first and "day DATE" in first and "hr_modificacao" not in first and "r_name" not in first and "no foreign key" not in first
    assert "hr_modificacao" in second and "r_name" in second and "`nope` does not exist" in second and "between movement and region" in second
    assert r.metadata["attempts"] == 2 and 0 < r.metadata["schema_shortening_rate"] < 1
    ask(agent.Settings(pruning=False, few_shots=1, self_correction=False))
    assert len(seen) == 1 and "r_name" in seen[0] and seen[0].count("Exemplo") == 1
    docs = spark.createDataFrame([(1, "manual of orders: press the button to close an order " * 60), (2, "something else entirely")], "doc_id long, text string")
    chunks = retrieval.chunks(docs, (100, 20), 5)
    chunks = retrieval.embedded(chunks, "text", agent.hashed_vector)
    a = agent.Agent(spark, nodes, lambda *x: "", documents=chunks)
    assert "press the button" in a.ask("how to close an order").response
    assert agent.engine(spark, lambda: a) is agent.engine(spark, lambda: None)


def test_dashboard_and_movements(spark):
    held = spark.sql("SELECT id AS movement_id, 2 AS movement_type, date_add(DATE'2020-01-01', CAST(id AS INT)) AS movement_date, 'A' AS status, CAST(id AS DECIMAL(18,4)) AS net_total, CAST(1 AS DECIMAL(18,2)) AS gross_total, CAST(0 AS DECIMAL(18,2)) AS due_total, id AS customer_id, 'c' AS customer, id AS supplier_id, 's' AS supplier FROM range(10)")
    held.createOrReplaceTempView("movement")
    board = agent.Dashboard(spark, "SELECT * FROM movement")
    assert board.kpis().first()["net_revenue"] == "R$ 45,00" and not board.refresh(agent.Response("x", {"tool": agent.QUERY_TOOL, "valid": True, "sql": "SELECT 1"}))
    assert board.refresh(agent.Response("x", {"tool": agent.FILTER_TOOL, "valid": True, "sql": "SELECT * FROM movement WHERE net_total > 8;"}))
    assert board.kpis().first()["net_revenue"] == "R$ 9,00" and board.charts()["customers"].first()["revenue"] == 9.0
    m = agent.Movements(held)
    assert len(m.find_all(3)) == 3 and m.find(4)["net_total"] == 4 and m.find(99) is None
    page = m.page(2, 4)
    assert page["total"] == 10 and page["total_pages"] == 3 and [r["movement_id"] for r in page["items"]] == [5, 4, 3, 2] and m.page(9, 4)["items"] == []


def test_statements_that_are_no_queries_are_not_run(spark):
    spark.range(2).createOrReplaceTempView("two")
    assert evaluation.execution_accuracy(spark, "DROP VIEW two", "SELECT 1") == 0 and evaluation.valid_efficiency(spark, "DROP VIEW two", "SELECT 1", 1) == 0.0
    assert spark.table("two").count() == 2
    assert validate.check(spark, "(SELECT id FROM two) UNION (SELECT 1)")[0] and validate.check(spark, "-- c\nSELECT 1")[0]
    assert validate.check(spark, "WITH a AS (SELECT 1) SELECT * FROM a")[0] and not validate.check(spark, "")[0] and not validate.check(spark, "SHOW TABLES")[0]


def test_both_sides_of_set_operations_count(spark):
    em = evaluation.exact_match
    assert em(spark, "SELECT a FROM t UNION SELECT b FROM u", "SELECT b FROM u UNION SELECT a FROM t") == 1
    assert em(spark, "SELECT a FROM t UNION SELECT b FROM u", "SELECT a FROM t UNION SELECT c FROM u") == 0
    assert em(spark, "SELECT a FROM t EXCEPT SELECT b FROM u", "SELECT b FROM u EXCEPT SELECT a FROM t") == 0
    assert em(spark, "SELECT coalesce(a, b) FROM t", "SELECT coalesce(a, c) FROM t") == 0


def test_evaluation_is_bounded_and_goes_on(spark):
    spark.range(3).createOrReplaceTempView("three")

    def ask(q):
        if q == "slow?":
            time.sleep(30)
        if q == "fails?":
            raise ValueError("no")
        return agent.Response("3", {"sql": "SELECT count(id) AS n FROM three"})

    cases = [{"id": i, "pergunta": q, "sql_esperado": "SELECT count(*) AS n FROM three"} for i, q in enumerate(["slow?", "fails?", "n?"])]
    began = time.time()
    got = evaluation.evaluate(spark, ask, cases, limit=3, ves_runs=1)
    assert time.time() - began < 25 and [r["status_avaliacao"] for r in got] == ["TIMEOUT_API", "FALHA_GERACAO_SQL", "OK"]
    assert all(r["pico_memoria_mb"] >= 0 for r in got)


def test_index_is_written_once(spark, tmp_path):
    path = str(tmp_path / "index")
    nodes = retrieval.chunks(spark.createDataFrame([(1, "words of a first text " * 40), (2, "others")], "doc_id long, text string"), (50, 20), 5)
    state = spark.createDataFrame([("t1", "h1"), ("t2", "h2")], "table_name string, hash string")
    assert feedback.read_index(spark, path) is None and feedback.write_index(nodes, state, path, embed=agent.hashed_vector)
    held = feedback.read_index(spark, path)
    assert held["nodes"].count() == nodes.count() and held["vectors"].count() == nodes.where("level = 0").count() and held["vectors"].where("embedding is null").count() == 0
    assert not feedback.write_index(nodes, state, path) and files.versions(spark, path) == [1]
    assert [r["node_id"] for r in retrieval.lexical(held["nodes"].drop("text"), "others").orderBy("node_id").collect()] == ["d2.0", "d2.0.0"]
    assert feedback.write_index(nodes.where("doc_id = 2"), state.where("hash = 'h2'"), path, embed=agent.hashed_vector) and files.versions(spark, path) == [1, 2]
    gone = feedback.changes(held["state"], feedback.read_index(spark, path)["state"], "table_name").collect()
    assert [(r["table_name"], r["change"]) for r in gone] == [("t1", "removed")]


def test_small_texts(spark):
    row = spark.sql("SELECT TIMESTAMP'2024-02-03 04:05:06' AS t, '03/02/2024' AS d, '2024' AS bad").select(text.stamp(F.col("t")), text.parsed_date(F.col("d")).cast("string"), text.parsed_date(F.col("bad"))).first()
    assert tuple(row) == ("03/02/2024 04:05:06", "2024-02-03", None)
    columns = spark.createDataFrame([("t", 1, "a", "INT", "the\nkey", "about"), ("t", 2, "b", "TEXT", None, "about")], "table_name string, ordinal int, column_name string, data_type string, comment string, table_comment string")
    fks = spark.createDataFrame([("t", "b", "u", "c")], "table_name string, column_name string, ref_table string, ref_column string")
    assert schema.simple_ddl(columns, fks).first()["ddl"] == "CREATE TABLE t (\n    a INT -- the key,\n    b TEXT,\n    FOREIGN KEY (b) REFERENCES u(c)\n);\n/* TABLE COMMENT: about */"
    assert sqlast.protected(spark, "SELECT 1 FROM tb_ação x JOIN tb_item i ON x.código = i.k WHERE item_q > 1", {"tb_acao": {"codigo"}, "tb_item": {"k", "item_q"}}) == {"tb_acao": {"codigo"}, "tb_item": {"k", "item_q"}}
    assert evaluation.pruning_rates(4, 3, 20, 10, 5) == {"table_pruning_rate": 0.25, "schema_shortening_rate": 0.75, "column_pruning_rate": 0.5, "schema_cols_original": 20, "schema_cols_pruned": 5}
    one = feedback.answered(spark, "q", "SELECT 1", "a").first()
    assert one["em"] is not None
    spark.range(1).createOrReplaceTempView("seen_view")
    assert tables.reflected(spark).where("table_name = 'seen_view'").count() == 1 and tables.reflected(spark, False).where("table_name = 'seen_view'").count() == 0
