"""All registered queries of the engine proper, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import maps, text, vectors
from sparkloom.operators import answers, evaluation, feedback, indexes, many, movement, retrieval, rollup, trees
from sparkloom.plans import schema, sqlast, validate
from sparkloom.sources import files, tables, versions
from sparkloom.sources.tables import table, views

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if oracle is not None:
            _oracles[f.__name__] = oracle
        return f

    return add


def same_sql(name: str, sql: str, *names: str) -> None:
    """A statement that means the same in both dialects."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, *names)
        return spark.sql(sql)

    run.__name__ = name
    query(sql)(run)


M = f"WITH m AS ({movement.MOVEMENT_SQL})"
PAGE = "movement_id, movement_date, net_total, movement_type, customer, supplier"

# --- dashboard -------------------------------------------------------------------------------------------------


@query(f"{M} SELECT {PAGE} FROM m WHERE status = 'A' ORDER BY movement_id LIMIT 100")
def active_movements(spark, sf_dir):
    return movement.first_rows(movement.active(movement.movement(spark, sf_dir)))


_kept: dict[tuple[str, str, str], tuple[list, object]] = {}


def kept(spark: SparkSession, sf_dir: str, name: str, tables_: list[str], build: Callable[[str], object]):
    """What build(path) has written for some tables; built again only when their files have changed."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    source = [versions.fingerprint(spark, f"{sf_dir}/{t}.parquet") for t in tables_]
    if key not in _kept or _kept[key][0] != source:
        _kept[key] = (source, build(versions.new_path(spark, name)))
    return _kept[key][1]


VIEW = ["orders", "lineitem", "customer", "supplier"]


def dashboard(spark: SparkSession, sf_dir: str) -> rollup.Rollup:
    """The maintained aggregates of the movement view."""

    def build(path: str) -> rollup.Rollup:
        found = rollup.Rollup(spark, path, lambda: movement.movement(spark, sf_dir))
        found.refresh()
        return found

    return kept(spark, sf_dir, "rollup", VIEW, build)


def pages(spark: SparkSession, sf_dir: str) -> rollup.Pages:
    """Active movements in the order of pages."""

    def build(path: str) -> rollup.Pages:
        rows = movement.active(movement.movement(spark, sf_dir)).select(*movement.PAGE)
        return rollup.Pages.write(rows, path, movement.latest(), spark.sparkContext.defaultParallelism)

    return kept(spark, sf_dir, "pages", VIEW, build)


@query(f"{M} SELECT {PAGE}, (SELECT count(*) FROM m WHERE status = 'A') AS total FROM m WHERE status = 'A' ORDER BY movement_date DESC NULLS LAST, movement_id LIMIT 50 OFFSET 100")
def movement_page(spark, sf_dir):
    return pages(spark, sf_dir).page(3, 50)


@query(f"""{M}, a AS (SELECT {PAGE}, count(*) OVER () AS total, row_number() OVER (ORDER BY movement_date DESC NULLS LAST, movement_id) AS at_ FROM m WHERE status = 'A')
 SELECT {PAGE}, total FROM a WHERE (at_ - 1) // 50 = (total - 1) // 50""")
def movement_last_page(spark, sf_dir):
    held = pages(spark, sf_dir)
    return held.page(-(-held.total // 50), 50)


@query(f"{M} SELECT {PAGE}, (SELECT count(*) FROM m WHERE status = 'A') AS total FROM m WHERE status = 'A' ORDER BY movement_date DESC NULLS LAST, movement_id LIMIT 50 OFFSET 100")
def movement_page_scan(spark, sf_dir):
    """The page without anything stored."""
    return movement.page(movement.active(movement.movement(spark, sf_dir)), 3, 50)


KPIS = f"""{M}, k AS (SELECT
  CAST(coalesce(sum(CASE WHEN movement_type = 2 THEN net_total END), 0) AS DOUBLE) AS net_revenue,
  CAST(coalesce(sum(CASE WHEN movement_type = 2 THEN gross_total END), 0) AS DOUBLE) AS gross_revenue,
  CAST(coalesce(sum(CASE WHEN movement_type = 2 THEN due_total END), 0) AS DOUBLE) AS receivable,
  CAST(coalesce(sum(CASE WHEN movement_type = 1 THEN due_total END), 0) AS DOUBLE) AS payable
  FROM m WHERE status = 'A'),
 d AS (SELECT *, round(CASE WHEN net_revenue <> 0 THEN receivable / net_revenue * 100 ELSE 0 END, 6) AS delinquency FROM k)"""


@query(f"{KPIS} SELECT * FROM d")
def dashboard_kpis(spark, sf_dir):
    return dashboard(spark, sf_dir).kpis()


@query(f"""{KPIS} SELECT {', '.join(f"'R$ ' || translate(format('{{:,.2f}}', {c}), ',.', '.,') AS {c}" for c in ("net_revenue", "gross_revenue", "receivable", "payable"))},
  translate(format('{{:.2f}}%', delinquency), '.', ',') AS delinquency FROM d""")
def dashboard_kpis_formatted(spark, sf_dir):
    return dashboard(spark, sf_dir).formatted_kpis()


def _revenue(unit: str, label: str) -> str:
    return f"""{M}, f AS (SELECT CAST(date_trunc('{unit}', movement_date) AS DATE) AS period, sum(net_total) AS s FROM m
      WHERE status = 'A' AND movement_type = 2 AND movement_date IS NOT NULL GROUP BY 1),
     spine AS (SELECT CAST(unnest(generate_series(min(period)::TIMESTAMP, max(period)::TIMESTAMP, INTERVAL 1 {unit})) AS DATE) AS period FROM f)
    SELECT period, strftime(period, '{label}') AS label, CAST(coalesce(s, 0) AS DOUBLE) AS revenue FROM spine LEFT JOIN f USING (period)"""


@query(_revenue("day", "%d/%m/%Y"))
def revenue_by_day(spark, sf_dir):
    return dashboard(spark, sf_dir).revenue_by("day")


@query(_revenue("month", "%b %Y"))
def revenue_by_month(spark, sf_dir):
    return dashboard(spark, sf_dir).revenue_by("month")


@query(_revenue("year", "%Y"))
def revenue_by_year(spark, sf_dir):
    return dashboard(spark, sf_dir).revenue_by("year")


@query(f"{M} SELECT customer, CAST(sum(net_total) AS DOUBLE) AS revenue FROM m WHERE status = 'A' AND movement_type = 2 AND customer IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_customers(spark, sf_dir):
    return dashboard(spark, sf_dir).top_customers()


@query(f"{M} SELECT movement_type, count(*) AS n FROM m WHERE status = 'A' AND movement_type IS NOT NULL GROUP BY 1")
def movements_by_type(spark, sf_dir):
    return dashboard(spark, sf_dir).by_type()


@query(f"{M} SELECT CASE movement_type WHEN 1 THEN 'Compra' WHEN 2 THEN 'Venda' ELSE 'Outro' END AS label, count(*) AS n FROM m WHERE status = 'A' GROUP BY 1")
def movements_by_label(spark, sf_dir):
    return dashboard(spark, sf_dir).by_label()


# half cents go to the even cent
CENTS = "sign(u) * (abs(u) // 100 + CASE WHEN abs(u) % 100 > 50 OR (abs(u) % 100 = 50 AND abs(u) // 100 % 2 = 1) THEN 1 ELSE 0 END)"


@query(f"""{M} SELECT movement_id, strftime(movement_date, '%d/%m/%Y') AS movement_date, CAST(CAST(CAST({CENTS} AS DECIMAL(18,0)) * 0.01 AS DECIMAL(18,2)) AS VARCHAR) AS net_total,
  CAST(gross_total AS VARCHAR) AS gross_total, CAST(due_total AS VARCHAR) AS due_total FROM (SELECT *, CAST(net_total * 10000 AS BIGINT) AS u FROM m)""")
def movement_serialised(spark, sf_dir):
    rows = movement.as_rows(movement.movement(spark, sf_dir))
    return movement.serialised(rows.select("movement_id", "movement_date", "net_total", "gross_total", "due_total"))


# --- the open SQL surface --------------------------------------------------------------------------------------

same_sql("sql_inner_join", "SELECT n_name, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders INNER JOIN customer ON o_custkey = c_custkey INNER JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", "orders", "customer", "nation")
same_sql("sql_left_join", "SELECT o_orderkey, o_orderstatus, count(l_orderkey) AS n_lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus", "orders", "lineitem")
same_sql("sql_join_on_date", "SELECT CAST(o.o_orderdate AS DATE) AS day, o.n AS n_orders, l.n AS n_lines FROM (SELECT CAST(o_orderdate AS DATE) AS o_orderdate, count(*) AS n FROM orders GROUP BY 1) o INNER JOIN (SELECT CAST(l_shipdate AS DATE) AS d, count(*) AS n FROM lineitem GROUP BY 1) l ON o.o_orderdate = l.d", "orders", "lineitem")
same_sql("sql_semi_in_having", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 12)", "customer", "orders")
same_sql("sql_semi_exists", "SELECT s_suppkey, s_name FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s.s_suppkey AND l_quantity >= 50 AND l_discount >= 0.09)", "supplier", "lineitem")
same_sql("sql_anti_join", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)", "orders", "lineitem")
same_sql("sql_window_rank", "SELECT * FROM (SELECT c_custkey, c_nationkey, c_acctbal, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS rk FROM customer) t WHERE rk <= 5", "customer")
same_sql("sql_cte_nested", "WITH spend AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders GROUP BY o_custkey), mean AS (SELECT avg(CAST(total AS DOUBLE)) AS m FROM spend) SELECT c_mktsegment, count(*) AS n FROM spend JOIN customer ON c_custkey = o_custkey WHERE total > (SELECT m FROM mean) GROUP BY c_mktsegment", "orders", "customer")
same_sql("sql_having", "SELECT l_returnflag, l_linestatus, min(l_quantity) AS lo, max(l_quantity) AS hi, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 100", "lineitem")
same_sql("sql_count_distinct", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(*) AS n FROM orders GROUP BY o_orderpriority", "orders")
same_sql("sql_setops", "(SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) EXCEPT (SELECT c_nationkey FROM customer INTERSECT SELECT n_nationkey FROM nation WHERE n_regionkey = 1)", "customer", "supplier", "nation")
same_sql("sql_filters", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE (o_orderdate BETWEEN TIMESTAMP '1997-03-01 00:00:00' AND TIMESTAMP '1997-06-30 23:59:59' OR o_orderpriority LIKE '1-%') AND o_orderstatus IN ('F', 'O') AND NOT o_totalprice <= 1000 AND o_custkey IS NOT NULL", "orders")
same_sql("sql_contains", "SELECT s_suppkey, s_name FROM supplier WHERE lower(s_name) LIKE '%1%' AND s_acctbal > 0", "supplier")
same_sql("sql_distinct_limit", "SELECT DISTINCT p_brand, p_type FROM part ORDER BY p_brand, p_type LIMIT 25", "part")
same_sql("adhoc_sql_capped", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100", "orders")
same_sql("answer_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", "orders")


@query("SELECT lower(c_name) AS name, coalesce(c_mktsegment, 'none') AS segment, CAST(trunc(c_acctbal) AS INTEGER) AS balance, abs(c_acctbal) AS size FROM customer")
def sql_scalar_functions(spark, sf_dir):
    # a cast cuts the balance to an integer, which the other dialect would round
    views(spark, sf_dir, "customer")
    return spark.sql("SELECT lower(c_name) AS name, coalesce(c_mktsegment, 'none') AS segment, CAST(c_acctbal AS INTEGER) AS balance, abs(c_acctbal) AS size FROM customer")


@query("SELECT l_orderkey, string_agg(p_name, '; ' ORDER BY l_linenumber, l_partkey) AS items FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey")
def string_agg_items(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    listed = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_name")))
    return items.groupBy("l_orderkey").agg(F.array_join(F.transform(listed, lambda x: x["p_name"]), "; ").alias("items"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1, 2")
def json_field(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return e.where("k is not null").groupBy("event_type", "k").agg(F.count("*").alias("n"))


# --- retrieval -------------------------------------------------------------------------------------------------


def text_index(spark: SparkSession, sf_dir: str) -> indexes.Index:
    """The stored index of all documents, with the vectors of the same number as theirs."""

    def rows() -> tuple[DataFrame, DataFrame, DataFrame]:
        docs, vecs = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
        nodes = docs.select(F.col("doc_id").alias("node_id"), "text")
        return nodes, nodes.select("node_id", F.sha2("text", 256).alias("hash")), vecs.select(F.col("vec_id").alias("node_id"), "embedding")

    return indexes.of_table(spark, sf_dir, "documents", rows)


def vector_index(spark: SparkSession, sf_dir: str) -> indexes.Index:
    """The stored index of all embeddings, which have no text."""

    def rows() -> tuple[DataFrame, DataFrame, None]:
        nodes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.lit("").alias("text"), "embedding")
        return nodes, nodes.select("node_id", F.xxhash64("embedding").cast("string").alias("hash")), None

    return indexes.of_table(spark, sf_dir, "embeddings", rows)


def _vector(spark, sf_dir, vec_id: int) -> list[float]:
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()
    return list(row["embedding"]) if row else []


COS = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))"


@query(f"SELECT a.vec_id AS node_id, round({COS}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0 ORDER BY {COS} DESC, a.vec_id LIMIT 12")
def cosine_topk(spark, sf_dir):
    found = vector_index(spark, sf_dir).dense(_vector(spark, sf_dir, 0), 12)
    return found.withColumn("score", F.round("score", 6))


@query(f"SELECT a.vec_id, round(1 - {COS}, 6) AS distance FROM embeddings a, embeddings b WHERE b.vec_id = 1 AND 1 - {COS} < 0.6")
def cosine_threshold(spark, sf_dir):
    q = F.array(*[F.lit(float(x)) for x in _vector(spark, sf_dir, 1)])
    held = table(spark, sf_dir, "embeddings").select("vec_id", vectors.distance(F.col("embedding"), q).alias("distance"))
    return held.where(F.col("distance") < 0.6).withColumn("distance", F.round("distance", 6))


TOKENS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


@query(f"SELECT item_id, len({TOKENS.format('text')}) AS n_tokens, len(list_distinct({TOKENS.format('text')})) AS n_distinct, {TOKENS.format('text')}[1] AS first_token FROM benchmark")
def tokenize_docs(spark, sf_dir):
    held = table(spark, sf_dir, "benchmark").select("item_id", text.tokens(F.col("text")).alias("ts"))
    return held.select("item_id", F.size("ts").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("ts")).cast("bigint").alias("n_distinct"), F.get("ts", 0).alias("first_token"))


QUESTION = "the of token"


@query(f"SELECT doc_id FROM documents WHERE list_has_all({TOKENS.format('text')}, ['the', 'of', 'token'])")
def lexical_match(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("ts"))
    q = F.array_distinct(text.tokens(F.lit(QUESTION)))
    return docs.where((F.size(q) > 0) & (F.size(F.array_except(q, "ts")) == 0)).select("doc_id")


def _bm25(words: list[str]) -> str:
    one = "(len(list_filter(ts, lambda t: t = '{0}')) * 2.2 / (len(list_filter(ts, lambda t: t = '{0}')) + 1.2 * (0.25 + 0.75 * len(ts) / 500)))"
    return " + ".join(one.format(w) for w in words)


LEXICAL = f"SELECT doc_id AS node_id, {_bm25(['the', 'of', 'token'])} AS score FROM (SELECT doc_id, {TOKENS.format('text')} AS ts FROM documents) WHERE list_has_all(ts, ['the', 'of', 'token']) ORDER BY score DESC, node_id LIMIT 12"


@query(f"SELECT node_id, round(score, 6) AS score FROM ({LEXICAL})")
def lexical_rank(spark, sf_dir):
    found = text_index(spark, sf_dir).lexical(QUESTION, 12)
    return found.withColumn("score", F.round("score", 6))


DENSE = f"SELECT a.vec_id AS node_id, {COS} AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0 ORDER BY score DESC, node_id LIMIT 12"


@query(f"""WITH l AS ({LEXICAL}), d AS ({DENSE}), u AS (
  SELECT node_id, row_number() OVER (ORDER BY score DESC, node_id) AS rk FROM l UNION ALL SELECT node_id, row_number() OVER (ORDER BY score DESC, node_id) FROM d)
 SELECT node_id, round(sum(1 / (60.0 + rk)), 9) AS rrf FROM u GROUP BY node_id""")
def rrf_fusion(spark, sf_dir):
    d, x = vector_index(spark, sf_dir).dense(_vector(spark, sf_dir, 0), 12), text_index(spark, sf_dir).lexical(QUESTION, 12)
    return retrieval.fuse(d, x).withColumn("rrf", F.round("rrf", 9))


RERANKED = f"SELECT node_id, len(list_intersect(['the', 'of', 'token', 'anstou'], {TOKENS.format('d.text')})) / 4.0 AS score FROM (HITS) h JOIN documents d ON d.doc_id = h.node_id ORDER BY score DESC, node_id LIMIT 3"
RERANK_QUESTION = "the of token anstou"


@query(RERANKED.replace("HITS", LEXICAL))
def rerank_topk(spark, sf_dir):
    nodes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), "text")
    return retrieval.rerank(retrieval.lexical(nodes, QUESTION), nodes, retrieval.overlap_score(RERANK_QUESTION))


FUSED = f"""SELECT node_id FROM ({LEXICAL}) UNION SELECT node_id FROM (SELECT d.doc_id AS node_id, {COS} AS score FROM documents d JOIN embeddings a ON a.vec_id = d.doc_id, embeddings b WHERE b.vec_id = 0 ORDER BY score DESC, node_id LIMIT 12)"""


@query(f"SELECT node_id, len(list_intersect(['the', 'of', 'token'], {TOKENS.format('d.text')})) / 3.0 AS score FROM ({FUSED}) h JOIN documents d ON d.doc_id = h.node_id ORDER BY score DESC, node_id LIMIT 3")
def retrieve_pipeline(spark, sf_dir):
    # a document without a vector is still found by its words
    return retrieval.retrieve_indexed(text_index(spark, sf_dir), QUESTION, _vector(spark, sf_dir, 0))


WORDS = "regexp_split_to_array(trim(coalesce(text, ''), chr(9) || chr(10) || chr(13) || ' '), '\\s+')"
CHUNKS = f"""WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
 roots AS (SELECT doc_id, n, list_slice(ws, n * 1968 + 1, n * 1968 + 2048) AS ws FROM (SELECT doc_id, ws, unnest(generate_series(0, greatest(0, CAST(ceil((len(ws) - 80) / 1968.0) AS BIGINT) - 1))) AS n FROM w)),
 leaves AS (SELECT doc_id, p, n, list_slice(ws, n * 320 + 1, n * 320 + 400) AS ws FROM (SELECT doc_id, n AS p, ws, unnest(generate_series(0, greatest(0, CAST(ceil((len(ws) - 80) / 320.0) AS BIGINT) - 1))) AS n FROM roots))"""


@query(f"{CHUNKS} SELECT 'd' || doc_id || '.' || n AS node_id, NULL AS parent_id, 0 AS level, md5(array_to_string(ws, ' ')) AS digest FROM roots UNION ALL SELECT 'd' || doc_id || '.' || p || '.' || n, 'd' || doc_id || '.' || p, 1, md5(array_to_string(ws, ' ')) FROM leaves")
def chunk_hierarchy(spark, sf_dir):
    return retrieval.chunks(table(spark, sf_dir, "documents")).select("node_id", "parent_id", "level", F.md5("text").alias("digest"))


# the hits of a ranked search over all roots
ROOT_HITS = f"""r AS (SELECT 'd' || doc_id || '.' || n AS node_id, {TOKENS.format("array_to_string(ws, ' ')")} AS ts FROM roots),
 h AS (SELECT node_id, {_bm25(['the', 'of', 'token', 'anstou'])} AS score FROM r WHERE len(list_intersect(ts, ['the', 'of', 'token', 'anstou'])) > 0 ORDER BY score DESC, node_id LIMIT 12)"""


@query(f"{CHUNKS}, {ROOT_HITS} SELECT h.node_id || '.' || l.n AS node_id, round(h.score, 6) AS score FROM leaves l JOIN h ON h.node_id = 'd' || l.doc_id || '.' || l.p")
def expand_leaves(spark, sf_dir):
    nodes = retrieval.chunks(table(spark, sf_dir, "documents"))
    hits = retrieval.lexical(nodes.where("level = 0"), RERANK_QUESTION, any_word=True)
    return retrieval.leaves(hits, nodes).withColumn("score", F.round("score", 6))


@query(f"""WITH RECURSIVE {CHUNKS.removeprefix('WITH ')}, {ROOT_HITS},
 thirds AS (SELECT doc_id, p, n, k, list_slice(ws, k * 70 + 1, k * 70 + 150) AS ws FROM (SELECT doc_id, p, n, ws, unnest(generate_series(0, greatest(0, CAST(ceil((len(ws) - 80) / 70.0) AS BIGINT) - 1))) AS k FROM leaves)),
 t AS (SELECT 'd' || doc_id || '.' || n AS id, CAST(NULL AS VARCHAR) AS up FROM roots UNION ALL SELECT 'd' || doc_id || '.' || p || '.' || n, 'd' || doc_id || '.' || p FROM leaves
   UNION ALL SELECT 'd' || doc_id || '.' || p || '.' || n || '.' || k, 'd' || doc_id || '.' || p || '.' || n FROM thirds WHERE n % 2 = 0),
 r AS (SELECT node_id AS hit, node_id AS id, score FROM h UNION ALL SELECT r.hit, t.id, r.score FROM r JOIN t ON t.up = r.id)
SELECT id AS node_id, round(score, 6) AS score FROM r WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.up = r.id)""".replace("r AS (SELECT 'd'", "rr AS (SELECT 'd'", 1).replace("FROM r WHERE len(", "FROM rr WHERE len(", 1))
def expand_tree(spark, sf_dir):
    """Hits among the roots of a tree of three levels, every second branch of which ends at the second."""
    nodes = retrieval.chunks(table(spark, sf_dir, "documents"), (2048, 400, 150))
    nodes = nodes.where("level < 2 or cast(element_at(split(parent_id, '[.]'), -1) as int) % 2 = 0")
    hits = retrieval.lexical(nodes.where("level = 0"), RERANK_QUESTION, any_word=True)
    return trees.leaves(hits, trees.numbered(nodes.drop("text"))).withColumn("score", F.round("score", 6))


# --- SQL as data -----------------------------------------------------------------------------------------------

#: Forms of statements: (number, class, SQL).
FORMS = [
    (1, "EASY", "SELECT COUNT(*) FROM orders"),
    (2, "NON-NESTED", "SELECT c.c_name, SUM(o.o_totalprice) FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_name HAVING SUM(o.o_totalprice) > 10"),
    (3, "NESTED", "WITH t AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) SELECT c.c_name FROM customer c JOIN t ON t.o_custkey = c.c_custkey WHERE t.n > 3 AND c.c_acctbal BETWEEN 0 AND 100 ORDER BY c.c_name LIMIT 5"),
    (4, "NESTED", "SELECT s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 40)"),
    (5, "NON-NESTED", "SELECT DISTINCT o.o_orderkey, MAX(l.l_quantity) FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'O' GROUP BY o.o_orderkey"),
    (6, "FILTER_BI", "SELECT * FROM movement WHERE status = 'A' AND NOT customer LIKE '%X%'"),
]
FORM = "item_id % 6 + 1"


def _pool(spark: SparkSession, sf_dir: str, *forms: int) -> list[tuple[int, int, str]]:
    """(item, form, statement): every item of the benchmark as a question, with a statement of the form that its number
    gives. A pool of examples is what prompts are made of; it is parsed on the driver, a statement at a time."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.expr(FORM).cast("int").alias("form"), F.regexp_replace(F.coalesce("text", F.lit("")), "[*]/", " ").alias("text")).orderBy("item_id")
    sql = {i: q for i, _, q in FORMS}
    return [(r["item_id"], r["form"], f"/* {r['text']} */\n{sql[r['form']]}") for r in items.collect() if not forms or r["form"] in forms]


def _skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sqlast.pool_skeletons(spark, [(i, q) for i, _, q in _pool(spark, sf_dir)])


OF_FORMS = """SELECT * FROM (VALUES
 (1, ['orders'], 0, false, false, false, false, ['count'], 4), (2, ['customer', 'orders'], 1, true, true, false, false, ['sum'], 19),
 (3, ['customer', 'orders'], 1, true, false, false, true, ['count'], 20), (4, ['lineitem', 'supplier'], 0, false, false, true, false, CAST([] AS VARCHAR[]), 12),
 (5, ['lineitem', 'orders'], 1, true, false, false, false, ['max'], 14), (6, ['movement'], 0, false, false, false, false, CAST([] AS VARCHAR[]), 2))
 AS s(form, tables, n_joins, has_group_by, has_having, has_subquery, has_cte, aggregates, complexity)"""
SKELETONS = f"SELECT q.item_id AS id, f.* FROM benchmark q JOIN ({OF_FORMS}) f ON f.form = q.{FORM}"


@query(f"SELECT id, array_to_string(tables, ',') AS tables, n_joins, has_group_by, has_having, has_subquery, has_cte, array_to_string(aggregates, ',') AS aggregates, complexity FROM ({SKELETONS})")
def sql_skeletons(spark, sf_dir):
    return _skeletons(spark, sf_dir).select("id", F.array_join("tables", ",").alias("tables"), F.size("join_types").alias("n_joins"), "has_group_by", "has_having", "has_subquery", "has_cte", F.array_join("aggregates", ",").alias("aggregates"), "complexity")


def _jaccard(c: str) -> str:
    return f"(CASE WHEN len(a.{c}) + len(b.{c}) = 0 THEN 1.0 ELSE len(list_intersect(a.{c}, b.{c})) / CAST(len(list_distinct(list_concat(a.{c}, b.{c}))) AS DOUBLE) END)"


SCORE = f"""((CASE WHEN a.has_group_by = b.has_group_by THEN 3 ELSE 0 END) + (CASE WHEN a.has_having = b.has_having THEN 3 ELSE 0 END)
 + (CASE WHEN a.has_subquery = b.has_subquery THEN 3 ELSE 0 END) + (CASE WHEN a.has_cte = b.has_cte THEN 2 ELSE 0 END) + (CASE WHEN (a.n_joins > 0) = (b.n_joins > 0) THEN 2 ELSE 0 END)
 + 4 * {_jaccard('tables')} + 2 * {_jaccard('aggregates')} + 1 - abs(a.complexity - b.complexity) / CAST(greatest(a.complexity, b.complexity) AS DOUBLE)) / 20.0"""
SIMILARITY = f"SELECT a.id AS a, b.form AS b, {SCORE} AS score FROM ({SKELETONS}) a, ({OF_FORMS}) b"


def _forms(spark: SparkSession) -> DataFrame:
    """The skeletons of the forms: six rows."""
    return sqlast.pool_skeletons(spark, [(i, q) for i, _, q in FORMS])


@query(f"SELECT a, CAST(b AS BIGINT) AS b, round(score, 6) AS score FROM ({SIMILARITY})")
def skeleton_similarity(spark, sf_dir):
    """Every item's statement against each form."""
    pairs = _skeletons(spark, sf_dir).alias("a").crossJoin(F.broadcast(_forms(spark).alias("b")))  # six rows
    return pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.round(sqlast.similarity("a", "b"), 6).alias("score"))


COOCCUR = f"SELECT a.t AS t1, b.t AS t2, count(*) AS n FROM (SELECT id, unnest(tables) AS t FROM ({SKELETONS})) a JOIN (SELECT id, unnest(tables) AS t FROM ({SKELETONS})) b ON a.id = b.id AND a.t <> b.t GROUP BY 1, 2"


@query(COOCCUR)
def table_cooccurrence(spark, sf_dir):
    return sqlast.cooccurrence(_skeletons(spark, sf_dir))


RELATED = f"SELECT t1, t2, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY t1 ORDER BY n DESC, t2) AS INTEGER) AS rank FROM ({COOCCUR}))"


@query(f"{RELATED} WHERE rank <= 3")
def related_tables(spark, sf_dir):
    return sqlast.related(sqlast.cooccurrence(_skeletons(spark, sf_dir)))


@query(f"SELECT 'orders' AS table_name UNION SELECT t2 FROM ({RELATED}) WHERE t1 = 'orders' AND rank <= 2 AND n >= 3")
def bridge_tables(spark, sf_dir):
    found = sqlast.bridges(sqlast.cooccurrence(_skeletons(spark, sf_dir)), ["orders"], None)
    return spark.createDataFrame([(t,) for t in found], "table_name string")


@query(f"""SELECT q.item_id AS id, p.table_name, p.column_name FROM benchmark q JOIN (VALUES (2, 'customer', 'c_custkey'), (2, 'orders', 'o_custkey'), (3, 'customer', 'c_acctbal'), (3, 'customer', 'c_custkey'), (4, 'lineitem', 'l_quantity'), (4, 'lineitem', 'l_suppkey'), (4, 'supplier', 's_suppkey'),
 (5, 'lineitem', 'l_orderkey'), (5, 'orders', 'o_orderkey'), (5, 'orders', 'o_orderstatus')) AS p(form, table_name, column_name) ON p.form = q.{FORM}""")
def protected_columns(spark, sf_dir):
    columns = tables.catalog_columns(spark, sf_dir).groupBy("table_name").agg(F.collect_set("column_name").alias("cs"))
    held = {r["table_name"]: set(r["cs"]) for r in columns.collect()}
    rows = [(i, t, c) for i, _, q in _pool(spark, sf_dir) for t, cs in sqlast.protected(spark, q, held).items() for c in sorted(cs)]
    return spark.createDataFrame(rows, "id long, table_name string, column_name string")


@query(f"""SELECT q.item_id AS id, c.* EXCLUDE (form) FROM benchmark q JOIN (VALUES
 (1, 'count(*)', false, 'orders', '', '', '', '', NULL), (2, 'c_name|sum(o_totalprice)', false, 'customer|orders', '', 'c_name', 'sum(o_totalprice) >', '', NULL),
 (3, 'c_name', false, 'customer|t', 'c_acctbal between|n >', '', '', 'c_name', '5'), (4, 's_name', false, 'supplier', 's_suppkey in', '', '', '', NULL),
 (5, 'max(l_quantity)|o_orderkey', true, 'lineitem|orders', 'o_orderstatus =', 'o_orderkey', '', '', NULL), (6, '*', false, 'movement', 'customer not_like|status =', '', '', '', NULL))
 AS c(form, sel, is_distinct, frm, whr, grp, hav, ord, lim) ON c.form = q.{FORM}""")
def em_components(spark, sf_dir):
    rows = []
    for i, _, q in _pool(spark, sf_dir):
        c = sqlast.components(spark, q)
        parts = [sorted(c["select"]), c["distinct"], sorted(c["from"]), sorted(map(" ".join, c["where"])), sorted(c["group_by"]), sorted(map(" ".join, c["having"])), list(c["order_by"]), c["limit"]]
        rows.append((i, *["|".join(x) if isinstance(x, list) else x for x in parts]))
    return spark.createDataFrame(rows, "id long, sel string, is_distinct boolean, frm string, whr string, grp string, hav string, ord string, lim string")


@query("SELECT * FROM (VALUES ('same', 1), ('bag', 0), ('columns', 0), ('broken', 0), ('match', 1), ('differs', 0)) AS t(test, score)")
def ex_compare(spark, sf_dir):
    views(spark, sf_dir, "orders", "nation")
    a = "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus"
    twice = spark.sql("SELECT n_name FROM nation UNION ALL SELECT n_name FROM nation")
    rows = [
        ("same", evaluation.execution_accuracy(spark, "SELECT n, upper(o_orderstatus) || ' ' AS o_orderstatus FROM (" + a + ") ORDER BY n", a)),
        ("bag", int(evaluation.same_rows(twice, spark.table("nation").select("n_name"), bag=True))),
        ("columns", evaluation.execution_accuracy(spark, "SELECT 1 AS x", a)),
        ("broken", evaluation.execution_accuracy(spark, "SELECT nothing FROM nowhere", a)),
        ("match", evaluation.exact_match(spark, "SELECT x.n_name FROM nation x WHERE x.n_regionkey = 1", "SELECT n_name FROM nation WHERE n_regionkey = 2")),
        ("differs", evaluation.exact_match(spark, "SELECT n_name FROM nation LIMIT 5", "SELECT n_name FROM nation LIMIT 6")),
    ]
    return spark.createDataFrame(rows, "test string, score int")


#: Statements by kind, each about an item: what validation says of them.
KINDS = """(VALUES (0, 'SELECT n_name FROM nation WHERE n_nationkey = #;', true, ''), (1, 'SELECT nme FROM nation WHERE n_nationkey = #', false, 'UNRESOLVED_COLUMN.WITH_SUGGESTION'), (2, 'SELECT # FROM nationz', false, 'TABLE_OR_VIEW_NOT_FOUND'),
 (3, 'SELECT (# FROM nation', false, 'PARSE_SYNTAX_ERROR'), (4, 'DROP TABLE nation', false, 'NOT_A_QUERY'), (5, 'SELECT /*+ BROADCAST(nation) */ # FROM nation', true, ''), (6, 'VALUES (#)', true, '')) AS k(kind, sql, valid, condition)"""


def _kinds(spark: SparkSession, sf_dir: str) -> list[tuple[int, str]]:
    views(spark, sf_dir, "nation", "benchmark")
    return [tuple(r) for r in spark.sql(f"SELECT item_id, replace(sql, '#', CAST(item_id AS STRING)) FROM benchmark JOIN {KINDS} ON kind = item_id % 7 ORDER BY 1").collect()]


@query(f"SELECT item_id AS id, valid, condition FROM benchmark JOIN {KINDS} ON kind = item_id % 7")
def validate_sql(spark, sf_dir):
    rows = [(i, *validate.check(spark, q)[:2]) for i, q in _kinds(spark, sf_dir)]
    return spark.createDataFrame(rows, "id long, valid boolean, condition string")


@query(f"SELECT item_id AS id, CASE WHEN valid THEN 1 ELSE 2 END AS attempts, true AS valid FROM benchmark JOIN {KINDS} ON kind = item_id % 7")
def self_correct(spark, sf_dir):
    """Each item's statement as a first reply, and one that is right as the second."""
    rows = []
    for i, q in _kinds(spark, sf_dir):
        done = validate.correct(spark, lambda question, tried, ddl, q=q: "SELECT n_name FROM nation" if tried else q, "names?", "nation(n_name)", "nation(n_nationkey, n_name)")
        rows.append((i, len(done.attempts), done.valid))
    return spark.createDataFrame(rows, "id long, attempts int, valid boolean")


# --- schema ----------------------------------------------------------------------------------------------------

#: The given tables as they are described, for the twins.
DESCRIBED = """region: r_regionkey INT, r_name STRING; nation: n_nationkey INT, n_name STRING, n_regionkey INT; customer: c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING;
supplier: s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE; part: p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE;
orders: o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING;
lineitem: l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ;
events: event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING; documents: doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT; embeddings: vec_id BIGINT, embedding ARRAY<FLOAT>, label INT;
pages: page_id BIGINT, url STRING, html STRING; benchmark: item_id BIGINT, text STRING; labels: doc_id BIGINT, quality INT, toxic INT; conversations: conv_id BIGINT, turn BIGINT, role STRING, text STRING"""


def _described() -> list[tuple]:
    fks = {(t, c) for t, c, _, _ in tables.FOREIGN_KEYS}
    found = [(t.strip(), i, *c.split()) for t, cs in (x.split(":") for x in DESCRIBED.split(";")) for i, c in enumerate(cs.split(","), 1)]
    return [(t, i, c, kind, tables.PRIMARY_KEYS.get(t) == c, (t, c) in fks) for t, i, c, kind in found]


CATALOG = "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {i}, '{c}', '{k}', {str(pk).lower()}, {str(fk).lower()})" for t, i, c, k, pk, fk in _described()) + ") AS c(table_name, ordinal, column_name, data_type, is_pk, is_fk)"
FKS = "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', '{d}')" for a, b, c, d in tables.FOREIGN_KEYS) + ") AS f(table_name, column_name, ref_table, ref_column)"
KEPT = "(is_pk OR is_fk OR data_type LIKE '%TIME%')"


@query(CATALOG)
def catalog_columns(spark, sf_dir):
    return tables.catalog_columns(spark, sf_dir).select("table_name", "ordinal", "column_name", "data_type", "is_pk", "is_fk")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in tables.TABLES))
def catalog_tables(spark, sf_dir):
    return tables.visible(tables.row_counts(spark, sf_dir))


@query("SELECT table_name FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in tables.TABLES) + ") WHERE n > 0 AND table_name NOT IN ('labels')")
def nonempty_tables(spark, sf_dir):
    return tables.row_counts(spark, sf_dir).where("row_count > 0").where(~F.col("table_name").isin("labels")).select("table_name")


DDL = f"""SELECT c.table_name, 'CREATE TABLE public.' || c.table_name || ' (' || chr(10) || cols || chr(10) || ');' || chr(10) || coalesce(refs, '') AS ddl FROM
 (SELECT table_name, string_agg('    ' || column_name || ' ' || data_type || CASE WHEN is_pk THEN ' PRIMARY KEY' ELSE '' END, ',' || chr(10) ORDER BY ordinal) AS cols FROM ({CATALOG}) GROUP BY 1) c
 LEFT JOIN (SELECT table_name, string_agg('-- FOREIGN KEY (' || column_name || ') REFERENCES public.' || ref_table || '(' || ref_column || ')', chr(10) ORDER BY column_name) AS refs FROM ({FKS}) GROUP BY 1) r ON r.table_name = c.table_name"""


@query(DDL)
def schema_ddl(spark, sf_dir):
    return schema.ddl(tables.catalog_columns(spark, sf_dir), tables.catalog_fks(spark))


@query(f"SELECT table_name, column_name FROM ({CATALOG}) WHERE {KEPT} OR (table_name = 'customer' AND column_name = 'c_acctbal')")
def schema_pruned_columns(spark, sf_dir):
    return schema.linked(schema.pruned(tables.catalog_columns(spark, sf_dir)), [("customer", "c_acctbal")]).select("table_name", "column_name")


@query(f"""WITH t AS (SELECT DISTINCT table_name AS t FROM ({CATALOG})) SELECT a.t AS t1, b.t AS t2 FROM t a JOIN t b ON a.t < b.t
 WHERE NOT EXISTS (SELECT 1 FROM ({FKS}) f WHERE (f.table_name = a.t AND f.ref_table = b.t) OR (f.table_name = b.t AND f.ref_table = a.t))""")
def missing_fk_pairs(spark, sf_dir):
    return schema.missing_fks(tables.catalog_columns(spark, sf_dir).select("table_name").distinct(), tables.catalog_fks(spark))


@query(f"SELECT table_name, count(*) AS raw_columns, count(*) FILTER ({KEPT}) AS kept_columns, round(1 - count(*) FILTER ({KEPT}) / CAST(count(*) AS DOUBLE), 4) AS rate FROM ({CATALOG}) GROUP BY 1")
def schema_shortening(spark, sf_dir):
    raw = tables.catalog_columns(spark, sf_dir)
    # names of another case and with a schema are of the same tables
    named = raw.select(F.concat(F.lit("Public."), F.initcap("table_name")).alias("table_name")).distinct()
    counts = schema.raw_columns(named, raw).select(schema.bare(F.col("table_name")).alias("table_name"), "raw_columns")
    text_ = schema.filter_ddl(raw).select("table_name", schema.ddl_columns(F.col("ddl")).cast("bigint").alias("kept_columns"))
    held = counts.join(text_, "table_name", "left").withColumn("kept_columns", F.coalesce("kept_columns", F.lit(0)))
    return held.withColumn("rate", evaluation.shortening(F.col("raw_columns"), F.col("kept_columns")))


@query(f"SELECT table_name, sha256('pruning:true|no_table_comment|' || string_agg(column_name || ':' || data_type || ':None:' || is_pk || ':' || is_fk, '|' ORDER BY ordinal)) AS hash FROM ({CATALOG}) GROUP BY 1".replace("pruning:true", "pruning:True"))
def schema_hashes(spark, sf_dir):
    return text.schema_hash(tables.catalog_columns(spark, sf_dir))


# --- feedback and index ----------------------------------------------------------------------------------------

STORE = "SELECT min(text) AS pergunta, 'SELECT ' || conv_id AS sql_gerado, 'old' AS resposta_final, CASE WHEN conv_id % 3 = 0 THEN 'VALIDADO' ELSE 'PENDENTE' END AS status_validacao, CAST(conv_id % 5 AS INTEGER) AS uso_count, CAST(conv_id AS BIGINT) AS data_criacao FROM conversations WHERE role = 'user' AND turn = 0 GROUP BY conv_id"


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first user turns as a feedback table: one row per question, the latest of equal ones."""
    views(spark, sf_dir, "conversations")
    latest = Window.partitionBy("pergunta").orderBy(F.desc("data_criacao"))
    return spark.sql(STORE).withColumn("rn", F.row_number().over(latest)).where("rn = 1").drop("rn")


STORED = f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY pergunta ORDER BY data_criacao DESC) AS rn FROM ({STORE})) WHERE rn = 1"
ANSWERS = f"SELECT pergunta, 'SELECT new' AS sql_gerado, 'new' AS resposta_final, CAST(1000000 AS BIGINT) AS em FROM ({STORED}) WHERE data_criacao % 2 = 0 UNION ALL SELECT 'a new question', 'SELECT 1', 'one', CAST(1000001 AS BIGINT)"


@query(f"""WITH s AS ({STORED}), a AS ({ANSWERS}) SELECT coalesce(s.pergunta, a.pergunta) AS pergunta, coalesce(s.sql_gerado, a.sql_gerado) AS sql_gerado, coalesce(a.resposta_final, s.resposta_final) AS resposta_final,
 CASE WHEN a.pergunta IS NOT NULL THEN 'PENDENTE' ELSE s.status_validacao END AS status_validacao, CASE WHEN a.pergunta IS NULL THEN s.uso_count WHEN s.pergunta IS NULL THEN 0 ELSE s.uso_count + 1 END AS uso_count, coalesce(a.em, s.data_criacao) AS data_criacao
 FROM s FULL JOIN a ON s.pergunta = a.pergunta""")
def feedback_upsert(spark, sf_dir):
    s = _store(spark, sf_dir)
    known = s.where("data_criacao % 2 = 0").select("pergunta", F.lit("SELECT new").alias("sql_gerado"), F.lit("new").alias("resposta_final"), F.lit(1000000).cast("bigint").alias("em"))
    fresh = spark.createDataFrame([("a new question", "SELECT 1", "one", 1000001)], "pergunta string, sql_gerado string, resposta_final string, em long")
    return feedback.upsert(s, known.union(fresh))


@query(f"SELECT pergunta, sql_gerado AS sql FROM ({STORED}) WHERE status_validacao = 'VALIDADO' ORDER BY data_criacao DESC NULLS LAST, uso_count DESC NULLS LAST, pergunta LIMIT 20")
def feedback_top_validated(spark, sf_dir):
    return feedback.validated(_store(spark, sf_dir))


#: Every turn of every conversation as an answer to the first turn that its conversation's number picks, so that questions repeat.
TURNS = """SELECT coalesce(text, '') || CASE WHEN conv_id % 3 = 0 THEN '' ELSE ' ' || CAST(turn % 2 AS VARCHAR(9)) END AS pergunta, 'SELECT ' || conv_id || ' FROM t' || turn AS sql_gerado, 'answer ' || conv_id || '.' || turn AS resposta_final,
 CAST(conv_id * 1000 + turn AS BIGINT) AS em FROM conversations"""
EARLY, LATE = f"SELECT * FROM ({TURNS}) WHERE em % 3 <> 0", f"SELECT * FROM ({TURNS}) WHERE em % 3 = 0"
FOLDED = f"""WITH e AS (SELECT *, 0 AS late FROM ({EARLY}) UNION ALL SELECT *, 1 FROM ({LATE})),
 o AS (SELECT *, row_number() OVER (PARTITION BY pergunta ORDER BY late, em, sql_gerado, resposta_final) AS first, row_number() OVER (PARTITION BY pergunta ORDER BY late DESC, em DESC, sql_gerado DESC, resposta_final DESC) AS last FROM e),
 f AS (SELECT pergunta, max(CASE WHEN first = 1 THEN sql_gerado END) AS sql_gerado, max(CASE WHEN last = 1 THEN resposta_final END) AS resposta_final, CAST(count(*) - 1 AS INTEGER) AS uso_count, max(CASE WHEN last = 1 THEN em END) AS data_criacao FROM o GROUP BY 1)"""
HASHED = "md5(pergunta)"


def _answers(spark: SparkSession, sf_dir: str) -> answers.Answers:
    """A stored table that has taken up all turns in two merges; then every question of an even time is validated."""
    views(spark, sf_dir, "conversations")
    store = answers.Answers(spark, versions.new_path(spark, "answers"), "bigint")
    digest = F.md5("pergunta")
    vector = F.array(*[F.conv(F.substring(digest, 1 + 4 * i, 4), 16, 10).cast("double") for i in range(8)])
    for part in (EARLY, LATE):
        store.merge(spark.sql(part).withColumn("pergunta_embedding", vector))
    store.validate(store.rows().where("data_criacao % 2 = 0"))
    return store


@query(f"{FOLDED} SELECT *, CASE WHEN data_criacao % 2 = 0 THEN 'VALIDADO' ELSE 'PENDENTE' END AS status_validacao FROM f")
def feedback_stored(spark, sf_dir):
    return _answers(spark, sf_dir).rows().drop("pergunta_embedding")


@query(f"""{FOLDED}, v AS (SELECT *, list_transform(range(8), lambda i: CAST(CAST('0x' || substr({HASHED}, CAST(1 + 4 * i AS BIGINT), 4) AS BIGINT) AS DOUBLE)) AS x FROM f WHERE data_criacao % 2 = 0),
 q AS (SELECT x FROM v ORDER BY data_criacao DESC, pergunta LIMIT 1)
SELECT pergunta, resposta_final FROM v, q WHERE 1 - list_dot_product(v.x, q.x) / (sqrt(list_dot_product(v.x, v.x)) * sqrt(list_dot_product(q.x, q.x))) < 0.02
 ORDER BY round(1 - list_dot_product(v.x, q.x) / (sqrt(list_dot_product(v.x, v.x)) * sqrt(list_dot_product(q.x, q.x))), 12), pergunta LIMIT 1""")
def feedback_cached(spark, sf_dir):
    """The cache's answer to the latest validated question, from what was stored."""
    store = _answers(spark, sf_dir)
    asked = store.rows().where("status_validacao = 'VALIDADO'").orderBy(F.desc("data_criacao"), "pergunta").first()
    return store.cached(asked["pergunta_embedding"] if asked else [0.0] * 8).select("pergunta", "resposta_final")


BEFORE = "SELECT 'doc' || doc_id AS file_name, sha256(text) AS hash FROM documents WHERE doc_id % 10 <> 0"
NOW = "SELECT 'doc' || doc_id AS file_name, sha256(CASE WHEN doc_id % 10 = 1 THEN text || '.' ELSE text END) AS hash FROM documents WHERE doc_id % 10 <> 2"


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of a folder: some documents are new, some gone, some edited since."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("file_name"), "doc_id", "text")
    edited = F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    before = docs.where("doc_id % 10 <> 0").select("file_name", F.sha2("text", 256).alias("hash"))
    return before, docs.where("doc_id % 10 <> 2").select("file_name", F.sha2(edited, 256).alias("hash"))


@query(f"SELECT coalesce(b.file_name, n.file_name) AS file_name, CASE WHEN b.file_name IS NULL THEN 'added' WHEN n.file_name IS NULL THEN 'removed' ELSE 'changed' END AS change FROM ({BEFORE}) b FULL JOIN ({NOW}) n ON b.file_name = n.file_name WHERE b.hash IS DISTINCT FROM n.hash OR b.file_name IS NULL OR n.file_name IS NULL")
def index_diff_files(spark, sf_dir):
    before, now = _snapshots(spark, sf_dir)
    return feedback.changes(before, now, "file_name")


@query(NOW)
def index_synced_files(spark, sf_dir):
    before, now = _snapshots(spark, sf_dir)
    return feedback.synced(before, feedback.changes(before, now, "file_name"), now, "file_name").select("file_name", "hash")


@query("SELECT * FROM (VALUES ('customer', 'changed'), ('region', 'removed'), ('part', 'added')) AS t(table_name, change)")
def index_diff_tables(spark, sf_dir):
    known = [t for t in tables.TABLES if t != "part"], [t for t in tables.TABLES if t != "region"]
    before = text.schema_hash(tables.catalog_columns(spark, sf_dir, known[0]))
    now = text.schema_hash(tables.catalog_columns(spark, sf_dir, known[1]).where("column_name <> 'c_acctbal'"))
    return feedback.changes(before, now, "table_name")


# --- examples and evaluation -----------------------------------------------------------------------------------


@query(f"""WITH s AS (SELECT a AS id, score FROM ({SIMILARITY}) WHERE b = 2) SELECT id, round(0.5 * {COS} + 0.5 * s.score, 6) AS score
 FROM s JOIN embeddings a ON a.vec_id = s.id, embeddings b WHERE b.vec_id = 0 ORDER BY 0.5 * {COS} + 0.5 * s.score DESC, 1 LIMIT 4""")
def fewshot_hybrid(spark, sf_dir):
    """Items as examples, against a question with the vector 0 and a guess of the second form."""
    guess = _forms(spark).where("id = 2").alias("b")  # one row
    scored = _skeletons(spark, sf_dir).alias("a").crossJoin(F.broadcast(guess)).select(F.col("a.id").alias("id"), sqlast.similarity("a", "b").alias("struct"))
    held = scored.join(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id"), "id")
    return retrieval.few_shots(held, _vector(spark, sf_dir, 0), F.col("struct"), 4).select("id", F.round("score", 6).alias("score"))


CLASS_OF = "CASE item_id % 6 + 1 " + " ".join(f"WHEN {i} THEN '{d}'" for i, d, _ in FORMS) + " END"


@query(f"SELECT p.item_id AS id, p.dificuldade, round({COS}, 6) AS score FROM (SELECT item_id, {CLASS_OF} AS dificuldade FROM benchmark) p JOIN embeddings a ON a.vec_id = p.item_id, embeddings b WHERE b.vec_id = 0 AND p.dificuldade = 'NESTED' ORDER BY {COS} DESC, 1 LIMIT 3")
def fewshot_classification(spark, sf_dir):
    pool = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.expr(CLASS_OF).alias("dificuldade"))
    held = retrieval.of_class(pool.where("dificuldade is not null"), "NESTED").join(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id"), "id")
    return retrieval.few_shots(held, _vector(spark, sf_dir, 0), None, 3, alpha=1.0).select("id", "dificuldade", F.round("score", 6).alias("score"))


@query(f"""SELECT item_id, rank, node_id, score FROM (SELECT q.item_id, a.vec_id AS node_id, round({COS}, 6) AS score, CAST(row_number() OVER (PARTITION BY q.item_id ORDER BY {COS} DESC, a.vec_id) AS INTEGER) AS rank
 FROM benchmark q JOIN embeddings b ON b.vec_id = q.item_id, embeddings a) WHERE rank <= 4""")
def fewshot_many(spark, sf_dir):
    """The four nearest of all vectors for every item, all items at once."""
    vecs = table(spark, sf_dir, "embeddings")
    asked = table(spark, sf_dir, "benchmark").select("item_id").join(vecs, F.col("item_id") == F.col("vec_id")).select("item_id", "embedding")
    found = many.nearest(vecs, asked, 4, node="vec_id", question="item_id")
    return found.select("item_id", "rank", F.col("vec_id").alias("node_id"), F.round("score", 6).alias("score"))


COUNTS = "SELECT event_type, coalesce(json_extract_string(props, '$.k'), '') AS k, count(*) AS n FROM events GROUP BY 1, 2"


@query(f"""SELECT event_type, count(*) AS n_keys, string_agg(k || ':' || n, ',' ORDER BY k) AS counts, coalesce(max(n) FILTER (k = '7'), 0) AS of_7, CAST(-1 AS BIGINT) AS of_none, string_agg(k || ':' || 2 * n, ',' ORDER BY k) AS twice
 FROM ({COUNTS}) GROUP BY 1""")
def event_counters(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    found = maps.counters(events, ["event_type"], "k")
    c = F.col("counts")
    return found.select("event_type", F.size(c).cast("long").alias("n_keys"), maps.text(c).alias("counts"), maps.lookup(c, "7", 0).cast("long").alias("of_7"), maps.lookup(c, "none such", -1).cast("long").alias("of_none"), maps.text(maps.merged(c, c)).alias("twice"))


@query("""SELECT doc_id, quality, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY CAST('0x' || substr(md5('42:' || doc_id), 1, 15) AS BIGINT), doc_id) <= ceil(count(*) OVER (PARTITION BY quality) * 0.2)
 THEN 'test' ELSE 'pool' END AS part FROM labels""")
def stratified_split(spark, sf_dir):
    return evaluation.stratified_split(table(spark, sf_dir, "labels"), "quality", "doc_id").select("doc_id", "quality", "part")


LINE = "c_custkey || ' | ' || c_name || ' | ' || coalesce(c_mktsegment, '')"


@query(f"SELECT c_custkey, line, CAST(used AS BIGINT) AS used FROM (SELECT c_custkey, {LINE} AS line, sum(length({LINE}) + 1) OVER (ORDER BY c_custkey ROWS UNBOUNDED PRECEDING) AS used FROM customer) WHERE used <= 3000")
def rows_to_text_budget(spark, sf_dir):
    line = F.concat_ws(" | ", F.col("c_custkey").cast("string"), "c_name", F.coalesce("c_mktsegment", F.lit("")))
    held = table(spark, sf_dir, "customer").select("c_custkey", line.alias("line"))
    return movement.running_budget(held, "line", "c_custkey", 3000)


# --- text ------------------------------------------------------------------------------------------------------

#: Replies of a model, made of every turn of the conversations: prose with a statement in some form, or without.
REPLY = """CASE (conv_id + turn) % 5 WHEN 0 THEN 'Here: ```sql' || chr(10) || 'SELECT a' || conv_id || ' FROM t;' || chr(10) || '``` ' || coalesce(text, '')
 WHEN 1 THEN 'with x as (select ' || chr(39) || ';' || chr(39) || ' as s) select s from x' || turn || '; drop table t'
 WHEN 2 THEN coalesce(text, '')
 WHEN 3 THEN 'SELECT customer, net_total, a' || conv_id || ' FROM movement WHERE status = 1 SELECT customer, net_total, a' || conv_id || ' FROM movement WHERE status = 1'
 ELSE 'SELECT customer, net_total, a' || conv_id || ' FROM movement UNION ALL SELECT customer, net_total, a' || conv_id || ' FROM movement' END"""
REPLIES = f"SELECT conv_id, turn, {REPLY} AS reply FROM conversations"
PLAIN = "trim(regexp_replace(reply, '```(?:sql)?', '', 'gi'))"
FOUND = f"regexp_extract({PLAIN}, '(?is)\\b((?:SELECT|WITH)\\b(?:[^;'']|''[^'']*'')*)', 1)"
PURE = f"CASE WHEN {FOUND} = '' THEN {PLAIN} ELSE rtrim({FOUND}) || ';' END"


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "conversations")
    return spark.sql(REPLIES)


@query(f"SELECT conv_id, turn, {PURE} AS sql FROM ({REPLIES})")
def pure_sql(spark, sf_dir):
    return _replies(spark, sf_dir).select("conv_id", "turn", text.pure_sql(F.col("reply")).alias("sql"))


@query(f"""WITH p AS (SELECT conv_id, turn, reply, regexp_replace({PURE}, ';$', '') AS s FROM ({REPLIES})),
 a AS (SELECT *, CASE WHEN length(s) > 40 THEN instr(substr(s, 41), substr(s, 1, 40)) ELSE 0 END AS again FROM p),
 b AS (SELECT *, rtrim(substr(s, 1, 40 + again - 1)) AS before FROM a)
SELECT conv_id, turn, CASE WHEN trim(reply) = '' THEN '' WHEN again > 0 AND NOT regexp_matches(before, '(?i)\\b(UNION|INTERSECT|EXCEPT|ALL)$') THEN before || ';' ELSE s || ';' END AS sql FROM b""")
def clean_sql(spark, sf_dir):
    return _replies(spark, sf_dir).select("conv_id", "turn", text.clean_sql(F.col("reply")).alias("sql"))


CLASS = "coalesce(text, '') || CASE (conv_id + turn) % 5 WHEN 0 THEN ' It is NON-NESTED.' WHEN 1 THEN ' nested' WHEN 2 THEN ' Easy one' WHEN 3 THEN ' ?' ELSE ' non_nested' END"


@query(f"SELECT conv_id, turn, CASE WHEN contains(u, 'NON-NESTED') OR contains(u, 'NON_NESTED') THEN 'NON-NESTED' WHEN contains(u, 'NESTED') THEN 'NESTED' WHEN contains(u, 'EASY') THEN 'EASY' ELSE 'NON-NESTED' END AS difficulty FROM (SELECT conv_id, turn, upper({CLASS}) AS u FROM conversations)")
def difficulty_parse(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.difficulty(F.expr(CLASS)).alias("difficulty"))


RUN = "CAST((conv_id * 37 + turn) % 300 AS DOUBLE) AS latency, CASE conv_id % 7 WHEN 0 THEN 'Timed out' WHEN 1 THEN 'Desculpe, nada' ELSE coalesce(text, '') END AS answer, CASE (conv_id + turn) % 4 WHEN 0 THEN ' ' ELSE 'SELECT 1' END AS sql, CAST((conv_id + turn) % 2 AS INTEGER) AS ex"


@query(f"SELECT conv_id, turn, CASE WHEN latency >= 180 OR contains(answer, 'Timed out') THEN 'TIMEOUT_API' WHEN contains(lower(answer), 'desculpe') OR trim(sql) = '' THEN 'FALHA_GERACAO_SQL' WHEN ex = 1 THEN 'OK' ELSE 'ERRO_LOGICO_SQL' END AS status FROM (SELECT conv_id, turn, {RUN} FROM conversations)")
def status_parse(spark, sf_dir):
    views(spark, sf_dir, "conversations")
    runs = spark.sql(f"SELECT conv_id, turn, {RUN} FROM conversations")
    return runs.select("conv_id", "turn", text.status(F.col("latency"), F.col("answer"), F.col("sql"), F.col("ex")).alias("status"))


@query("SELECT word, strip_accents(word) AS plain FROM (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS word FROM documents) WHERE word <> ''")
def normalize_identifiers(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.split(F.lower("text"), "[^\\p{L}]+"))).alias("word")).where("word <> ''").distinct()
    return words.select("word", text.normalize_identifier("word").alias("plain"))


PROMPT = "'[INST]' || coalesce(text, '') || '[/IN[INST]ST]' || role || '[/IN[/INST]ST]'"


@query("SELECT conv_id, turn, coalesce(text, '') || role AS text FROM conversations")
def sanitised_prompts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.sanitised(F.expr(PROMPT)).alias("text"))


NOTED = "conv_id, turn, coalesce(text, '') || chr(10) || CASE turn % 3 WHEN 0 THEN 'Choice: ' || (conv_id % 9) || '. Reason: of turn ' || turn WHEN 1 THEN 'choice is ' || conv_id ELSE 'none' END AS reply"


@query(f"SELECT conv_id, turn, TRY_CAST(nullif(regexp_extract(reply, '(?i)Choice\\D*(\\d+)', 1), '') AS INTEGER) AS choice, trim(regexp_extract(reply, '(?is)Reason:\\s*(.*)', 1)) AS reason FROM (SELECT {NOTED} FROM conversations)")
def selector_replies(spark, sf_dir):
    """What a selector's free text chooses, and why."""
    views(spark, sf_dir, "conversations")
    found = spark.sql(f"SELECT {NOTED} FROM conversations").select("conv_id", "turn", text.choice(F.col("reply")).alias("c"))
    return found.select("conv_id", "turn", "c.choice", "c.reason")


@query("SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 0 ELSE 2 END AS n_items, CASE WHEN turn % 4 = 3 THEN NULL ELSE conv_id + turn END AS total, CASE WHEN turn % 4 = 3 THEN NULL ELSE 'q' || turn END AS first FROM conversations")
def json_replies(spark, sf_dir):
    """Lists in replies: bare, fenced, fenced with a name, or none."""
    body = F.format_string('[{"q": "q%d", "n": %d}, {"q": "other", "n": %d}]', "turn", "conv_id", "turn")
    fence = lambda name: F.concat(F.lit(f"So:\n```{name}\n"), body, F.lit("\n``` and more"))
    reply = F.when(F.col("turn") % 4 == 0, body).when(F.col("turn") % 4 == 1, fence("json")).when(F.col("turn") % 4 == 2, fence("")).otherwise(F.coalesce("text", F.lit("")))
    found = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.json_list(reply, "struct<q:string,n:long>").alias("l"))
    total = F.when(F.size("l") > 0, F.aggregate("l", F.lit(0).cast("long"), lambda s, x: s + x["n"]))
    return found.select("conv_id", "turn", F.size("l").alias("n_items"), total.alias("total"), F.get("l", 0)["q"].alias("first"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y %H:%M:%S') AS stamp, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS parsed, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
def order_dates(spark, sf_dir):
    """Times as the grid shows them, dates read from text (a third of it is none), years."""
    written = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.stamp(F.col("o_orderdate")).alias("stamp"), text.parsed_date(written).alias("parsed"), F.year("o_orderdate").alias("year"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'c' || conv_id || ',t' || turn ELSE '' END AS names, CASE WHEN turn % 2 = 0 THEN '' ELSE 'x.c' || conv_id END AS missing FROM conversations")
def names_in_texts(spark, sf_dir):
    """Tables that DDL makes, and the column that an error says isn't there."""
    ddl = F.concat(F.coalesce("text", F.lit("")), F.lit("\nCREATE TABLE public.t"), "turn", F.lit(" (a INT);\ncreate table c"), "conv_id", F.lit("(b INT); CREATE TABLE t"), "turn")
    error = F.concat(F.lit('ERROR: column "x.c'), "conv_id", F.lit('" does not exist LINE 1: '), F.coalesce("text", F.lit("")))
    reply = F.when(F.col("turn") % 2 == 0, ddl).otherwise(error)
    found = table(spark, sf_dir, "conversations").select("conv_id", "turn", reply.alias("r"))
    return found.select("conv_id", "turn", F.array_join(text.table_names(F.col("r")), ",").alias("names"), text.missing_name(F.col("r")).alias("missing"))


@query("SELECT o_orderkey AS id_movimento, CAST(1 + o_orderkey % 2 AS INTEGER) AS movement_type, CAST(o_orderdate AS DATE) AS movement_date, 'A' AS status, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS net_total, CAST(0 AS DOUBLE) AS gross_total FROM orders")
def renamed_fields(spark, sf_dir):
    """Rows by physical names and by logical ones."""
    o = table(spark, sf_dir, "orders")
    kind = (1 + F.col("o_orderkey") % 2).cast("int")
    rows = o.select(F.col("o_orderkey").alias("vwmo_id_movimento"), kind.alias("tipo_movimento"), F.col("o_orderdate").cast("date").alias("VWMO_DT_MOVIMENTO"), F.lit("A").alias("situacao"), F.col("o_totalprice").cast("decimal(18,2)").alias("vwmo_vl_total_liquido"))
    held = movement.as_rows(rows)
    return held.select(F.col("movement_id").alias("id_movimento"), "movement_type", "movement_date", "status", F.col("net_total").cast("double").alias("net_total"), F.col("gross_total").cast("double").alias("gross_total"))


@query("""WITH b AS (SELECT item_id, floor(item_id / 4) AS block, row_number() OVER (PARTITION BY floor(item_id / 4) ORDER BY item_id) AS i, coalesce(text, '') AS q FROM benchmark)
SELECT CAST(block AS BIGINT) AS block, string_agg('Exemplo ' || i || ':' || chr(10) || 'Pergunta: ' || q || chr(10) || 'SELECT ' || item_id, chr(10) || chr(10) ORDER BY i) AS shots,
 string_agg('- Pergunta: ' || chr(39) || q || chr(39) || ' | Classificação Correta: C' || (item_id % 3), chr(10) ORDER BY i) AS classes FROM b GROUP BY 1""")
def example_blocks(spark, sf_dir):
    """Blocks of examples as prompts show them, of every four items."""
    items = table(spark, sf_dir, "benchmark").select(F.floor(F.col("item_id") / 4).alias("block"), "item_id", F.coalesce("text", F.lit("")).alias("pergunta"), F.concat(F.lit("SELECT "), "item_id").alias("sql"), F.concat(F.lit("C"), F.col("item_id") % 3).alias("dificuldade"))
    listed = items.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("item_id", "pergunta", "sql", "dificuldade"))).alias("l"))
    return listed.select("block", text.shots_of(F.col("l")).alias("shots"), text.classes_of(F.col("l")).alias("classes"))


@query("SELECT table_name, row_count FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in tables.TABLES) + ") WHERE row_count > 0 AND table_name NOT IN ('labels') AND NOT contains(table_name, 'data_') AND NOT contains(table_name, 'tb_rag_feedback')")
def tables_to_ask_about(spark, sf_dir):
    """Tables with rows for which questions are made: none of the index's own, and not those skipped."""
    return evaluation.askable(tables.row_counts(spark, sf_dir), ("labels",))


@query("""SELECT a.vec_id, CAST(len(list_intersect([x, y, z], [x, y, 99])) AS INTEGER) AS common, CAST(len(list_distinct([x, y, z, 99])) AS INTEGER) AS n_union, array_to_string(list_sort([x, y, z]), ',') AS sorted, [x, y, z][2] AS second
 FROM (SELECT vec_id, CAST(vec_id % 3 AS INTEGER) AS x, CAST(vec_id % 5 AS INTEGER) AS y, CAST(label AS INTEGER) AS z FROM embeddings) a""")
def set_and_array_functions(spark, sf_dir):
    a = table(spark, sf_dir, "embeddings").select("vec_id", F.array((F.col("vec_id") % 3).cast("int"), (F.col("vec_id") % 5).cast("int"), F.col("label").cast("int")).alias("v"))
    other = F.array(F.get("v", 0), F.get("v", 1), F.lit(99))
    return a.select("vec_id", F.size(F.array_intersect("v", other)).alias("common"), F.size(F.array_union("v", F.array(F.lit(99)))).alias("n_union"), F.array_join(F.array_sort("v"), ",").alias("sorted"), F.element_at("v", 2).alias("second"))


# --- files and folders, and what is built on them --------------------------------------------------------------


@query("""SELECT item_id AS id, CASE item_id % 3 WHEN 0 THEN 'EASY' WHEN 1 THEN 'NESTED' END AS dificuldade, text AS pergunta, CASE WHEN item_id % 2 = 0 THEN 'SELECT ' || item_id ELSE 'SELECT -' || item_id END AS sql
 FROM benchmark WHERE trim(coalesce(text, '')) <> '' AND item_id % 5 <> 0""")
def example_pool(spark, sf_dir):
    """Items written as two JSON pools and read again; those without a statement (every fifth) are no examples."""
    folder = versions.new_path(spark, "pool")
    items = table(spark, sf_dir, "benchmark").orderBy("item_id").collect()  # a pool of examples is a short file
    kinds = {0: "EASY", 1: "NESTED", 2: None}

    def record(i: int, question: str | None) -> dict:
        sql = " " if i % 5 == 0 else f"SELECT {i}" if i % 2 == 0 else f"SELECT -{i}"
        # one pool has the statement where it is expected, the other where it was generated
        return {"id": i, "dificuldade": kinds[i % 3], "pergunta": question} | ({"sql_esperado": sql} if i % 2 == 0 else {"sql_esperado": "", "sql_gerado": sql})

    for part in (0, 1):
        files.write_json([record(r["item_id"], r["text"]) for r in items if r["item_id"] % 2 == part], f"{folder}/{part}.json", spark)
    pool = files.few_shot_pool(spark, f"{folder}/0.json", f"{folder}/1.json", f"{folder}/none.json")
    return retrieval.usable(pool.select("id", "dificuldade", "pergunta", files.example_sql(*files.POOL_ORDER).alias("sql")))


@query("SELECT 'item' || item_id || '.txt' AS file_name, coalesce(text, '') AS text FROM benchmark")
def document_folder(spark, sf_dir):
    """Items written as files of a folder and read again."""
    folder = versions.new_path(spark, "folder")
    for r in table(spark, sf_dir, "benchmark").collect():  # a folder of short manuals
        files.write_text(spark, r["text"] or "", f"{folder}/item{r['item_id']}.txt")
    return files.text_files(spark, folder)


LATER = "SELECT doc_id AS node_id, CASE WHEN doc_id % 100 = 1 THEN coalesce(text, '') || ' the of token edited' ELSE text END AS text FROM documents WHERE doc_id % 100 <> 2"


@query(f"""WITH n AS ({LATER}), t AS (SELECT node_id, {TOKENS.format('text')} AS ts FROM n), h AS (SELECT node_id, {_bm25(['the', 'of', 'token'])} AS score FROM t WHERE list_has_all(ts, ['the', 'of', 'token']) ORDER BY score DESC, node_id LIMIT 12)
 SELECT 'hit' AS what, node_id, round(score, 6) AS score FROM h UNION ALL SELECT 'node', node_id, 0 FROM n UNION ALL
 SELECT 'written', count(*) FILTER (doc_id % 100 < 2), 0 FROM documents""")
def index_kept_up(spark, sf_dir):
    """An index of documents after some are new, edited or gone (one of a hundred each): its nodes, the best hits of a
    question, and how many nodes the second segment has."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), "text")
    states = lambda nodes: nodes.select("node_id", F.sha2("text", 256).alias("hash"))
    edited = F.when(F.col("node_id") % 100 == 1, F.concat(F.coalesce("text", F.lit("")), F.lit(" the of token edited"))).otherwise(F.col("text"))
    before, now = docs.where("node_id % 100 <> 0"), docs.where("node_id % 100 <> 2").withColumn("text", edited)
    index = indexes.Index(spark, versions.new_path(spark, "kept-up"), key="node_id")
    index.sync(before, states(before), same_keys=True)
    index.sync(now, states(now), same_keys=True)
    hits = index.lexical(QUESTION, 12).select(F.lit("hit").alias("what"), "node_id", F.round("score", 6).alias("score"))
    nodes = index.nodes().select(F.lit("node").alias("what"), "node_id", F.lit(0.0).alias("score"))
    written = spark.createDataFrame([("written", index.content["rows"][str(index.segments[-1])], 0.0)], "what string, node_id long, score double")
    return hits.unionByName(nodes).unionByName(written)


@query(f"SELECT table_name, sha256('pruning:True|no_table_comment|' || string_agg(column_name || ':' || data_type || ':None:' || is_pk || ':' || is_fk, '|' ORDER BY ordinal)) AS hash FROM ({CATALOG}) GROUP BY 1")
def hash_state(spark, sf_dir):
    """Hashes of all tables' schemas, saved and loaded."""
    path = versions.new_path(spark, "state")
    text.schema_hash(tables.catalog_columns(spark, sf_dir)).write.json(path)
    return files.hash_state(spark, path)


@query(f"""SELECT c.table_name, 'CREATE TABLE ' || c.table_name || ' (' || chr(10) || '    ' || cols || coalesce(',' || chr(10) || '    ' || refs, '') || chr(10) || ');' AS ddl FROM
 (SELECT table_name, string_agg(column_name || ' ' || data_type, ',' || chr(10) || '    ' ORDER BY ordinal) AS cols FROM ({CATALOG}) GROUP BY 1) c
 LEFT JOIN (SELECT table_name, string_agg('FOREIGN KEY (' || column_name || ') REFERENCES ' || ref_table || '(' || ref_column || ')', ',' || chr(10) || '    ' ORDER BY column_name) AS refs FROM ({FKS}) GROUP BY 1) r ON r.table_name = c.table_name""")
def simple_schema(spark, sf_dir):
    return schema.simple_ddl(tables.catalog_columns(spark, sf_dir), tables.catalog_fks(spark))


EIGHT = "list_transform(range(8), lambda i: CAST(CAST('0x' || substr(md5({0}), CAST(1 + 4 * i AS BIGINT), 4) AS BIGINT) AS DOUBLE))"
SOUGHT = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]


@query(f"""{CHUNKS}, v AS (SELECT 'd' || doc_id || '.' || n AS node_id, {EIGHT.format("array_to_string(ws, ' ')")} AS x FROM roots),
 h AS (SELECT node_id FROM v ORDER BY list_dot_product(x, {SOUGHT}::DOUBLE[]) / (sqrt(list_dot_product(x, x)) * sqrt(204.0)) DESC, node_id LIMIT 15),
 l AS (SELECT 'd' || doc_id || '.' || p || '.' || n AS node_id, array_to_string(ws, ' ') AS text FROM leaves WHERE 'd' || doc_id || '.' || p IN (SELECT node_id FROM h))
SELECT node_id, len(list_intersect(['the', 'of', 'token', 'anstou'], {TOKENS.format('text')})) / 4.0 AS score FROM l ORDER BY score DESC, node_id LIMIT 3""")
def manual_answers(spark, sf_dir):
    """The best leaves below the roots nearest to a vector, of all documents as manuals."""
    nodes = retrieval.chunks(table(spark, sf_dir, "documents"))
    digest = F.md5("text")
    vector = F.array(*[F.conv(F.substring(digest, 1 + 4 * i, 4), 16, 10).cast("double") for i in range(8)])
    held = nodes.withColumn("embedding", F.when(F.col("level") == 0, vector))
    return retrieval.answer_nodes(held, RERANK_QUESTION, SOUGHT)


@query("""SELECT n_name, count(c_custkey) AS total, CAST(ceil(count(c_custkey) / 7.0) AS BIGINT) AS total_pages, 2 < CAST(ceil(count(c_custkey) / 7.0) AS BIGINT) AS has_next, true AS has_previous
 FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1""")
def page_envelopes(spark, sf_dir):
    """What a second page of seven customers says of each nation's pages."""
    views(spark, sf_dir, "nation", "customer")
    counts = spark.sql("SELECT n_name, count(c_custkey) AS total FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
    e = movement.envelope_of(F.col("total"), 2, 7)
    return counts.select("n_name", "total", e["total_pages"].alias("total_pages"), e["has_next"].alias("has_next"), e["has_previous"].alias("has_previous"))


@query("""SELECT row_number() OVER (ORDER BY o) AS line, t AS text FROM (SELECT 0 AS o, '| r_regionkey | r_name |' AS t UNION ALL SELECT 1, '| --- | --- |' UNION ALL SELECT 2 + r_regionkey, '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region)""")
def markdown_table(spark, sf_dir):
    lines = text.markdown(table(spark, sf_dir, "region").orderBy("r_regionkey"), 100).split("\n")
    return spark.createDataFrame(list(enumerate(lines, 1)), "line long, text string")


ASKED = "coalesce(text, '') || CASE (conv_id + turn) % 4 WHEN 0 THEN ' in the Dashboard' WHEN 1 THEN ' How to do it' WHEN 2 THEN ' FILTRO' ELSE '' END"


@query(f"""SELECT conv_id, turn, CASE WHEN contains(q, 'filtr') OR contains(q, 'dashboard') OR contains(q, 'painel') OR contains(q, 'filter') THEN 'gerador_script_filtro_bi'
 WHEN contains(q, 'como ') OR contains(q, 'manual') OR contains(q, 'procediment') OR contains(q, 'how do') OR contains(q, 'how to') THEN 'manuais_e_procedimentos' ELSE 'executor_consultas_informativas' END AS tool FROM (SELECT conv_id, turn, lower({ASKED}) AS q FROM conversations)""")
def routed_questions(spark, sf_dir):
    """The tool for every turn as a question."""
    from sparkloom import agent

    return table(spark, sf_dir, "conversations").select("conv_id", "turn", agent.tool_of(F.expr(ASKED)).alias("tool"))


GRADED = """(VALUES (0, 'SELECT count(*) AS n FROM nation WHERE n_nationkey < #', 1, 1, 'OK'), (1, 'SELECT count(n_name) AS n FROM nation WHERE n_nationkey < #', 1, 0, 'OK'), (2, 'SELECT -1 AS n FROM nation LIMIT 1', 0, 0, 'ERRO_LOGICO_SQL'),
 (3, 'SELECT nme FROM nation', 0, 0, 'ERRO_LOGICO_SQL'), (4, ' ', 0, 0, 'FALHA_GERACAO_SQL')) AS g(kind, sql, ex, em, status)"""


@query(f"SELECT item_id AS id, ex AS execution_accuracy, em AS exact_match, status AS status_avaliacao FROM benchmark JOIN {GRADED} ON kind = item_id % 5")
def evaluation_records(spark, sf_dir):
    """The evaluation of a model that answers every item with a statement of some kind, right or wrong."""
    from sparkloom import agent

    views(spark, sf_dir, "nation", "benchmark")
    kinds = spark.sql(f"SELECT item_id, replace(sql, '#', CAST(item_id AS STRING)) AS sql FROM benchmark JOIN {GRADED} ON kind = item_id % 5 ORDER BY 1").collect()
    replies = {str(r["item_id"]): r["sql"] for r in kinds}
    cases = [{"id": r["item_id"], "pergunta": str(r["item_id"]), "sql_esperado": f"SELECT count(*) AS n FROM nation WHERE n_nationkey < {r['item_id']}"} for r in kinds]
    records = evaluation.evaluate(spark, lambda q: agent.Response("a", {"sql": replies[q]}), cases, ves_runs=0)
    return spark.createDataFrame([(r["id"], r["execution_accuracy"], r["exact_match"], r["status_avaliacao"]) for r in records], "id long, execution_accuracy int, exact_match int, status_avaliacao string")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
