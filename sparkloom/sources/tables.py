"""Table scans and the declared catalog: columns, keys and comments that Spark's own catalog cannot hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.shipping import ship

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
PRIMARY_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id"}
FOREIGN_KEYS = [
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Registers tables as temporary views for SQL text."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def base_view(spark: SparkSession, name: str) -> DataFrame:
    """A view by name; if it is missing, the error says where we looked and what there is."""
    if not spark.catalog.tableExists(name):
        database, user = spark.sql("select current_database(), current_user()").first()
        known = sorted(t.name for t in spark.catalog.listTables())
        raise NameError(f"view {name!r} is not in database {database!r} (user {user!r}); available: {known}")
    return spark.table(name)


def catalog_columns(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> DataFrame:
    """(table_name, ordinal, column_name, data_type, nullable, is_pk, is_fk, comment), from the files' schemas."""
    fks = {(t, c) for t, c, _, _ in FOREIGN_KEYS}
    rows = [
        (t, i, f.name, f.dataType.simpleString().upper(), f.nullable and PRIMARY_KEYS.get(t) != f.name, PRIMARY_KEYS.get(t) == f.name, (t, f.name) in fks, f.metadata.get("comment"))
        for t in names or TABLES
        for i, f in enumerate(table(spark, sf_dir, t).schema.fields, 1)
    ]
    return spark.createDataFrame(rows, "table_name string, ordinal int, column_name string, data_type string, nullable boolean, is_pk boolean, is_fk boolean, comment string")


def reflected(spark: SparkSession, views_too: bool = True) -> DataFrame:
    """(table_name, ordinal, column_name, data_type, nullable) of what the session's catalog has, with or without views."""
    known = [t for t in spark.catalog.listTables() if views_too or t.tableType not in ("VIEW", "TEMPORARY")]
    rows = [(t.name, i, c.name, c.dataType.upper(), c.nullable) for t in known for i, c in enumerate(spark.catalog.listColumns(t.name), 1)]
    return spark.createDataFrame(rows, "table_name string, ordinal int, column_name string, data_type string, nullable boolean")


def catalog_fks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FOREIGN_KEYS, "table_name string, column_name string, ref_table string, ref_column string")


def visible(tables: DataFrame, hidden: tuple[str, ...] = ("tb_rag_feedback", "data_schema_index", "data_documents_index")) -> DataFrame:
    """Without internal tables, whatever their case."""
    return tables.where(~F.lower("table_name").isin([h.lower() for h in hidden]))


def row_counts(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> DataFrame:
    """(table_name, row_count) in one job."""
    parts = [table(spark, sf_dir, n).agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n in names or TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
