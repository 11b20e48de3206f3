"""The movement fact view (sales and purchases) and its dashboard: KPIs, series, rankings, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.sources import versions
from sparkloom.sources.tables import table, views

#: Runs unchanged in Spark and DuckDB.
MOVEMENT_SQL = """
SELECT o.o_orderkey AS movement_id,
       CASE o.o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS movement_type,
       CAST(o.o_orderdate AS DATE) AS movement_date,
       CASE WHEN o.o_orderpriority = '5-LOW' THEN 'I' ELSE 'A' END AS status,
       CAST(CASE WHEN o.o_orderpriority = '5-LOW' THEN 0 ELSE COALESCE(li.net, 0) END AS DECIMAL(18,4)) AS net_total,
       CAST(CASE WHEN o.o_orderpriority = '5-LOW' THEN 0 ELSE COALESCE(li.gross, 0) END AS DECIMAL(18,2)) AS gross_total,
       CAST(CASE WHEN o.o_orderpriority = '5-LOW' THEN 0 ELSE COALESCE(li.unpaid, 0) END AS DECIMAL(18,2)) AS due_total,
       o.o_custkey AS customer_id, c.c_name AS customer, li.suppkey AS supplier_id, s.s_name AS supplier
FROM orders o
LEFT JOIN (
  SELECT l_orderkey,
         SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS gross,
         SUM(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4))) AS net,
         SUM(CASE WHEN l_linestatus = 'O' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END) AS unpaid,
         MIN(l_suppkey) AS suppkey
  FROM lineitem GROUP BY l_orderkey) li ON li.l_orderkey = o.o_orderkey
LEFT JOIN customer c ON c.c_custkey = o.o_custkey
LEFT JOIN supplier s ON s.s_suppkey = li.suppkey
"""
PURCHASE, SALE = 1, 2
#: Logical columns with their types; money is 0 where absent, all else null.
COLUMNS = {
    "movement_id": "bigint", "movement_type": "int", "movement_date": "date", "status": "string", "net_total": "decimal(18,4)", "gross_total": "decimal(18,2)",
    "due_total": "decimal(18,2)", "customer_id": "bigint", "customer": "string", "supplier_id": "bigint", "supplier": "string",
}
MONEY = ("net_total", "gross_total", "due_total")
PAGE = ("movement_id", "movement_date", "net_total", "movement_type", "customer", "supplier")


#: The same without the names of customers and suppliers, whose joins the optimizer can't know to be needless.
NAMELESS_SQL = MOVEMENT_SQL.replace(", c.c_name AS customer", "").replace(", s.s_name AS supplier", "").partition("LEFT JOIN customer")[0]


#: Bytes of the lines' files for each task that adds lines up by order.
LINE_BYTES = 16 << 20
LINE_COLUMNS = ("l_orderkey", "l_extendedprice", "l_discount", "l_linestatus", "l_suppkey")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines, dealt by order before they are added up: a task that reads them then holds no sums of all the orders
    that its part of the file has, and there are as many tasks for the sums as the files' size asks for."""
    held = table(spark, sf_dir, "lineitem").select(*LINE_COLUMNS)
    parts = -(-sum(size for _, size, _ in versions.fingerprint(spark, f"{sf_dir}/lineitem.parquet")) // LINE_BYTES)
    # a number is fixed; without one, small partitions are joined
    return held.repartition(parts, "l_orderkey") if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else held.repartition("l_orderkey")


def movement(spark: SparkSession, sf_dir: str, names: bool = True) -> DataFrame:
    """The view; names: with those of customers and suppliers."""
    views(spark, sf_dir, "orders", "lineitem", *(["customer", "supplier"] if names else []))
    sql = MOVEMENT_SQL if names else NAMELESS_SQL
    return spark.sql(sql.replace("FROM lineitem", "FROM {lines}"), lines=lines(spark, sf_dir))


#: By what other names the view's columns may come, the physical one first.
ALIASES = {
    "movement_id": ("vwmo_id_movimento", "id_movimento"), "movement_type": ("vwmo_tp_movimento", "tipo_movimento"), "movement_date": ("vwmo_dt_movimento", "data_movimento"),
    "status": ("vwmo_lg_situacao", "situacao"), "net_total": ("vwmo_vl_total_liquido", "valor_total_liquido"), "gross_total": ("vwmo_vl_total_bruto", "valor_total_bruto"),
    "due_total": ("vwmo_vl_total_apagar", "valor_total_a_pagar"), "customer_id": ("vwmo_id_cliente", "id_cliente"), "customer": ("vwmo_ds_cliente", "cliente"),
    "supplier_id": ("vwmo_id_fornecedor", "id_fornecedor"), "supplier": ("vwmo_ds_fornecedor", "fornecedor"),
}


def renamed(df: DataFrame) -> DataFrame:
    """df with the logical names of columns, whichever of their names they come by; of several the logical one counts, then
    the physical one."""
    held = {c.lower(): c for c in df.columns}
    found = {name: next((held[a] for a in (name, *aliases) if a in held), None) for name, aliases in ALIASES.items()}
    used = {a for aliases in ALIASES.values() for a in aliases}
    rest = [c for c in df.columns if c.lower() not in used and c.lower() not in ALIASES]
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in found.items() if c], *[F.col(f"`{c}`") for c in rest])


def as_rows(df: DataFrame) -> DataFrame:
    """df, by whichever names (see renamed()), in the logical schema: absent money is 0, other absent columns are null, unknown ones are dropped.

    movement_id has no default; null money is an error where rows are read, as it isn't optional.
    """
    df = renamed(df)
    if "movement_id" not in df.columns:
        raise ValueError("movement_id is required")
    out = []
    for name, kind in COLUMNS.items():
        c = F.col(name) if name in df.columns else F.lit(0 if name in MONEY else None)
        if name in df.columns and name in MONEY:
            c = F.when(c.isNull(), F.raise_error(F.lit(f"{name} is null"))).otherwise(c)
        out.append(c.cast(kind).alias(name))
    return df.select(out)


def active(df: DataFrame) -> DataFrame:
    return df.where(F.col("status") == "A")


def money(c: Column) -> Column:
    """A number; what doesn't parse counts as 0."""
    return F.coalesce(c.try_cast("decimal(28,4)"), F.lit(0))


def kpis(df: DataFrame) -> DataFrame:
    """One row: net and gross revenue and receivables of sales, payables of purchases, delinquency in percent."""
    of = lambda kind, c: F.coalesce(F.sum(F.when(F.col("movement_type") == kind, money(F.col(c)))), F.lit(0)).cast("double")
    sums = df.agg(of(SALE, "net_total").alias("net_revenue"), of(SALE, "gross_total").alias("gross_revenue"), of(SALE, "due_total").alias("receivable"), of(PURCHASE, "due_total").alias("payable"))
    share = F.when(F.col("net_revenue") != 0, F.col("receivable") / F.col("net_revenue") * 100).otherwise(0.0)
    return sums.withColumn("delinquency", F.round(share, 6))


def currency(c: Column) -> Column:
    return F.concat(F.lit("R$ "), F.translate(F.format_number(c, 2), ",.", ".,"))


def percent(c: Column) -> Column:
    return F.translate(F.format_string("%.2f%%", c), ".", ",")


def formatted_kpis(df: DataFrame) -> DataFrame:
    k = kpis(df)
    return k.select(*[currency(F.col(c)).alias(c) for c in ("net_revenue", "gross_revenue", "receivable", "payable")], percent(F.col("delinquency")).alias("delinquency"))


LABELS = {"day": "dd/MM/yyyy", "month": "MMM yyyy", "year": "yyyy"}


def revenue_by(df: DataFrame, unit: str) -> DataFrame:
    """(period, label, revenue) of sales by calendar day, month or year; periods without sales have 0."""
    sales = df.where((F.col("movement_type") == SALE) & F.col("movement_date").isNotNull())
    found = sales.groupBy(F.date_trunc(unit, "movement_date").cast("date").alias("period")).agg(F.sum(money(F.col("net_total"))).alias("sum"))
    span = found.agg(F.min("period").alias("lo"), F.max("period").alias("hi")).where("lo is not null")
    spine = span.select(F.explode(F.sequence("lo", "hi", F.expr(f"interval 1 {unit}"))).alias("period"))
    out = spine.join(found, "period", "left")
    return out.select("period", F.date_format("period", LABELS[unit]).alias("label"), F.coalesce("sum", F.lit(0)).cast("double").alias("revenue"))


def top_customers(df: DataFrame, n: int = 10) -> DataFrame:
    sales = df.where((F.col("movement_type") == SALE) & F.col("customer").isNotNull())
    totals = sales.groupBy("customer").agg(F.sum(money(F.col("net_total"))).cast("double").alias("revenue"))
    return totals.orderBy(F.desc("revenue"), "customer").limit(n)


def by_type(df: DataFrame) -> DataFrame:
    return df.where("movement_type is not null").groupBy("movement_type").agg(F.count("*").alias("n"))


def label(kind: Column) -> Column:
    return F.when(kind == PURCHASE, "Compra").when(kind == SALE, "Venda").otherwise("Outro")


def by_label(df: DataFrame) -> DataFrame:
    """Counts by label; codes without one are added up as Outro."""
    return by_type(df).groupBy(label(F.col("movement_type")).alias("label")).agg(F.sum("n").alias("n"))


def first_rows(df: DataFrame, n: int = 100) -> DataFrame:
    """The capped scan, in a total order so that it is the same rows each time."""
    return df.select("movement_id", "movement_date", "net_total", "movement_type", "customer", "supplier").orderBy("movement_id").limit(n)


def latest() -> list[Column]:
    """The order of pages."""
    return [F.desc_nulls_last("movement_date"), F.asc("movement_id")]


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    """One page, latest first, with the total of rows: one pass picks, one that reads no more than it must counts. For
    deep pages see rollup.Pages."""
    ordered = df.select(*PAGE).orderBy(*latest())
    total = df.agg(F.count("*").alias("total"))
    return ordered.offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))  # one row


def envelope(total: int, number: int, size: int) -> dict:
    pages = -(-total // size)
    return {"page": number, "page_size": size, "total": total, "total_pages": pages, "has_next": number < pages, "has_previous": number > 1}


def envelope_of(total: Column, number: int, size: int) -> dict[str, Column]:
    """envelope() of a column of totals."""
    pages = F.ceil(total / size).cast("long")
    return {"total_pages": pages, "has_next": F.lit(number) < pages, "has_previous": F.lit(number > 1)}


def serialised(df: DataFrame) -> DataFrame:
    """Dates and money as the dashboard's grid shows them."""
    return df.select(*[F.date_format(c, "dd/MM/yyyy").alias(c) if c == "movement_date" else F.bround(c, 2).cast("decimal(18,2)").cast("string").alias(c) if c in MONEY else F.col(c) for c in df.columns])


def running_budget(df: DataFrame, line: str, order: str, max_chars: int) -> DataFrame:
    """The lines, in order, that fit a budget of characters, each with its line end; a null line is empty.

    A line takes a character at least, so the budget is also a number of lines, and no task needs more of them.
    """
    w = Window.orderBy(order, line).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = df.orderBy(order, line).limit(max_chars)
    return first.withColumn("used", F.sum(F.length(F.coalesce(line, F.lit(""))) + 1).over(w)).where(F.col("used") <= max_chars)
