"""Schema text for prompts: DDL, pruning of audit columns, linking, missing foreign keys, shortening rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of the names of audit columns.
AUDIT_TERMS = ["hr_modificacao", "id_resp_modificacao", "usuario_modificacao", "id_resp_cancelamento", "hr_cancelamento", "id_resp_exclusao", "id_resp_cadastro", "id_resp_reg", "usuario_cadastro", "ip_registro", "mac_address", "session_id"]


def is_audit(terms: list[str] = AUDIT_TERMS) -> Column:
    """Audit columns by name; keys never are."""
    return F.lower("column_name").rlike("|".join(terms)) & ~F.col("is_pk")


def is_structural() -> Column:
    """Types that matter for a query's structure whatever it asks: times, flags, small codes."""
    return F.upper("data_type").rlike("DATE|TIME|INTERVAL|BOOL|ENUM|SMALLINT|SHORT")


def pruned(columns: DataFrame, terms: list[str] = AUDIT_TERMS) -> DataFrame:
    return columns.where(~is_audit(terms))


def linked(columns: DataFrame, wanted: list[tuple[str, str]] = ()) -> DataFrame:
    """Columns kept for a prompt: keys, structural types, and those (table, column) that a hypothetical query
    filters or joins on."""
    named = F.concat_ws(".", F.lower("table_name"), F.lower("column_name")).isin([f"{t}.{c}".lower() for t, c in wanted]) if wanted else F.lit(False)
    return columns.where(F.col("is_pk") | F.col("is_fk") | is_structural() | named)


def ddl(columns: DataFrame, fks: DataFrame, prune: bool = True) -> DataFrame:
    """(table_name, ddl): CREATE TABLE text with keys and comments; foreign keys whose column was pruned go."""
    kept = pruned(columns) if prune else columns
    key = F.when(F.col("is_pk"), " PRIMARY KEY").when(~F.col("nullable"), " NOT NULL").otherwise("")
    note = F.when(F.col("comment").isNotNull(), F.concat(F.lit(" -- "), F.trim(F.regexp_replace("comment", "\\s*\n\\s*", " ")))).otherwise("")
    line = F.concat(F.lit("    "), "column_name", F.lit(" "), F.upper("data_type"), key, note)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("l")))), lambda x: x["l"]), ",\n")
    heads = kept.groupBy("table_name").agg(listed.alias("cols"))
    refs = fks.join(kept.select("table_name", "column_name"), ["table_name", "column_name"], "left_semi")
    one = F.concat(F.lit("-- FOREIGN KEY ("), "column_name", F.lit(") REFERENCES public."), "ref_table", F.lit("("), "ref_column", F.lit(")"))
    tails = refs.groupBy("table_name").agg(F.array_join(F.array_sort(F.collect_list(one)), "\n").alias("refs"))
    text = F.concat(F.lit("CREATE TABLE public."), "table_name", F.lit(" (\n"), "cols", F.lit("\n);\n"), F.coalesce("refs", F.lit("")))
    return heads.join(tails, "table_name", "left").select("table_name", text.alias("ddl"))


def simple_ddl(columns: DataFrame, fks: DataFrame) -> DataFrame:
    """(table_name, ddl): every column, with its comment, and the foreign keys within the parentheses; a comment of
    the table (column table_comment, if there is one) stands last."""
    flat = lambda c: F.trim(F.regexp_replace(c, "\n", " "))
    line = F.concat_ws(" -- ", F.concat_ws(" ", "column_name", "data_type"), flat(F.col("comment")))
    about = F.max("table_comment") if "table_comment" in columns.columns else F.lit(None).cast("string")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("l")))), lambda x: x["l"])
    heads = columns.groupBy("table_name").agg(lines.alias("lines"), about.alias("about"))
    one = F.format_string("FOREIGN KEY (%s) REFERENCES %s(%s)", "column_name", "ref_table", "ref_column")
    tails = fks.groupBy("table_name").agg(F.array_sort(F.collect_list(one)).alias("refs"))
    body = F.array_join(F.concat("lines", F.coalesce("refs", F.array().cast("array<string>"))), ",\n    ")
    end = F.coalesce(F.concat(F.lit("\n/* TABLE COMMENT: "), flat(F.col("about")), F.lit(" */")), F.lit(""))
    ddl = F.concat(F.lit("CREATE TABLE "), "table_name", F.lit(" (\n    "), body, F.lit("\n);"), end)
    return heads.join(tails, "table_name", "left").select("table_name", ddl.alias("ddl"))


def ddl_columns(text: Column) -> Column:
    """Column lines of DDL text."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    return F.size(F.filter(lines, lambda x: x.rlike("^[A-Za-z_]") & ~x.rlike("^(CREATE|COMMENT)")))


def missing_fks(tables: DataFrame, fks: DataFrame) -> DataFrame:
    """(t1, t2), t1 < t2, of tables without a foreign key either way."""
    a, b = tables.select(F.col("table_name").alias("t1")), tables.select(F.col("table_name").alias("t2"))
    edge = fks.select(F.least("table_name", "ref_table").alias("t1"), F.greatest("table_name", "ref_table").alias("t2")).distinct()
    # a handful of tables that a prompt names
    return a.join(b, F.col("t1") < F.col("t2")).join(edge, ["t1", "t2"], "left_anti")


def bare(name: Column) -> Column:
    """A table's name without schema and case."""
    return F.lower(F.element_at(F.split(name, "\\."), -1))


def same_table(a: Column, b: Column) -> Column:
    """Whether two names are of one table, whatever schema and case they have."""
    return bare(a) == bare(b)


def filter_ddl(columns: DataFrame, wanted: list[tuple[str, str]] = ()) -> DataFrame:
    """(table_name, ddl) for the dashboard's filter: linked and pruned columns, without lines of foreign keys."""
    none = columns.sparkSession.createDataFrame([], "table_name string, column_name string, ref_table string, ref_column string")
    return ddl(linked(pruned(columns), wanted), none, prune=False)


def raw_columns(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """(table_name, raw_columns) of tables by name, with or without schema and in any case; 0 of those unknown."""
    counts = columns.groupBy(bare(F.col("table_name")).alias("bare")).agg(F.count("*").alias("raw_columns"))
    named = tables.select("table_name", bare(F.col("table_name")).alias("bare"))
    return named.join(counts, "bare", "left").select("table_name", F.coalesce("raw_columns", F.lit(0)).alias("raw_columns"))
