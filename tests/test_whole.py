"""Queries take whole tables and whole texts: against brute force on small tables."""

import re
import unicodedata
from datetime import datetime

from pyspark.sql import functions as F

from sparkloom import registry
from sparkloom.functions import text


def run(spark, path, name, **frames):
    for table, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path}/{table}.parquet")
    return registry.queries()[name](spark, str(path)).collect()


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")


def test_identifiers_are_of_whole_texts(spark, tmp_path):
    texts = [" ".join(["word"] * 30 + ["Ação", "últimà"]), "one, two", None, ""]
    expected = {w for t in texts for w in re.split(r"[\W\d_]+", (t or "").lower()) if w}
    got = run(spark, tmp_path, "normalize_identifiers", documents=documents(spark, texts))
    plain = lambda w: "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))
    assert sorted((r["word"], r["plain"]) for r in got) == sorted((w, plain(w)) for w in expected)


def customers(spark, keys):
    rows = [(k, f"Name{k}", 0, round(-5.0 + 0.37 * i, 2), None if i % 5 == 0 else "SEG") for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


def test_scalar_functions_of_all_customers(spark, tmp_path):
    df = customers(spark, range(1, 41))
    got = run(spark, tmp_path, "sql_scalar_functions", customer=df)
    assert sorted((r["name"], r["segment"], r["balance"], r["size"]) for r in got) == sorted((r["c_name"].lower(), r["c_mktsegment"] or "none", int(r["c_acctbal"]), abs(r["c_acctbal"])) for r in df.collect())


def test_budget_alone_ends_the_lines(spark, tmp_path):
    df = customers(spark, range(500, 900))
    got = {r["c_custkey"]: r["used"] for r in run(spark, tmp_path, "rows_to_text_budget", customer=df)}
    expected, used = {}, 0
    for r in df.orderBy("c_custkey").collect():
        used += len(f"{r['c_custkey']} | {r['c_name']} | {r['c_mktsegment'] or ''}") + 1
        if used <= 3000:
            expected[r["c_custkey"]] = used
    assert got == expected and len(got) > 100


def test_half_cents_are_serialised(spark, tmp_path):
    dates = "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string, o_totalprice double"
    orders = spark.createDataFrame([(k, 1, "F", datetime(1997, 3, k), "1-URGENT", 1.0) for k in range(1, 5)], dates)
    # nets of 0.125, 0.135, 0.145 and 0.10
    prices = [(0.25, 0.5), (0.27, 0.5), (0.29, 0.5), (0.20, 0.5)]
    lines = spark.createDataFrame([(k + 1, 1, 1, 1, 1.0, p, d, 0.0, "R", "F", datetime(1997, 3, 1)) for k, (p, d) in enumerate(prices)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")
    supplier = spark.createDataFrame([(1, "S", 0, 0.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")
    got = run(spark, tmp_path, "movement_serialised", orders=orders, lineitem=lines, supplier=supplier, customer=customers(spark, [1]))
    assert {r["movement_id"]: r["net_total"] for r in got} == {1: "0.12", 2: "0.14", 3: "0.14", 4: "0.10"}


def test_leaves_of_ranked_roots(spark, tmp_path):
    # the match lies in the second root of a document beyond the 50th
    texts = [" ".join(f"w{i}" for i in range(30))] * 60 + [" ".join(["pad"] * 2500 + ["the", "of", "token"])]
    got = run(spark, tmp_path, "expand_leaves", documents=documents(spark, texts))
    assert sorted(r["node_id"] for r in got) == ["d60.1.0", "d60.1.1"] and all(r["score"] > 0 for r in got)


def test_tokens_are_removed_however_deep(spark):
    deep = "a" + "[IN" * 50 + "[INST]" + "ST]" * 50 + "b"
    mixed = "[/IN[/IN[IN[IN[IN[INST]ST]ST]ST]ST]ST]x"
    rows = [(0, deep), (1, mixed), (2, None), (3, ""), (4, "[INST plain]")]
    got = spark.createDataFrame(rows, "id int, t string").select("id", text.sanitised(F.col("t")).alias("t")).collect()
    assert {r["id"]: r["t"] for r in got} == {0: "ab", 1: "x", 2: None, 3: "", 4: "[INST plain]"}
