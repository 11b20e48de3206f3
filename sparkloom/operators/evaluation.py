"""Evaluation of generated SQL: execution accuracy, structural match, efficiency, stratified splits."""

from __future__ import annotations

import math
import queue
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from sparkloom.functions import text
from sparkloom.plans import sqlast, validate
from sparkloom.sources import files, versions


def normalised(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with a's columns: numbers where either side has them (what doesn't parse is null), else trimmed
    lower-case text; NaN is null."""

    def one(df: DataFrame) -> DataFrame:
        out = []
        for c in a.columns:
            numeric = any(isinstance(x.schema[c].dataType, NumericType) for x in (a, b))
            # 0.0 is added so that both zeros are one
            v = F.col(f"`{c}`").cast("string").try_cast("double") + F.lit(0.0) if numeric else F.lower(F.trim(F.col(f"`{c}`").cast("string")))
            out.append((F.when(~F.isnan(v), v) if numeric else v).alias(c))
        return df.select(out)

    return one(a), one(b)


def digests(generated: DataFrame, expected: DataFrame, bag: bool = False) -> dict[int, tuple]:
    """By side (0: generated, 1: expected) what doesn't depend on the order of rows: their count, and sums and xors of two
    64-bit hashes of each. Each side is read once. As bags nothing is dealt out; as sets rows meet by their hashes first."""
    sides = []
    for side, df in enumerate(normalised(generated.select([f"`{c}`" for c in expected.columns]), expected)):
        # a null hashes like nothing at all, so which columns are null is hashed too
        cols = [x for c in df.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
        sides.append(df.select(F.lit(side).alias("side"), F.xxhash64(*cols).alias("h1"), F.xxhash64(F.lit("second"), *reversed(cols)).alias("h2")))
    both = sides[0].unionAll(sides[1])
    if not bag:
        both = both.distinct()
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    found = both.groupBy("side").agg(F.count("*"), wide("h1"), wide("h2"), F.bit_xor("h1"), F.bit_xor("h2")).collect()
    return {r[0]: tuple(r[1:]) for r in found}


def same_rows(generated: DataFrame, expected: DataFrame, bag: bool = False) -> bool:
    """Equality of results as sets of rows (or bags), column names as a set."""
    if set(generated.columns) != set(expected.columns):
        return False
    found = digests(generated, expected, bag)
    return found.get(0) == found.get(1)


def limited(spark: SparkSession, run: Callable, limit: float | None):
    """run(), in a thread that is given up after limit seconds: its Spark jobs are stopped then. None: no limit."""
    if limit is None:
        return run()
    tag, held = f"limited-{uuid.uuid4().hex}", queue.Queue()

    def work() -> None:
        spark.addTag(tag)
        try:
            held.put((run(), None))
        except BaseException as e:  # noqa: BLE001  raised again where the result is waited for
            held.put((None, e))
        finally:
            spark.removeTag(tag)

    threading.Thread(target=work, daemon=True).start()
    try:
        result, error = held.get(timeout=max(0.0, limit))
    except queue.Empty:
        spark.interruptTag(tag)
        raise TimeoutError(f"not done within {limit} s") from None
    if error is not None:
        raise error
    return result


def execution_accuracy(spark: SparkSession, generated: str, expected: str, limit: float | None = None) -> int:
    """1 if both statements are queries and give the same rows; any error, and more than limit seconds, counts as 0."""
    if not (validate.check(spark, generated)[0] and validate.check(spark, expected)[0]):
        return 0
    plain = lambda sql: spark.sql(sql.strip().rstrip("; \n"))
    try:
        return int(limited(spark, lambda: same_rows(plain(generated), plain(expected)), limit))
    except Exception:  # noqa: BLE001  any failure of a generated statement is a wrong answer
        return 0


def exact_match(spark: SparkSession, generated: str, expected: str) -> int:
    """1 if the statements' clauses are equal as sets; 0 if either doesn't parse."""
    g, e = sqlast.components(spark, generated), sqlast.components(spark, expected)
    return int(g is not None and g == e)


def valid_efficiency(spark: SparkSession, generated: str, expected: str, ex: int, n: int = 5, limit: float | None = None) -> float:
    """min(sqrt(reference time / generated time), 1) over means of n runs after one to warm up; 0 if ex is 0, or if
    all runs of a statement take more than limit seconds, or none is made."""
    if not ex or n < 1 or not (validate.check(spark, generated)[0] and validate.check(spark, expected)[0]):
        return 0.0

    def mean(sql: str) -> float:
        times = []
        for _ in range(n + 1):
            began = time.perf_counter()
            spark.sql(sql.strip().rstrip("; \n")).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        return sum(times[1:]) / n

    try:
        return efficiency(limited(spark, lambda: mean(expected), limit), limited(spark, lambda: mean(generated), limit))
    except TimeoutError:
        return 0.0


def efficiency(reference: float, generated: float) -> float:
    return round(min(math.sqrt(reference / generated), 1.0), 4)


def pruning_rates(candidates: int, linked: int, raw_candidates: int, raw_linked: int, kept: int) -> dict[str, float]:
    """Rates of tables left out, of columns left out of all candidates' and of the linked tables'; columns before and after."""
    rate = lambda part, whole: round(1 - part / whole, 4) if whole > 0 else 0.0
    rates = {"table_pruning_rate": rate(linked, candidates), "schema_shortening_rate": rate(kept, raw_candidates), "column_pruning_rate": rate(kept, raw_linked)}
    return rates | {"schema_cols_original": raw_candidates, "schema_cols_pruned": kept}


def shortening(raw: Column, kept: Column) -> Column:
    return F.when(raw > 0, F.round(1 - kept / raw, 4)).otherwise(0.0)


#: Bits of a hash that a round of histograms settles, and rows from which another round is made.
ROUND_BITS, FEW_ROWS = 12, 4096
HASH_BITS = 60


def _hash(key: Column, seed: int) -> Column:
    """60 bits of the md5 of seed and key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, HASH_BITS // 4), 16, 10).cast("long")


def stratified_split(df: DataFrame, stratum: str, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds part: of each stratum exactly ceil(n * share) rows are test, those with the least hashes of key, the others pool.

    The bound of a stratum is found by histograms of hashes, each of 2^ROUND_BITS bins within the bin that the
    bound lies in; what is left then is sorted. So a stratum of any size is counted by all tasks, and its rows stay where
    they are. Rows that are equal to the bound are told apart by all their columns, and repeated rows by number.
    """
    spark, columns = df.sparkSession, df.columns
    held = df.select(F.struct(*[f"`{c}`" for c in columns]).alias("row"), F.col(f"`{stratum}`").alias("s"), _hash(F.col(f"`{key}`"), seed).alias("h"))
    # all columns as text tell rows of one hash apart; the key comes first
    text_of = F.to_json(F.struct(F.col(f"row.`{key}`").alias("k"), "row"), {"ignoreNullFields": "false"})
    bits = HASH_BITS
    state = held.groupBy("s").agg(F.ceil(F.count("*") * share).alias("want"), F.count("*").alias("n")).withColumn("lo", F.lit(0).cast("long"))
    same = lambda a, b: a["s"].eqNullSafe(b["s"])
    while True:
        state = _written(state, "split-bounds")
        most = state.agg(F.max("n")).first()[0]
        if most is None or most <= FEW_ROWS or bits == 0:
            break
        step = min(ROUND_BITS, bits)
        inner = held.join(state.where(F.col("n") > FEW_ROWS), same(held, state)).where(F.shiftright(F.col("h"), bits) == F.shiftright(F.col("lo"), bits) if bits < HASH_BITS else F.lit(True))
        bins = inner.select(state["s"].alias("s"), "want", F.shiftright("h", bits - step).alias("bin")).groupBy("s", "want", "bin").agg(F.count("*").alias("n"))
        listed = bins.groupBy("s", "want").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"))
        # the bin in which the sum reaches what is wanted
        start = F.struct(F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("done"))
        take = lambda a, x: F.when(a["done"], a).when(a["before"] + x["n"] >= F.col("want"), F.struct(a["before"].alias("before"), x["bin"].alias("bin"), x["n"].alias("n"), F.lit(True).alias("done"))).otherwise(F.struct((a["before"] + x["n"]).alias("before"), x["bin"].alias("bin"), x["n"].alias("n"), F.lit(False).alias("done")))
        found = listed.select("s", "want", F.aggregate("bins", start, take).alias("at"))
        deeper = found.select("s", (F.col("want") - F.col("at.before")).alias("want"), F.col("at.n").alias("n"), F.shiftleft(F.col("at.bin"), bits - step).alias("lo"))
        # strata that are settled keep their bin's lower end and width
        state = deeper.withColumn("width", F.lit(bits - step)).unionByName(state.where(F.col("n") <= FEW_ROWS).withColumn("width", F.lit(bits)) if "width" not in state.columns else state.where(F.col("n") <= FEW_ROWS))
        bits -= step
    if "width" not in state.columns:
        state = state.withColumn("width", F.lit(HASH_BITS))
    b = state.alias("b")
    placed = held.join(b, held["s"].eqNullSafe(F.col("b.s"))).select("row", held["s"].alias("s"), "h", "want", "lo", "width")
    end = F.col("lo") + F.expr("shiftleft(1L, width)") - 1
    placed = placed.withColumns({"end": end, "inner": F.col("h").between(F.col("lo"), end)})
    # within the bins: distinct rows with their counts, few a stratum unless one hash has many different rows
    near = placed.where("inner").groupBy("s", "h", text_of.alias("t")).agg(F.count("*").alias("n"), F.first("want").alias("want"), F.first("row").alias("row"))
    near = _written(near.select("s", "h", "t", "n", "want", "row"), "split-near")
    listed = near.groupBy("s", "want").agg(F.array_sort(F.collect_list(F.struct("h", "t", "n"))).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("h"), F.lit("").alias("t"), F.lit(False).alias("done"))
    take = lambda a, x: F.when(a["done"], a).otherwise(F.struct(F.when(a["before"] + x["n"] >= F.col("want"), a["before"]).otherwise(a["before"] + x["n"]).alias("before"), x["h"].alias("h"), x["t"].alias("t"), (a["before"] + x["n"] >= F.col("want")).alias("done")))
    cut = listed.select("s", F.aggregate("rows", start, take).alias("cut"), "want").select("s", F.col("cut.h").alias("cut_h"), F.col("cut.t").alias("cut_t"), (F.col("want") - F.col("cut.before")).alias("take"))
    cut = _written(cut, "split-cuts")
    c = cut.alias("c")
    inner = near.join(c, near["s"].eqNullSafe(F.col("c.s"))).select("row", "h", "t", "n", "cut_h", "cut_t", "take")
    below = (F.col("h") < F.col("cut_h")) | ((F.col("h") == F.col("cut_h")) & (F.col("t") < F.col("cut_t")))
    at = (F.col("h") == F.col("cut_h")) & (F.col("t") == F.col("cut_t"))
    tests = F.when(below, F.col("n")).when(at, F.col("take")).otherwise(F.lit(0))
    inner = inner.select("row", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.col("n")), lambda i: i <= tests)).alias("is_test"))
    outer = placed.where(~F.col("inner")).select("row", (F.col("h") < F.col("lo")).alias("is_test"))
    return outer.unionByName(inner).select("row.*", F.when(F.col("is_test"), "test").otherwise("pool").alias("part"))


def _written(df: DataFrame, name: str) -> DataFrame:
    """A small table, written and read again."""
    path = versions.new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def asked(spark: SparkSession, ask, question: str, limit: float):
    """ask(question), given up after limit seconds."""
    return limited(spark, lambda: ask(question), limit)


def peak_memory(spark: SparkSession) -> int:
    """The largest JVM heap that an executor has held so far, in MB; 0 where Spark has no figure yet."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    peaks = [executors.apply(i).peakMemoryMetrics() for i in range(executors.size())]
    return max((p.get().getMetricValue("JVMHeapMemory") for p in peaks if p.isDefined()), default=0) >> 20


def evaluate(spark: SparkSession, ask, cases: list[dict], path: str | None = None, limit: float = 180.0, ves_runs: int = 5) -> list[dict]:
    """One record per case (id, pergunta, sql_esperado, dificuldade); ask gives a response with metadata.

    The records are rewritten to path after every case, so a run that is broken off keeps what it has. A case
    that takes longer than limit, or whose asking fails, is recorded and the next one is asked. What is left of the limit
    holds for the comparison of results too, and the limit once more for the timed runs of each statement.
    """
    records: list[dict] = []
    for case in cases:
        began = time.perf_counter()
        answer, sql, metadata = "", "", {}
        try:
            r = asked(spark, ask, case["pergunta"], limit)
            answer, metadata = r.response, r.metadata
            sql = metadata.get("sql") or ""
        except TimeoutError:
            answer = "Timed out"
        except Exception as e:  # noqa: BLE001  one question that fails must not end the run
            answer = f"Desculpe: {e}"
        latency = time.perf_counter() - began
        expected = case.get("sql_esperado") or ""
        left = max(0.0, limit - latency)
        ex = execution_accuracy(spark, sql, expected, left) if sql and expected else 0
        row = spark.range(1).select(text.status(F.lit(latency), F.lit(answer), F.lit(sql), F.lit(ex), limit).alias("s")).first()
        # fixed values: the names of a record's fields
        records.append(
            {
                "id": case["id"],
                "pergunta": case["pergunta"],
                "resposta_esperada": case.get("resposta_esperada"),
                "contexto_recuperado": metadata.get("context"),
                "dificuldade": case.get("dificuldade"),
                "latencia_segundos": round(latency, 3),
                "execution_accuracy": ex,
                "exact_match": exact_match(spark, sql, expected) if sql and expected else 0,
                "valid_efficiency_score": valid_efficiency(spark, sql, expected, ex, ves_runs, limit),
                "schema_cols_original": metadata.get("schema_cols_original"),
                "schema_cols_pruned": metadata.get("schema_cols_pruned"),
                "schema_shortening_rate": metadata.get("schema_shortening_rate"),
                "selected_tool": metadata.get("tool"),
                "status_avaliacao": row["s"],
                "sql_gerado": sql,
                "resposta_texto_gerada": answer,
                "pico_memoria_mb": peak_memory(spark),
            }
        )
        if path:
            files.write_json(records, path, spark)
    return records


def evaluate_file(spark: SparkSession, ask, cases: str, path: str, limit: float = 180.0, ves_runs: int = 5) -> list[dict]:
    """evaluate() of the questions in a JSON file, which may be in any store; the records go to path."""
    return evaluate(spark, ask, files.questions(spark, cases), path, limit, ves_runs)


def split_file(spark: SparkSession, cases: str, pool: str, test: str, share: float = 0.2, seed: int = 42) -> dict[str, int]:
    """Splits the questions in a JSON file by class into a pool and a test file; says how many each has."""
    held = files.questions(spark, cases)
    rows = spark.createDataFrame([(i, c.get("dificuldade")) for i, c in enumerate(held)], "at long, dificuldade string")
    part = {r["at"]: r["part"] for r in stratified_split(rows, "dificuldade", "at", share, seed).select("at", "part").collect()}
    out = {"pool": [c for i, c in enumerate(held) if part[i] == "pool"], "test": [c for i, c in enumerate(held) if part[i] == "test"]}
    for name, where in (("pool", pool), ("test", test)):
        files.write_json(out[name], where, spark)
    return {name: len(some) for name, some in out.items()}


#: Parts of the names of tables that questions are never made for.
OWN_TABLES = ("data_", "tb_rag_feedback")


def askable(counts: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """Of (table_name, row_count) the tables with rows, but those to skip and the index's own."""
    own = F.lit(False)
    for part in OWN_TABLES:
        own = own | F.lower("table_name").contains(part)
    return counts.where((F.col("row_count") > 0) & ~own & (~F.col("table_name").isin(*skip) if skip else F.lit(True)))


def generated_cases(spark: SparkSession, counts: DataFrame, ddls: DataFrame, write, skip: tuple[str, ...] = (), per_table: int = 3) -> list[dict]:
    """Questions that a model writes for each table with rows: write(ddl) gives [{dificuldade, pergunta, sql}]."""
    wanted = ddls.join(askable(counts, skip), "table_name").orderBy("table_name")
    out: list[dict] = []
    for r in wanted.select("ddl").collect():  # one row per table
        for case in write(r["ddl"])[:per_table]:
            out.append({"id": len(out) + 1, **case})
    return out
