"""JSON pools, document folders, hash state and index tables; checkpointed JSON results."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POOL = "id long, dificuldade string, pergunta string, sql_esperado string, sql string, query string, sql_gerado string, resposta_esperada string"


def few_shot_pool(spark: SparkSession, *paths: str) -> DataFrame:
    """Examples of JSON files; a file that isn't there gives none."""
    out = spark.createDataFrame([], POOL)
    for path in paths:
        if _exists(spark, path):
            out = out.unionByName(spark.read.schema(POOL).option("multiLine", True).json(path))
    return out


#: Where an example's statement may stand, in order: for pools of examples, and in prompts.
POOL_ORDER = ("sql_esperado", "sql", "query", "sql_gerado")
PROMPT_ORDER = ("sql", "query", "sql_gerado", "sql_esperado")


def example_sql(*columns: str) -> Column:
    """The first of the columns that holds SQL; empty text doesn't."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def questions(spark: SparkSession, path: str) -> list[dict]:
    """The questions of a JSON file (a short file, for a driver's loop), each with its statement under sql_esperado, from
    wherever it stands, and its place as id where it has none; those without a question are left out."""
    rows = spark.read.text(path, wholetext=True).collect()
    out = []
    for i, case in enumerate(json.loads(rows[0][0]) if rows else [], 1):
        sql = next((case[k] for k in POOL_ORDER if str(case.get(k) or "").strip()), "")
        if str(case.get("pergunta") or "").strip():
            out.append({**case, "id": case.get("id", i), "sql_esperado": sql})
    return out


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, text) of the files right in a folder."""
    files = spark.read.option("recursiveFileLookup", False).format("binaryFile").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.decode("content", "UTF-8").alias("text"))


def hash_state(spark: SparkSession, path: str) -> DataFrame:
    """(table_name, hash) as saved, or none yet."""
    schema = "table_name string, hash string"
    return spark.read.schema(schema).json(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def index_table(spark: SparkSession, path: str) -> DataFrame:
    schema = "node_id string, parent_id string, level int, text string, metadata map<string,string>, embedding array<float>, tokens array<string>"
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of an index that were written whole, the last one last."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/*/state/_SUCCESS")
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(int(x.getPath().getParent().getParent().getName()) for x in found or [])


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small file, written over what there was, wherever Spark can write."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def write_json(records: list[dict], path: str, spark: SparkSession | None = None) -> None:
    """A small result list, rewritten whole: readable, not escaped. With a session the path may be of any store."""
    text = json.dumps(records, ensure_ascii=False, indent=4)
    if spark is None:
        Path(path).write_text(text, encoding="utf-8")
    else:
        write_text(spark, text, path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
