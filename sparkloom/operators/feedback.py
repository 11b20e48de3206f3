"""The store of answered questions: upsert and the best validated ones; index synchronisation by difference."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import tokens
from sparkloom.operators import answers as answers_
from sparkloom.operators.retrieval import embedded
from sparkloom.sources import files


def upsert(store: DataFrame, answers: DataFrame) -> DataFrame:
    """store with answers (pergunta, sql_gerado, resposta_final, em, perhaps pergunta_embedding) merged by question.

    A known question gets the new answer, time and embedding, one more use for each answer and is pending again; its SQL stays
    as it was. Several answers to one question are folded in order. answers.Answers does the same on disk.
    """
    bare = "pergunta_embedding" not in store.columns
    held = store.withColumn("pergunta_embedding", F.lit(None).cast("array<double>")) if bare else store
    out = answers_.merged(held, answers_.folded(answers))
    return out.drop("pergunta_embedding") if bare else out


def validated(store: DataFrame, n: int = 20) -> DataFrame:
    """(pergunta, sql) of the latest validated answers."""
    held = store.where("status_validacao = 'VALIDADO'").orderBy(F.desc_nulls_last("data_criacao"), F.desc_nulls_last("uso_count"), "pergunta").limit(n)
    return held.select("pergunta", F.col("sql_gerado").alias("sql"))


def changes(before: DataFrame, now: DataFrame, key: str, value: str = "hash") -> DataFrame:
    """(key, change): added, changed or removed between two states (key, hash); what is equal isn't listed. A hash may
    be null: a key is there if its row is."""
    b = before.select(F.col(key), F.col(value).alias("old"), F.lit(True).alias("was"))
    n = now.select(F.col(key), F.col(value).alias("new"), F.lit(True).alias("is"))
    both = b.join(n, key, "full_outer").where(F.col("was").isNull() | F.col("is").isNull() | ~F.col("old").eqNullSafe(F.col("new")))
    return both.select(key, F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").otherwise("changed").alias("change"))


def without(index: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Index rows but those of the keys, by equality."""
    return index.join(keys.select(key).distinct(), key, "left_anti")


def synced(index: DataFrame, diff: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The index after a diff: rows of removed and changed keys go, fresh rows of added and changed ones come."""
    kept = without(index, diff.where("change <> 'added'"), key)
    return kept.unionByName(fresh.join(diff.where("change <> 'removed'").select(key), key, "left_semi"), allowMissingColumns=True)


def answered(spark: SparkSession, question: str, sql: str, answer: str) -> DataFrame:
    """One answer, as upsert() takes it, of this moment."""
    return spark.createDataFrame([(question, sql, answer)], "pergunta string, sql_gerado string, resposta_final string").withColumn("em", F.current_timestamp())


def write_index(nodes: DataFrame, state: DataFrame, path: str, key: str = "table_name", embed: Callable[[str], list[float]] | None = None) -> bool:
    """Writes nodes (node_id, parent_id, level, text, ...) and their state (key, hash) as a new version of the index
    at path, unless the state is as it was; says whether it did.

    All nodes go to the node table, with their tokens; the vector table has the roots alone, embedded if they aren't.
    Readers see a version once its state, which is written last, is there.
    """
    spark = state.sparkSession
    before = read_index(spark, path)
    if before is not None and changes(before["state"], state, key).isEmpty():
        return False
    version = f"{path}/{(files.versions(spark, path) or [0])[-1] + 1:010d}"
    held = nodes.withColumn("tokens", tokens(F.col("text")))
    held.drop("embedding").write.mode("overwrite").parquet(f"{version}/nodes")
    roots = held.where("level = 0")
    if "embedding" not in roots.columns and embed is not None:
        roots = embedded(roots, "text", embed)
    roots.write.mode("overwrite").parquet(f"{version}/vectors")
    state.select(key, "hash").write.mode("overwrite").parquet(f"{version}/state")
    return True


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """The nodes, vectors and state of the last version that was written whole; None if there is none."""
    found = files.versions(spark, path)
    return {x: spark.read.parquet(f"{path}/{found[-1]:010d}/{x}") for x in ("nodes", "vectors", "state")} if found else None
