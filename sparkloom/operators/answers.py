"""The stored table of answered questions: a keyed merge on disk.

Rows lie in hash buckets of the question; a merge reads and rewrites only the buckets that its answers fall into, in
a new folder, and the manifest that points buckets to folders is written last (sources.versions). Of two
merges that start from one version the second finds a conflict, and runs again on what the first has left.

A merge folds all answers to one question in their order: the first makes a question known if it wasn't, each
later one counts as a use, and the last one's answer, time and embedding stay. The statement stays as it was first.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import retrieval
from sparkloom.sources import versions

BUCKETS = 64
ATTEMPTS = 5
COLUMNS = "pergunta string, sql_gerado string, resposta_final string, pergunta_embedding array<double>, status_validacao string, uso_count int, data_criacao {time}"


class Answers:
    """The table at a path of a shared folder. time: type of the time of an answer."""

    def __init__(self, spark: SparkSession, path: str, time: str = "timestamp", buckets: int = BUCKETS):
        self.spark, self.path = spark, path
        self.schema = COLUMNS.format(time=time)
        _, content = versions.current(spark, path)
        self.buckets = content.get("buckets", buckets)

    def _bucket(self, question: str | Column) -> Column:
        return F.pmod(F.xxhash64(question), F.lit(self.buckets)).cast("int")

    def _read(self, content: dict, wanted: list[int] | None = None) -> DataFrame:
        """Rows of some buckets, or all, as a version has them."""
        by_write: dict[str, list[int]] = {}
        for bucket, write in content.get("places", {}).items():
            if wanted is None or int(bucket) in wanted:
                by_write.setdefault(write, []).append(int(bucket))
        out = self.spark.createDataFrame([], self.schema)
        for write, mine in sorted(by_write.items()):
            held = versions.parts(self.spark, f"{self.path}/rows/{write}", f"{self.schema}, bucket int", bucket=mine)
            out = out.unionByName(held.drop("bucket"))
        return out

    def rows(self) -> DataFrame:
        return self._read(versions.current(self.spark, self.path)[1])

    def lookup(self, questions: DataFrame) -> DataFrame:
        """The rows of some questions (pergunta): only their buckets are read."""
        content = versions.current(self.spark, self.path)[1]
        wanted = [r[0] for r in questions.select(self._bucket("pergunta")).distinct().collect()]
        return self._read(content, wanted).join(questions.select("pergunta").distinct(), "pergunta", "left_semi")

    def _put(self, fresh: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Rewrites the buckets of fresh by merge(rows there, fresh); returns the version. A conflict starts it anew."""
        for attempt in range(ATTEMPTS):
            now, content = versions.current(self.spark, self.path)
            number = versions.following(self.spark, self.path)
            # a folder of its own, so that writers of one version don't meet
            write = f"{number:010d}-{uuid.uuid4().hex}"
            touched = sorted(r[0] for r in fresh.select(self._bucket("pergunta")).distinct().collect())
            if not touched:
                return now
            whole = merge(self._read(content, touched), fresh).withColumn("bucket", self._bucket("pergunta"))
            whole.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/{write}")
            places = {**content.get("places", {}), **{str(b): write for b in touched}}
            try:
                # the version that was read must still be the last
                if versions.current(self.spark, self.path)[0] != now:
                    raise versions.Conflict(f"version {now} of {self.path} isn't the last any more")
                versions.commit(self.spark, self.path, number, {"places": places, "buckets": self.buckets})
                return number
            except versions.Conflict:
                if attempt == ATTEMPTS - 1:
                    raise
        raise AssertionError("unreachable")

    def merge(self, answers: DataFrame, embed: Callable[[str], list[float]] | None = None) -> int:
        """Takes up answers (pergunta, sql_gerado, resposta_final, em, perhaps pergunta_embedding); returns the version.

        Questions that are null are passed over. embed: gives the questions' embeddings where there is no column.
        """
        held = answers.where("pergunta is not null")
        if "pergunta_embedding" not in held.columns:
            last = folded(held)
            last = last.drop("pergunta_embedding")
            if embed is not None:
                last = retrieval.embedded(last, "pergunta", embed).withColumnRenamed("embedding", "pergunta_embedding")
            else:
                last = last.withColumn("pergunta_embedding", F.lit(None).cast("array<double>"))
        else:
            last = folded(held)
        return self._put(last, merged)

    def validate(self, questions: DataFrame, status: str = "VALIDADO") -> int:
        """Sets the status of some questions (pergunta)."""

        def put(there: DataFrame, fresh: DataFrame) -> DataFrame:
            mine = fresh.select("pergunta", F.lit(status).alias("new"))
            found = there.join(mine, "pergunta", "left")
            return found.withColumn("status_validacao", F.coalesce("new", "status_validacao")).drop("new")

        return self._put(questions.select("pergunta").where("pergunta is not null").distinct(), put)

    def validated(self, n: int = 20) -> DataFrame:
        from sparkloom.operators import feedback

        return feedback.validated(self.rows(), n)

    def cached(self, query: list[float], threshold: float = 0.98) -> DataFrame:
        """The answer of the nearest validated question, if it is near enough."""
        return retrieval.cached_answer(self.rows(), query, threshold)

    def remember(self, embed: Callable[[str], list[float]] | None = None) -> Callable[[str, str, str], None]:
        """What an agent calls after an answer: question, statement, answer."""
        from sparkloom.operators import feedback

        return lambda question, sql, answer: self.merge(feedback.answered(self.spark, question, sql, answer), embed) and None


def folded(answers: DataFrame) -> DataFrame:
    """One row a question: the statement of its first answer, the last one's answer, time and embedding, and how many
    there are. Answers of one time go by statement and answer."""
    vector = F.col("pergunta_embedding").cast("array<double>") if "pergunta_embedding" in answers.columns else F.lit(None).cast("array<double>")
    one = F.struct("em", "sql_gerado", "resposta_final", vector.alias("pergunta_embedding"))
    held = answers.groupBy("pergunta").agg(F.min(one).alias("first"), F.max(one).alias("last"), F.count("*").cast("int").alias("times"))
    return held.select("pergunta", F.col("first.sql_gerado"), F.col("last.resposta_final"), F.col("last.pergunta_embedding"), F.col("last.em").alias("em"), "times")


def merged(there: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored rows with those of folded()."""
    s, a = there.withColumn("old", F.lit(True)).alias("s"), fresh.withColumn("new", F.lit(True)).alias("a")
    both = s.join(a, F.col("s.pergunta") == F.col("a.pergunta"), "full_outer")
    old, new = F.col("s.old").isNotNull(), F.col("a.new").isNotNull()
    return both.select(
        F.coalesce("s.pergunta", "a.pergunta").alias("pergunta"),
        F.when(old, F.col("s.sql_gerado")).otherwise(F.col("a.sql_gerado")).alias("sql_gerado"),
        F.when(new, F.col("a.resposta_final")).otherwise(F.col("s.resposta_final")).alias("resposta_final"),
        # an answer without an embedding leaves the one there is
        F.coalesce("a.pergunta_embedding", "s.pergunta_embedding").alias("pergunta_embedding"),
        F.when(new, "PENDENTE").otherwise(F.col("s.status_validacao")).alias("status_validacao"),
        F.when(old, F.col("s.uso_count") + F.coalesce("a.times", F.lit(0))).otherwise(F.col("a.times") - 1).cast("int").alias("uso_count"),
        F.when(new, F.col("a.em")).otherwise(F.col("s.data_criacao")).alias("data_criacao"),
    )
