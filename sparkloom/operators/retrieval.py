"""Hybrid retrieval: dense and lexical search, reciprocal rank fusion, reranking, hierarchical chunks, few-shots.

A search takes its queries as one row or a few; what it keeps of the corpus is a top k per query, found with
TakeOrdered or a window over candidates, never by moving the corpus to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import tokens
from sparkloom.functions.vectors import cosine, dot, jaccard, norm
from sparkloom.operators import many

RRF_K = 60


def dense(nodes: DataFrame, query: list[float], k: int = 12, vector: str = "embedding", node: str = "node_id") -> DataFrame:
    """(node_id, score): the k nearest by cosine, from a scan; indexes.Index.dense() gives the same and skips cells."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return nodes.where(F.col(vector).isNotNull()).select(F.col(node).alias("node_id"), cosine(F.col(vector), q).alias("score")).orderBy(F.desc("score"), "node_id").limit(k)


def term_score(n: Column, length: Column) -> Column:
    """What a word that a text of some length has n times adds to its score: a saturated count, damped by length. Like
    ranks of full-text engines without corpus statistics, it weighs rare and common words alike."""
    n = n.cast("double")
    return n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length / 500))


def lexical(nodes: DataFrame, question: str, k: int = 12, any_word: bool = False, node: str = "node_id") -> DataFrame:
    """(node_id, score): nodes with all (or any) words of the question, by saturated counts.

    An empty question matches nothing. This reads every text; indexes.Index.lexical() gives the same from its postings.
    """
    words = F.array_distinct(tokens(F.lit(question)))
    # an index has its tokens already
    ts = F.col("tokens") if "tokens" in nodes.columns else tokens(F.col("text"))
    held = nodes.select(F.col(node).alias("node_id"), ts.alias("ts")).withColumn("q", words)
    there = F.size(F.array_intersect("q", "ts"))
    match = (there > 0) if any_word else (there == F.size("q")) & (F.size("q") > 0)
    tf = lambda w: F.size(F.filter("ts", lambda t: t == w))
    score = F.aggregate(F.transform("q", tf), F.lit(0.0), lambda s, n: s + term_score(n, F.size("ts")))
    return held.where(match).select("node_id", score.alias("score")).orderBy(F.desc("score"), "node_id").limit(k)


def ranked(hits: DataFrame, source: str) -> DataFrame:
    """Hits (node_id, score) with their rank from 1; hits are a top k, so one task sorts them."""
    return hits.select("node_id", F.row_number().over(Window.orderBy(F.desc("score"), "node_id")).alias("rank"), F.lit(source).alias("source"))


def fuse(*lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of hit lists: (node_id, rrf), each list giving 1 / (k + rank)."""
    return fused(*lists, k=k).select("node_id", "rrf")


def fused(*lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """fuse() with the place of each node, from 1: equal sums go in the order of the lists they stand in, then of their
    rank there, so hits of the dense list, which is the first, come before those of the lexical one."""
    all_ = ranked(lists[0], "0")
    for i, hits in enumerate(lists[1:], 1):
        all_ = all_.unionByName(ranked(hits, str(i)))
    # summed in the order of the lists, so that equal ranks give equal sums
    held = all_.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("source", "rank"))).alias("places"))
    rrf = F.aggregate("places", F.lit(0.0), lambda s, x: s + 1 / (k + x["rank"]))
    held = held.select("node_id", rrf.alias("rrf"), F.col("places")[0].alias("first"))
    # a few top k lists
    return held.select("node_id", "rrf", F.row_number().over(Window.orderBy(F.desc("rrf"), "first")).alias("place"))


def overlap_score(question: str) -> Callable[[Column], Column]:
    """The default reranker: share of the question's words that a text has."""
    q = F.array_distinct(tokens(F.lit(question)))
    return lambda text: F.size(F.array_intersect(q, tokens(text))) / F.greatest(F.size(q), F.lit(1))


def rerank(hits: DataFrame, nodes: DataFrame, score: Callable[[Column], Column], k: int = 3) -> DataFrame:
    """The k best of the hits by a scorer of texts; hits without a node are dropped."""
    held = hits.select("node_id").join(nodes.select("node_id", "text"), "node_id")
    return held.select("node_id", score(F.col("text")).alias("score")).orderBy(F.desc("score"), "node_id").limit(k)


def retrieve(nodes: DataFrame, question: str, query: list[float], k: int = 12, top: int = 3, scorer: Callable[[str], Callable[[Column], Column]] = overlap_score, any_word: bool = False) -> DataFrame:
    """Dense and lexical search, fused and reranked. The dense query may be of another text (a hypothetical
    answer); words (all of them, unless any_word) and reranking use the question itself. Nodes without a vector
    are found by their words alone."""
    return rerank(fuse(dense(nodes, query, k), lexical(nodes, question, k, any_word)), nodes, scorer(question), top)


def retrieve_indexed(index, question: str, query: list[float], k: int = 12, top: int = 3, scorer: Callable[[str], Callable[[Column], Column]] = overlap_score, any_word: bool = False) -> DataFrame:
    """retrieve() by an indexes.Index: both searches read what the question needs, and texts of hits alone are scored."""
    hits = fuse(index.dense(query, k), index.lexical(question, k, any_word))
    wanted = [r["node_id"] for r in hits.select("node_id").collect()]  # two top k
    return rerank(hits, index.nodes().where(F.col("node_id").isin(wanted)), scorer(question), top)


def chunks(docs: DataFrame, sizes: tuple[int, ...] = (2048, 400), overlap: int = 80) -> DataFrame:
    """(node_id, parent_id, level, doc_id, text): windows of words, those of a level cut from the one above.

    Documents are cut into roots before rows are made of them, so no row carries more than its own root. Below a root only
    numbers are made into rows, where a node's words start and how many they are; its text is cut out of the root
    when the row is there. A null text is empty: one root and one leaf below it, of no words.
    """

    def places(start: Column, size: Column, length: int) -> Column:
        """(n, start, size) of the windows of some length in a run of words."""
        step = length - overlap
        last = F.greatest(F.lit(0), F.ceil((size - overlap) / step).cast("int") - 1)
        return F.transform(F.sequence(F.lit(0), last), lambda n: F.struct(n.alias("n"), (start + n * step).alias("start"), F.least(F.lit(length), F.greatest(size - n * step, F.lit(0))).alias("size")))

    words = F.split(F.trim(F.coalesce("text", F.lit("")), F.lit(" \t\n\r")), r"\s+")
    cut = lambda ws: F.transform(places(F.lit(0), F.size(ws), sizes[0]), lambda w: F.slice(ws, w["start"] + 1, w["size"]))
    held = docs.select("doc_id", words.alias("ws")).select("doc_id", F.posexplode(cut(F.col("ws"))).alias("n", "ws"))
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("."), F.col("n").cast("string"))
    at = held.select("doc_id", "ws", name.alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("level"), F.lit(0).alias("start"), F.size("ws").alias("size"))
    for level, length in enumerate(sizes[1:], 1):
        # a node itself, and what is cut from it if it is of the level above
        below = F.when(F.col("level") == level - 1, F.transform(places(F.col("start"), F.col("size"), length), lambda w: F.struct(F.concat_ws(".", "node_id", w["n"].cast("string")).alias("node_id"), F.col("node_id").alias("parent_id"), F.lit(level).alias("level"), w["start"].alias("start"), w["size"].alias("size"))))
        own = F.array(F.struct("node_id", "parent_id", "level", "start", "size"))
        at = at.select("doc_id", "ws", F.explode(F.concat(own, F.coalesce(below, F.array().cast("array<struct<node_id:string,parent_id:string,level:int,start:int,size:int>>")))).alias("x")).select("doc_id", "ws", "x.*")
    return at.select("node_id", "parent_id", "level", "doc_id", F.array_join(F.slice("ws", F.col("start") + 1, F.col("size")), " ").alias("text"))


def leaves(hits: DataFrame, nodes: DataFrame, depth: int = 2) -> DataFrame:
    """Hits (node_id, score) replaced by the leaves below them, which inherit the score; a hit without children
    is its own leaf. depth: levels of the tree below its roots."""
    at = hits.select("node_id", "score")
    children = nodes.where("parent_id is not null").select(F.col("parent_id"), F.col("node_id").alias("child"))
    for _ in range(depth - 1):
        at = at.join(children, at["node_id"] == children["parent_id"], "left").select(F.coalesce("child", "node_id").alias("node_id"), "score")
    return at


def few_shots(examples: DataFrame, query: list[float], struct: Column | None, k: int, alpha: float = 0.5) -> DataFrame:
    """The k best examples by alpha * cosine + (1 - alpha) * structural similarity (0 without a skeleton)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    s = F.coalesce(struct, F.lit(0.0)) if struct is not None else F.lit(0.0)
    score = alpha * cosine(F.col("embedding"), q) + (1 - alpha) * s
    return examples.withColumn("score", score).orderBy(F.desc("score"), "id").limit(k)


def usable(examples: DataFrame, question: str = "pergunta", sql: str = "sql") -> DataFrame:
    """Examples that have both a question and a statement."""
    return examples.where((F.trim(F.coalesce(question, F.lit(""))) != "") & (F.trim(F.coalesce(sql, F.lit(""))) != ""))


def answer_nodes(nodes: DataFrame, question: str, query: list[float], scorer: Callable[[str], Callable[[Column], Column]] = overlap_score, k: int = 15, top: int = 3) -> DataFrame:
    """(node_id, score) of the best leaves for a question on documents: the k nearest roots, replaced by their leaves,
    reranked. nodes: chunks() with an embedding of each root."""
    roots = dense(nodes.where("level = 0"), query, k)
    return rerank(leaves(roots, nodes), nodes, scorer(question), top)


def of_class(examples: DataFrame, difficulty: str) -> DataFrame:
    """Examples of a class, or all if none is of it."""
    any_ = examples.agg(F.max(F.when(F.col("dificuldade") == difficulty, 1).otherwise(0)).alias("any_match"))
    return examples.crossJoin(F.broadcast(any_)).where((F.col("dificuldade") == difficulty) | (F.col("any_match") == 0)).drop("any_match")  # one row


def embedded(rows: DataFrame, text: str, embed: Callable[[str], list[float]]) -> DataFrame:
    """rows with an embedding of a text column by a function of one text; a text that it fails on has none. For models
    that are loaded in workers and take batches see many.embedding()."""
    return rows.withColumn("embedding", many.embedding(F.col(text), lambda: lambda texts: [embed(t) for t in texts]))


def with_embeddings(examples: DataFrame, known: DataFrame, embed: Callable[[str], list[float]], key: str = "pergunta") -> DataFrame:
    """examples with the embeddings that are known (key, embedding) for their text; only others are embedded."""
    one = known.where("embedding is not null").groupBy(key).agg(F.first("embedding").cast("array<double>").alias("embedding"))
    held = examples.join(one, key, "left")
    return held.where("embedding is not null").unionByName(embedded(held.where("embedding is null").drop("embedding"), key, embed))


def cached_answer(feedback: DataFrame, query: list[float], threshold: float = 0.98) -> DataFrame:
    """The nearest validated question, if it is closer than 1 - threshold."""
    q = F.array(*[F.lit(float(x)) for x in query])
    held = feedback.where("status_validacao = 'VALIDADO'").withColumn("distance", 1 - cosine(F.col("pergunta_embedding"), q))
    return held.where(F.col("distance") < 1 - threshold).orderBy("distance", "pergunta").limit(1)


__all__ = ["cached_answer", "chunks", "dense", "dot", "embedded", "few_shots", "fuse", "jaccard", "leaves", "lexical", "norm", "of_class", "ranked", "rerank", "retrieve"]
