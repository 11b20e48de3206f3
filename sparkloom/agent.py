"""The question-driven agent: routing, retrieval, generation with correction, execution, answer, feedback.

Models are callables; without any, deterministic rules stand in, so that every path runs offline.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.operators import answers, evaluation, indexes, movement, retrieval, rollup
from sparkloom.plans import schema, sqlast, validate
from sparkloom.sources import files, versions

#: The tools' names.
FILTER_TOOL, QUERY_TOOL, MANUAL_TOOL = "gerador_script_filtro_bi", "executor_consultas_informativas", "manuais_e_procedimentos"
#: Words by which the rule-based selector tells the tools apart.
FILTER_WORDS = ("filtr", "dashboard", "painel", "filter")
MANUAL_WORDS = ("como ", "manual", "procediment", "how do", "how to")
#: Fixed value: what is said where no statement could be made.
APOLOGY = "Desculpe, não consegui gerar a consulta."
#: Prompts by (tool kind, class); a class without one takes the general text.
RULES = {
    ("query", "EASY"): "One table, filters and sorting; no JOIN, WITH, subqueries or OVER. Start with SELECT.",
    ("query", "NON-NESTED"): "Explicit INNER or LEFT JOIN on foreign keys, GROUP BY; no subqueries.",
    ("query", "NESTED"): "CTEs, subqueries and window functions are allowed.",
    ("query", ""): "Use only the tables and columns given. Start with SELECT or WITH.",
    ("filter", "EASY"): "Add AND conditions to the base query.",
    ("filter", "NON-NESTED"): "Join before WHERE only if the view lacks the attribute.",
    ("filter", "NESTED"): "IN or EXISTS subqueries and CTEs are allowed.",
    ("filter", ""): "Return the whole base query with AND conditions.",
}


@dataclass
class Settings:
    """Feature flags and limits."""

    hyde: bool = True
    hybrid: bool = True
    pruning: bool = True
    classification: bool = True
    self_correction: bool = True
    cache: bool = False
    top_tables: int = 12
    top_k: int = 3
    few_shots: int = 4
    class_shots: int = 3
    top_roots: int = 15
    attempts: int = 3
    answer_rows: int = 10
    answer_chars: int = 1000
    base_query: str = "SELECT * FROM movement WHERE status = 'A'"
    cache_threshold: float = 0.98


@dataclass
class Bundle:
    question: str
    metadata: dict = field(default_factory=dict)


@dataclass
class Response:
    """Always returned, also on a timeout."""

    response: str
    metadata: dict = field(default_factory=dict)
    rows: DataFrame | None = None


def hashed_vector(value: str, size: int = 64) -> list[float]:
    """The default embedding: signed counts of hashed words."""
    out = [0.0] * size
    for w in value.lower().split():
        h = int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "big")
        out[h % size] += 1.0 if h >> 63 else -1.0
    return out


def prompt(tool: str, difficulty: str) -> str:
    kind = "filter" if tool == FILTER_TOOL else "query"
    return RULES.get((kind, difficulty), RULES[kind, ""])


def tool_of(question: Column) -> Column:
    """The tool that the rules give a question."""
    low = F.lower(question)
    names = lambda some: F.exists(F.array(*[F.lit(w) for w in some]), lambda w: F.contains(low, w))
    return F.when(names(FILTER_WORDS), FILTER_TOOL).when(names(MANUAL_WORDS), MANUAL_TOOL).otherwise(QUERY_TOOL)


class Agent:
    def __init__(
        self,
        spark: SparkSession,
        nodes: DataFrame | None,
        generate: Callable[[str, list[validate.Attempt], str], str],
        embed: Callable[[str], list[float]] = hashed_vector,
        hypothesise: Callable[[str], str] | None = None,
        classify: Callable[[str], str] | None = None,
        select: Callable[[str], str] | None = None,
        synthesise: Callable[[str, str], str] | None = None,
        settings: Settings | None = None,
        remember: Callable[[str, str, str], None] | None = None,
        cached: Callable[[list[float]], DataFrame] | None = None,
        examples: DataFrame | None = None,
        filter_examples: DataFrame | None = None,
        feedback: DataFrame | None = None,
        catalog: DataFrame | None = None,
        fks: DataFrame | None = None,
        documents: DataFrame | None = None,
        index: indexes.Index | None = None,
        store: answers.Answers | None = None,
        manuals: indexes.Index | None = None,
        scorer: Callable[[str], Callable] | None = None,
        retriever: Callable[[str, str], DataFrame] | None = None,
    ):
        """nodes: (node_id, text, embedding) of tables' schema text, node_id being the table; generate: (question,
        tried, context) to SQL. examples and filter_examples: pools (files.few_shot_pool) for the two tools; feedback:
        validated answers (pergunta, sql). catalog and fks: with them the schema text is pruned to what is linked.
        documents: chunks with an embedding of each root, for questions on manuals.
        index and manuals: stored indexes (see sync()) that stand for nodes and documents. store: the table of answers; with it
        answers are remembered, validated ones are examples, and the cache reads it. scorer: of the rerankers (many.scorer).
        retriever: (question, guess) to hits (node_id, score) on tables, in place of the whole search."""
        if store is not None:
            remember = remember or store.remember(embed)
            cached = cached or (lambda query: store.cached(query, self.settings.cache_threshold))
        self.index, self.store, self.manuals, self.retriever = index, store, manuals, retriever
        self.scorer = scorer or retrieval.overlap_score
        self.spark, self.nodes, self.generate, self.embed = spark, nodes, generate, embed
        self.hypothesise, self.classify, self.select, self.synthesise = hypothesise, classify, select, synthesise
        self.settings, self.remember, self.cached = settings or Settings(), remember, cached
        self.examples, self.filter_examples, self.feedback = examples, filter_examples, feedback
        self.catalog, self.fks, self.documents = catalog, fks, documents

    def tool(self, question: str) -> str:
        if self.select:
            return self.select(question)
        low = question.lower()
        return FILTER_TOOL if any(w in low for w in FILTER_WORDS) else MANUAL_TOOL if any(w in low for w in MANUAL_WORDS) else QUERY_TOOL

    def pool(self, tool: str) -> DataFrame | None:
        """The tool's examples (id, pergunta, sql, dificuldade) that have a question and a statement."""
        found = self.filter_examples if tool == FILTER_TOOL else self.examples
        if found is None:
            return None
        return retrieval.usable(found.select("id", "pergunta", files.example_sql(*files.PROMPT_ORDER).alias("sql"), "dificuldade"))

    def difficulty(self, question: str, tool: str = QUERY_TOOL) -> str:
        """The class of the question; the classifier sees the nearest classified examples."""
        if not (self.settings.classification and self.classify):
            return "NON-NESTED"
        shown, pool = "", self.pool(tool)
        if pool is not None:
            near = retrieval.few_shots(self.with_vectors(pool.where("dificuldade is not null")), self.embed(question), None, self.settings.class_shots, alpha=1.0)
            shown = text.classification_block(near, F.desc("score"), "id", n=self.settings.class_shots)
        asked = f"{shown}\n{question}" if shown else question
        return self.spark.range(1).select(text.difficulty(F.lit(self.classify(asked)))).first()[0]

    def with_vectors(self, rows: DataFrame) -> DataFrame:
        """rows with the embeddings of their questions; those of stored answers are known."""
        if self.store is None:
            return retrieval.embedded(rows, "pergunta", self.embed)
        known = self.store.rows().select("pergunta", F.col("pergunta_embedding").alias("embedding"))
        return retrieval.with_embeddings(rows, known, self.embed)

    def shots(self, question: str, guess: str, tool: str, level: str) -> str:
        """The examples most like the question, and like the hypothetical statement in structure: of its class, or of
        all classes if the pool has none of it; and of the answers that were found right."""
        pool = self.pool(tool)
        if pool is None:
            return ""
        held = retrieval.of_class(pool, level).select("id", "pergunta", "sql")
        feedback = self.feedback if self.feedback is not None else self.store.validated() if self.store is not None else None
        if feedback is not None:
            held = held.unionByName(retrieval.usable(feedback.select(F.lit(-1).cast("long").alias("id"), "pergunta", "sql")))
        held = self.with_vectors(held)
        like = None
        mine = sqlast.skeleton(self.spark, guess) if guess and self.settings.hybrid else None
        if mine is not None:
            # a pool is a short file: its statements are parsed on the driver, once
            statements = [(i, r["sql"]) for i, r in enumerate(held.select("sql").distinct().collect())]
            named = self.spark.createDataFrame(statements, "id long, sql string")
            known = sqlast.pool_skeletons(self.spark, statements).join(named, "id").drop("id")
            one = sqlast.skeletons(self.spark, [(0, guess)])
            scored = known.alias("a").crossJoin(F.broadcast(one.alias("b"))).select("a.sql", sqlast.similarity("a", "b").alias("like"))  # one row
            held, like = held.join(scored, "sql", "left"), F.col("like")
        alpha = 0.5 if like is not None else 1.0
        best = retrieval.few_shots(held, self.embed(question), like, self.settings.few_shots, alpha)
        return text.few_shot_block(best, F.desc("score"), "id", n=self.settings.few_shots)

    def guess(self, question: str) -> str:
        """A hypothetical statement for the question; the question itself where none can be made."""
        if not (self.settings.hyde and self.hypothesise):
            return ""
        try:
            return self.hypothesise(question) or question
        except Exception:  # noqa: BLE001  the question itself is searched then
            return question

    def sync(self, nodes: DataFrame, state: DataFrame) -> dict[str, int] | None:
        """Brings the tables' index to nodes and state, embedding what is new; says what changed."""
        return self.index.sync(nodes, state, self.embed)

    def sync_catalog(self) -> dict[str, int] | None:
        """Brings the tables' index to the catalog: a node for each table whose columns, keys or comments have changed."""
        nodes = schema.simple_ddl(self.catalog, self.fks).select("table_name", F.col("table_name").alias("node_id"), F.col("ddl").alias("text"))
        return self.sync(nodes, text.schema_hash(self.catalog, self.settings.pruning))

    def sync_manuals(self, folder: str, sizes: tuple[int, ...] = (2048, 400), overlap: int = 80) -> dict[str, int] | None:
        """Brings the manuals' index to the files of a folder, of which only new and edited ones are cut and embedded."""
        found = files.text_files(self.spark, folder)
        state = found.select("file_name", F.sha2("text", 256).alias("hash"))
        nodes = retrieval.chunks(found.select(F.col("file_name").alias("doc_id"), "text"), sizes, overlap).withColumnRenamed("doc_id", "file_name")
        return self.manuals.sync(nodes, state, self.embed)

    def known(self) -> DataFrame:
        """(node_id, text, ...) of the tables."""
        return self.index.nodes() if self.index is not None else self.nodes

    def hits(self, question: str, guess: str) -> DataFrame:
        """Tables in question: dense by the hypothetical statement, words by the question, fused."""
        query, k = self.embed(f"/* {question} */\n{guess}"), self.settings.top_tables
        if self.index is not None:
            return retrieval.fuse(self.index.dense(query, k), self.index.lexical(question, k))
        return retrieval.fuse(retrieval.dense(self.nodes, query, k), retrieval.lexical(self.nodes, question, k))

    def tables(self, question: str, guess: str) -> tuple[list[str], list[str]]:
        """(the best tables, all in question), by name."""
        if self.retriever is not None:
            found = sorted({r["node_id"] for r in self.retriever(question, guess).select("node_id").collect()})
            return found, found
        hits = self.hits(question, guess)
        every = sorted(r["node_id"] for r in hits.select("node_id").collect())  # two top k
        nodes = self.known().where(F.col("node_id").isin(every)) if every else self.known().limit(0)
        best = retrieval.rerank(hits, nodes, self.scorer(question), self.settings.top_k)
        return sorted(r["node_id"] for r in best.select("node_id").collect()), every

    def context(self, question: str, guess: str | None = None) -> tuple[str, str, str, dict]:
        """(schema text, the whole schema text, what corrections are told of foreign keys, rates of pruning)."""
        guess = self.guess(question) if guess is None else guess
        names, every = self.tables(question, guess)
        if self.catalog is None or self.fks is None:
            shown = self.known().where(F.col("node_id").isin(names)) if names else self.known().limit(0)
            return "\n".join(r["text"] for r in shown.orderBy("node_id").select("text").collect()), "", "", {}  # top_k rows
        # names of nodes may carry a schema, and case doesn't count
        of = lambda some: self.catalog.where(schema.bare(F.col("table_name")).isin([n.rpartition(".")[2].lower() for n in some]))
        columns = of(names)
        whole = "\n".join(r["ddl"] for r in schema.ddl(columns, self.fks, prune=False).orderBy("table_name").collect())
        missing = schema.missing_fks(columns.select("table_name").distinct(), self.fks).orderBy("t1", "t2").collect()
        hint = "".join(f"\nThere is no foreign key between {r['t1']} and {r['t2']}: join them by a shared date or attribute." for r in missing)
        if not self.settings.pruning:
            return whole, "", hint, {}
        held: dict[str, set[str]] = {}
        for r in columns.select("table_name", "column_name").collect():  # the columns of top_k tables
            held.setdefault(r["table_name"], set()).add(r["column_name"])
        wanted = [(t, c) for t, cs in sqlast.protected(self.spark, guess, held).items() for c in cs] if guess else []
        pruned = schema.ddl(schema.linked(columns, wanted), self.fks).orderBy("table_name")
        kept = pruned.select("ddl", schema.ddl_columns(F.col("ddl")).alias("n")).collect()
        raw = sum(map(len, held.values()))
        rates = evaluation.pruning_rates(len(every), len(names), of(every).count(), raw, sum(r["n"] for r in kept))
        return "\n".join(r["ddl"] for r in kept), whole, hint, rates

    def manual(self, question: str) -> str:
        """What the documents say: the best leaves below the nearest roots; without documents, the tables' texts."""
        if self.manuals is not None:
            roots, nodes = self.manuals.dense(self.embed(question), self.settings.top_roots), self.manuals.nodes()
            best = retrieval.rerank(retrieval.leaves(roots, nodes), nodes, self.scorer(question), self.settings.top_k)
        elif self.documents is not None:
            nodes = self.documents
            best = retrieval.answer_nodes(nodes, question, self.embed(question), self.scorer, k=self.settings.top_roots, top=self.settings.top_k)
        else:
            return self.context(question)[0]
        held = best.join(nodes.select("node_id", "text"), "node_id").orderBy(F.desc("score"), "node_id").select("text")
        return "\n\n".join(r["text"] for r in held.collect())  # top_k rows

    def ask(self, question: str) -> Response:
        question = text.without_tokens(question)
        bundle = Bundle(question)
        if self.settings.cache and self.cached:
            hit = self.cached(self.embed(question)).first()
            if hit is not None:
                return Response(hit["resposta_final"], {"cached": True})
        tool = self.tool(question)
        bundle.metadata["tool"] = tool
        if tool == MANUAL_TOOL:
            found = self.manual(question)
            return Response(self.synthesise(question, found) if self.synthesise else found, bundle.metadata)
        bundle.metadata["difficulty"] = level = self.difficulty(question, tool)
        bundle.metadata["hyde_sql"] = guess = self.guess(question)
        known, whole, hint, rates = (self.settings.base_query, "", "", {}) if tool == FILTER_TOOL else self.context(question, guess)
        bundle.metadata |= rates | {"context": known}
        shots = self.shots(question, guess, tool, level)
        rules = f"{prompt(tool, level)}\n{shots}\n" if shots else f"{prompt(tool, level)}\n"
        most = self.settings.attempts if self.settings.self_correction else 1
        done = validate.correct(self.spark, self.generate, question, rules + known, rules + whole if whole else "", hint, most)
        bundle.metadata |= {"attempts": len(done.attempts), "sql": done.sql, "valid": done.valid}
        if not done.valid:
            timeout = bool(done.attempts) and done.attempts[-1].condition == "TIMEOUT"
            return Response("Timed out" if timeout else APOLOGY, bundle.metadata)
        rows = self.spark.sql(done.sql.strip().rstrip(";"))
        if tool == FILTER_TOOL:
            return Response(done.sql, bundle.metadata, rows)
        shown = text.rows_to_text(rows.limit(self.settings.answer_rows), self.settings.answer_chars)
        answer = self.synthesise(question, shown) if self.synthesise else shown
        if self.remember:
            self.remember(question, done.sql, answer)
        return Response(answer, bundle.metadata, rows)


_engines: dict[str, Agent] = {}


def engine(spark: SparkSession, build: Callable[[], Agent]) -> Agent:
    """The application's agent, built once."""
    key = spark.sparkContext.applicationId
    if key not in _engines:
        _engines[key] = build()
    return _engines[key]


class Dashboard:
    """What the dashboard shows of one statement's rows; a new statement from the chat replaces all of it."""

    def __init__(self, spark: SparkSession, base_query: str):
        self.spark, self.sql = spark, base_query
        self._board: tuple[str, rollup.Rollup] | None = None

    def refresh(self, response: Response) -> bool:
        """Takes the statement of a filter tool's response; any other leaves the dashboard as it is."""
        fits = response.metadata.get("tool") == FILTER_TOOL and bool(response.metadata.get("valid"))
        if fits:
            self.sql = response.metadata["sql"].strip().rstrip(";")
        return fits

    def rows(self) -> DataFrame:
        return movement.as_rows(self.spark.sql(self.sql))

    def board(self) -> rollup.Rollup:
        """The aggregates of the statement's rows, worked out once for a statement: all that is shown adds them up."""
        if self._board is None or self._board[0] != self.sql:
            rows = self.rows()
            # a filter's rows are shown whatever their state
            made = rollup.Rollup(self.spark, versions.new_path(self.spark, "dashboard"), lambda: rows.withColumn("status", F.lit("A")))
            made.refresh()
            self._board = (self.sql, made)
        return self._board[1]

    def kpis(self) -> DataFrame:
        return self.board().formatted_kpis()

    def charts(self, unit: str = "month") -> dict[str, DataFrame]:
        held = self.board()
        return {"revenue": held.revenue_by(unit), "customers": held.top_customers(), "types": held.by_label()}


class Movements:
    """Movements for callers that know no plans: all of them (capped), a page of them, one by id. stored: their pages, if
    they have been written; deep pages read no more than others then."""

    def __init__(self, rows: DataFrame, stored: rollup.Pages | None = None):
        self.held, self.stored = rows, stored

    def find_all(self, n: int = 100) -> list[dict]:
        return [r.asDict() for r in movement.first_rows(self.held, n).collect()]

    def page(self, number: int, size: int) -> dict:
        if self.stored is not None:
            found, total = self.stored.page(number, size).collect(), self.stored.total
        else:
            found = movement.page(self.held, number, size).collect()
            total = found[0]["total"] if found else self.held.count()
        return movement.envelope(total, number, size) | {"items": [{k: v for k, v in r.asDict().items() if k != "total"} for r in found]}

    def find(self, movement_id: int) -> dict | None:
        found = self.held.where(F.col("movement_id") == movement_id).first()
        return found.asDict() if found else None


def combined(responses: list[Response], merge: Callable[[list[str]], str] | None = None) -> Response:
    """Several tools' answers as one."""
    texts = [r.response for r in responses]
    try:
        joined = merge(texts) if merge else "\n\n".join(texts)
    except Exception:  # noqa: BLE001  the plain answers are always there
        joined = "\n\n".join(texts)
    first = next((r for r in responses if r.rows is not None), None)
    return Response(joined, {k: v for r in responses for k, v in r.metadata.items()}, first.rows if first else None)
