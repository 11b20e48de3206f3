"""Validation of generated SQL, and its bounded self-correction."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from sparkloom.plans import sqlast

#: What a statement's plan may stand on or hold besides: anything else at the root is no query.
QUERY_ROOTS = {
    "UnresolvedWith", "Project", "Aggregate", "Filter", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Intersect", "Except", "UnresolvedHaving", "SubqueryAlias", "WithWindowDefinition",
    "UnresolvedHint", "UnresolvedInlineTable", "UnresolvedRelation", "RepartitionByExpression", "Repartition", "UnresolvedTableValuedFunction", "UnresolvedTableValuedFunctionWithNamedArguments", "Join", "LateralJoin", "Generate", "Pivot", "Sample", "UnresolvedSubqueryColumnAliases", "OneRowRelation", "LocalRelation", "Range",
}


def check(spark: SparkSession, sql: str) -> tuple[bool, str, str]:
    """(valid, condition, message): the statement is a query, parses and resolves. Nothing is run."""
    text = sql.strip().rstrip(";")
    root = sqlast.parse(spark, text) if text else None
    if root is None:
        return False, "PARSE_SYNTAX_ERROR", "the statement does not parse"
    while root.name == "UnresolvedWith":
        root = root.children[0]
    if root.name not in QUERY_ROOTS:
        return False, "NOT_A_QUERY", f"{root.name} is not a query"
    try:
        spark.sql(text).schema
    except PySparkException as e:
        return False, e.getCondition() or "ERROR", str(e).split("\n")[0]
    return True, "", ""


def missing(condition: str) -> bool:
    """Whether the error is of a name that isn't there: the whole schema may help."""
    return condition.startswith(("UNRESOLVED_COLUMN", "TABLE_OR_VIEW_NOT_FOUND"))


def banned(message: str) -> str:
    """What a correction is told of a column that isn't there, by name; nothing of other errors."""
    found = re.search(r"column (.*?) does not exist|with name (`.*?`) cannot be resolved", message)
    return f"\nThe column {found[1] or found[2]} does not exist: do not use it." if found else ""


@dataclass
class Attempt:
    sql: str
    condition: str
    message: str


@dataclass
class Corrected:
    sql: str | None
    valid: bool
    attempts: list[Attempt] = field(default_factory=list)


def correct(spark: SparkSession, generate: Callable[[str, list[Attempt], str], str], question: str, schema: str, full_schema: str = "", hint: str = "", most: int = 3) -> Corrected:
    """Generates SQL until it is valid, most times; later attempts see all earlier errors, and after a missing
    name the full schema. hint: what corrections are told besides the error. A timeout of the generator ends it at once."""
    out = Corrected(None, False)
    text = schema
    for _ in range(most):
        try:
            told = banned(out.attempts[-1].message) + hint if out.attempts else ""
            sql = generate(question, out.attempts, text + told)
        except TimeoutError as e:
            out.attempts.append(Attempt("", "TIMEOUT", str(e)))
            return out
        valid, condition, message = check(spark, sql)
        out.attempts.append(Attempt(sql, condition, message))
        out.sql = sql
        if valid:
            out.valid = True
            return out
        if missing(condition) and full_schema:
            text = full_schema
    return out


def capped(spark: SparkSession, sql: str, n: int = 100) -> DataFrame:
    """The first n rows of a valid statement."""
    valid, condition, message = check(spark, sql)
    if not valid:
        raise ValueError(f"{condition}: {message}")
    return spark.sql(sql.strip().rstrip(";")).limit(n)
