"""SQL text as data: skeletons, similarity, clause components and protected columns from Spark's own parser.

The parser's unresolved plan is read once as JSON; all else is a walk over it on the driver.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.vectors import jaccard

AGGREGATES = {"sum", "count", "avg", "max", "min"}
SUBQUERIES = {"ScalarSubquery", "ListQuery", "Exists", "InSubquery"}
COMPARISONS = {"EqualTo": "=", "EqualNullSafe": "<=>", "LessThan": "<", "LessThanOrEqual": "<=", "GreaterThan": ">", "GreaterThanOrEqual": ">=", "IsNull": "is_null", "IsNotNull": "is_not_null", "In": "in", "InSubquery": "in", "Like": "like", "RLike": "rlike", "LikeAll": "like", "ILike": "ilike"}


@dataclass
class Node:
    name: str
    fields: dict
    children: list["Node"] = field(default_factory=list)
    held: dict[str, list["Node"]] = field(default_factory=dict)

    def walk(self, into: bool = True) -> Iterator["Node"]:
        """This node and all below; into: also what stands in its expressions and common tables."""
        yield self
        for c in self.children:
            yield from c.walk(into)
        if into:
            for nodes in self.held.values():
                for n in nodes:
                    yield from n.walk(into)

    def parts(self, name: str) -> list[str]:
        return [p.strip() for p in str(self.fields.get(name, "")).strip("[]").split(",") if p.strip()]


def _trees(value) -> list[Node]:
    if isinstance(value, dict):
        return [n for v in value.values() for n in _trees(v)] if "product-class" in value else []
    if not isinstance(value, list) or not value:
        return []
    if all(isinstance(v, dict) and "class" in v for v in value):
        nodes = iter(value)
        out = []
        for first in nodes:
            out.append(_build(first, nodes))
        return out
    return [n for v in value for n in _trees(v)]


def _build(raw: dict, rest: Iterator[dict]) -> Node:
    node = Node(raw["class"].rpartition(".")[2].rstrip("$"), raw)
    node.held = {k: t for k, v in raw.items() if k not in ("class", "num-children") and (t := _trees(v))}
    node.children = [_build(next(rest), rest) for _ in range(raw["num-children"])]
    return node


def parse(spark: SparkSession, sql: str) -> Node | None:
    """The statement's plan, or None if it doesn't parse."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.strip().rstrip(";"))
        return _trees(json.loads(plan.toJSON()))[0]
    except Exception as e:  # noqa: BLE001  the parser's error comes through the bridge as several types
        if "ParseException" in type(e).__name__ or "PARSE" in str(e).upper():
            return None
        raise


def _cte_names(root: Node) -> set[str]:
    out = set()
    for n in root.walk():
        if n.name == "UnresolvedWith":
            out |= {x["_1"].lower() for x in n.fields["cteRelations"] if isinstance(x, dict)}
    return out


def _relations(root: Node) -> list[str]:
    hidden = _cte_names(root)
    return sorted({t for n in root.walk() if n.name == "UnresolvedRelation" and (t := n.parts("multipartIdentifier")[-1].lower()) not in hidden})


def _function(n: Node) -> str | None:
    return n.parts("nameParts")[-1].lower() if n.name == "UnresolvedFunction" else None


def skeleton(spark: SparkSession, sql: str) -> dict | None:
    """The statement's structure: tables, joins, clauses, aggregates and a complexity score."""
    root = parse(spark, sql)
    if root is None:
        return None
    nodes = list(root.walk())
    names = [n.name for n in nodes]
    joins = sorted(str(n.fields.get("joinType", {}).get("object", "Inner")).rpartition(".")[2].rstrip("$").upper() for n in nodes if n.name == "Join")
    ctes = _cte_names(root)
    derived = any(n.name == "SubqueryAlias" and n.children and n.children[0].name != "UnresolvedRelation" and str(n.fields["identifier"].get("name", "")).lower() not in ctes for n in nodes)
    out = {
        "tables": _relations(root),
        "join_types": joins,
        "has_join": bool(joins),
        "has_group_by": any(n.name == "Aggregate" and n.held.get("groupingExpressions") for n in nodes),
        "has_having": "UnresolvedHaving" in names,
        "has_subquery": bool(SUBQUERIES & set(names)) or derived,
        "has_cte": "UnresolvedWith" in names,
        "has_distinct": "Distinct" in names,
        "has_order_by": "Sort" in names,
        "has_limit": "GlobalLimit" in names,
        "aggregates": sorted({f for n in nodes if (f := _function(n)) in AGGREGATES}),
        "columns": sorted({n.parts("nameParts")[-1].lower() for n in nodes if n.name == "UnresolvedAttribute"}),
    }
    out["complexity"] = complexity(out)
    return out


def complexity(s: dict) -> int:
    return 2 * len(s["tables"]) + 3 * len(s["join_types"]) + 5 * s["has_group_by"] + 5 * s["has_having"] + 8 * s["has_subquery"] + 6 * s["has_cte"] + 2 * len(s["aggregates"])


SKELETON = "id long, tables array<string>, join_types array<string>, has_join boolean, has_group_by boolean, has_having boolean, has_subquery boolean, has_cte boolean, has_distinct boolean, has_order_by boolean, has_limit boolean, aggregates array<string>, columns array<string>, complexity int"


def skeletons(spark: SparkSession, statements: list[tuple[int, str]]) -> DataFrame:
    """Skeletons of a pool of statements; those that don't parse are left out."""
    names = [f.split()[0] for f in SKELETON.split(", ")][1:]
    rows = [(i, *[s[n] for n in names]) for i, q in statements if (s := skeleton(spark, q)) is not None]
    return spark.createDataFrame(rows, SKELETON)


#: The last pools that were worked out, POOLS at most.
_pools: dict[tuple, DataFrame] = {}
POOLS = 16


def pool_skeletons(spark: SparkSession, statements: list[tuple[int, str]]) -> DataFrame:
    """skeletons() of a pool, worked out once for the same statements: other pools have their own."""
    key = (spark.sparkContext.applicationId, *statements)
    if key not in _pools:
        while len(_pools) >= POOLS:
            del _pools[next(iter(_pools))]
        _pools[key] = skeletons(spark, statements)
    return _pools[key]


def similarity(a: str, b: str, compat: bool = False) -> Column:
    """Structural similarity of skeletons in columns a.* and b.*; identical ones have 1.

    compat: the divisor that lets identical ones have 20/19.
    """
    same = lambda c, w: F.when(F.col(f"{a}.{c}") == F.col(f"{b}.{c}"), float(w)).otherwise(0.0)
    ca, cb = F.col(f"{a}.complexity"), F.col(f"{b}.complexity")
    top = F.greatest(ca, cb)
    near = F.when(top > 0, 1 - F.abs(ca - cb) / top).otherwise(1.0)
    flags = same("has_group_by", 3) + same("has_having", 3) + same("has_subquery", 3) + same("has_cte", 2) + same("has_join", 2)
    sets = 4 * jaccard(F.col(f"{a}.tables"), F.col(f"{b}.tables")) + 2 * jaccard(F.col(f"{a}.aggregates"), F.col(f"{b}.aggregates"))
    return (flags + sets + near) / (19.0 if compat else 20.0)


def cooccurrence(skeletons: DataFrame) -> DataFrame:
    """(t1, t2, n): in how many statements two tables stand together, both ways."""
    t = skeletons.select("id", F.explode("tables").alias("t"))
    pairs = t.select("id", F.col("t").alias("t1")).join(t.select("id", F.col("t").alias("t2")), "id").where("t1 <> t2")
    return pairs.groupBy("t1", "t2").agg(F.count("*").alias("n"))


def related(edges: DataFrame, k: int = 3) -> DataFrame:
    """The k tables most often with each."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("t1").orderBy(F.desc("n"), "t2"))
    return edges.withColumn("rank", rank).where(F.col("rank") <= k)


def bridges(edges: DataFrame, selected: list[str], named: list[str] | None, per: int = 2) -> list[str]:
    """Selected tables and those that often stand with them: of the two most frequent of each, those with a
    count of 3, or with a hypothetical statement those it names or with a count of 6."""
    top = related(edges.where(F.col("t1").isin(selected)), per).where(~F.col("t2").isin(selected))
    ok = F.col("n") >= 3 if named is None else (F.col("n") >= 6) | F.col("t2").isin(named)
    return sorted({*selected, *(r["t2"] for r in top.where(ok).select("t2").distinct().collect())})


def _folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _plain(name: str) -> str:
    """A name in lower case without accents."""
    return _folded(name).lower()


def protected(spark: SparkSession, sql: str, catalog: dict[str, set[str]]) -> dict[str, set[str]]:
    """{table: columns} that the first WHERE and all join conditions name; catalog: columns by table. Names meet
    without accents. A column without qualifier is of the first table that has it, those first whose name begins like it."""
    # the parser takes no accents in bare names
    root = parse(spark, _folded(sql))
    if root is None:
        return {}
    real = {_plain(t): t for t in catalog}
    catalog = {_plain(t): {_plain(c): c for c in cs} for t, cs in catalog.items()}
    alias = {}
    for n in root.walk():
        if n.name == "SubqueryAlias" and n.children and n.children[0].name == "UnresolvedRelation":
            alias[_plain(str(n.fields["identifier"]["name"]))] = _plain(n.children[0].parts("multipartIdentifier")[-1])
    tables = [t for t in map(_plain, _relations(root)) if t in catalog]
    conditions = [c for n in root.walk() if n.name == "Join" for c in n.held.get("condition", [])]
    first = next((n for n in root.walk() if n.name == "Filter"), None)
    conditions += first.held.get("condition", []) if first else []
    out: dict[str, set[str]] = {}
    for n in (x for c in conditions for x in c.walk()):
        if n.name != "UnresolvedAttribute":
            continue
        *owner, column = [_plain(p) for p in n.parts("nameParts")]
        begins = lambda t: not column.startswith(t.replace("tb_", "").replace("vw_", "")[:4])
        near = [alias.get(owner[-1], owner[-1])] if owner else sorted(tables, key=begins)
        for t in near:
            if column in catalog.get(t, ()):
                out.setdefault(real[t], set()).add(catalog[t][column])
                break
    return out


def _expr(n: Node) -> str:
    """An expression without aliases, qualifiers, casts and literals' values."""
    if n.name in ("Alias", "UnresolvedAlias", "Cast", "SortOrder"):
        text = _expr(n.children[0])
        return text + (" desc" if n.name == "SortOrder" and "Descending" in str(n.fields.get("direction")) else "")
    if n.name == "UnresolvedAttribute":
        return n.parts("nameParts")[-1].lower()
    if n.name == "UnresolvedStar":
        return "*"
    if n.name == "Literal":
        return "value"
    if n.name == "UnresolvedFunction":
        args = [_expr(c) for c in n.children]
        if _function(n) == "count" and n.children and n.children[0].name == "Literal":
            args = ["*"]
        return f"{_function(n)}({'distinct ' if n.fields.get('isDistinct') else ''}{', '.join(args)})"
    return f"{n.name.lower()}({', '.join(_expr(c) for c in n.children)})"


def predicates(n: Node, negated: bool = False) -> list[tuple[str, str]]:
    """(column, operator) of a condition; AND and OR are flattened, NOT marks the operator."""
    if n.name in ("And", "Or"):
        return [p for c in n.children for p in predicates(c, negated)]
    if n.name == "Not":
        return predicates(n.children[0], not negated)
    op = COMPARISONS.get(n.name) or _function(n) or n.name.lower()
    return [(_expr(n.children[0]) if n.children else "", ("not_" if negated else "") + op)]


def components(spark: SparkSession, sql: str) -> dict | None:
    """Clauses of the outer statement as sets: select, distinct, from, where, group_by, having, order_by, limit;
    set: the operator and both sides' clauses of a set operation, in any order but for EXCEPT."""
    root = parse(spark, sql)
    return None if root is None else _clauses(root)


def _clauses(root: Node) -> dict:
    out = {"set": None, "select": frozenset(), "distinct": False, "from": frozenset(), "where": frozenset(), "group_by": frozenset(), "having": frozenset(), "order_by": (), "limit": None}
    n: Node | None = root
    while n is not None:
        if n.name in ("Union", "Intersect", "Except"):
            sides = [_clauses(c) for c in n.children]
            out["set"] = (n.name, n.fields.get("isAll"), sides if n.name == "Except" else sorted(sides, key=_in_order))
            break
        if n.name == "GlobalLimit":
            out["limit"] = n.held["limitExpr"][0].fields.get("value")
        elif n.name == "Sort":
            out["order_by"] = tuple(_expr(x) for x in n.held["order"])
        elif n.name == "Distinct":
            out["distinct"] = True
        elif n.name == "UnresolvedHaving":
            out["having"] = frozenset(predicates(n.held["havingCondition"][0]))
        elif n.name == "Aggregate":
            out["select"] = frozenset(_expr(x) for x in n.held.get("aggregateExpressions", []))
            out["group_by"] = frozenset(_expr(x) for x in n.held.get("groupingExpressions", []))
        elif n.name == "Project":
            out["select"] = frozenset(_expr(x) for x in n.held.get("projectList", []))
        elif n.name == "Filter":
            out["where"] = frozenset(predicates(n.held["condition"][0]))
        if n.name in ("Aggregate", "Project", "Filter") and n.children and n.children[0].name not in ("Filter", "Project", "Aggregate"):
            out["from"] = frozenset(_from(n.children[0]))
            break
        n = n.children[0] if n.children else None
    return out


def _in_order(clauses: dict) -> str:
    return str([(k, sorted(map(str, v)) if isinstance(v, frozenset) else str(v)) for k, v in clauses.items()])


def _from(n: Node) -> list[str]:
    """Relations named right in the FROM clause: not those inside subqueries."""
    if n.name == "UnresolvedRelation":
        return [n.parts("multipartIdentifier")[-1].lower()]
    if n.name == "SubqueryAlias" and n.children[0].name != "UnresolvedRelation":
        return ["(subquery)"]
    return [t for c in n.children for t in _from(c)]
