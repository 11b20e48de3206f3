"""Trees of any depth by numbers: each node has the interval of its leaves in its tree, so expansion is one join.

Leaves of a tree are numbered from 0 in order of their paths; a node's interval goes from its first leaf to its last. A node
whose parent isn't there is a root (a branch that was cut off keeps its own numbers). Numbers are worked out level by
level, from the leaves up and from the roots down, with one join a level; they are written with the nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.sources import versions


def _written(df: DataFrame, name: str) -> DataFrame:
    path = versions.new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(nodes: DataFrame, node: str = "node_id", parent: str = "parent_id", most: int = 64) -> DataFrame:
    """nodes with root, depth, first and last: the root of the tree, levels below it, and the interval of leaves.

    Siblings go in order of their ids. Cycles, and trees deeper than most, are an error.
    """
    slim = nodes.select(F.col(node).alias("id"), F.col(parent).alias("up"))
    known = slim.select(F.col("id").alias("up"))
    edges = _written(slim.join(known.withColumn("there", F.lit(True)), "up", "left").select("id", F.when(F.col("there"), F.col("up")).alias("up")), "tree-edges")
    # downwards: the level of each node
    level = _written(edges.where("up is null").select("id", F.lit(None).cast(slim.schema["id"].dataType).alias("up"), F.col("id").alias("root"), F.lit(0).alias("depth")), "tree-level")
    levels = []
    while not level.isEmpty():
        if len(levels) > most:
            raise ValueError(f"a tree is deeper than {most} levels")
        levels.append(level)
        above = level.select(F.col("id").alias("up"), "root")
        level = _written(edges.join(above, "up").select("id", "up", "root", F.lit(len(levels)).alias("depth")), "tree-level")
    if sum(x.count() for x in levels) != edges.count():
        raise ValueError("the nodes have a cycle")
    # upwards: how many leaves each has; then downwards: how many stand before it
    sized: list[DataFrame] = []
    for k in reversed(range(len(levels))):
        held = levels[k]
        if sized:
            sums = sized[-1].groupBy("up").agg(F.sum("leaves").alias("leaves")).withColumnRenamed("up", "id")
            held = held.join(sums, "id", "left").withColumn("leaves", F.coalesce("leaves", F.lit(1)))
        else:
            held = held.withColumn("leaves", F.lit(1).cast("long"))
        sized.append(_written(held, "tree-sizes"))
    sized.reverse()
    done: list[DataFrame] = []
    for k, held in enumerate(sized):
        if k == 0:
            placed = held.withColumn("first", F.lit(0).cast("long"))
        else:
            before = F.coalesce(F.sum("leaves").over(Window.partitionBy("up").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            placed = held.withColumn("before", before).join(done[-1].select(F.col("id").alias("up"), F.col("first").alias("base")), "up")
            placed = placed.withColumn("first", F.col("base") + F.col("before")).select(*held.columns, "first")
        done.append(_written(placed, "tree-placed"))
    if not done:
        return nodes.select("*", F.col(node).alias("root"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("last"))
    whole = done[0]
    for x in done[1:]:
        whole = whole.unionByName(x)
    numbers = whole.select(F.col("id").alias("_id"), "root", "depth", "first", (F.col("first") + F.col("leaves") - 1).alias("last"))
    return nodes.join(numbers, nodes[node].eqNullSafe(numbers["_id"])).drop("_id")


def leaves(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hits (node_id, score) replaced by the leaves below them, which inherit the score; a hit that is a leaf is its own.
    nodes: of numbered(). A leaf below several hits comes once for each."""
    wide = hits.select("node_id", "score").join(nodes.select("node_id", "root", "first", "last"), "node_id").select("root", "first", "last", "score")
    # leaves are nodes that nothing stands below: those whose place no deeper node has
    ends = nodes.groupBy("root", F.col("first").alias("at")).agg(F.max(F.struct("depth", "node_id")).alias("end")).select("root", "at", F.col("end.node_id").alias("node_id"))
    return ends.join(wide, "root").where(F.col("at").between(F.col("first"), F.col("last"))).select("node_id", "score")
