"""Mixing sources to target weights, with DataFrame operations alone.

Sizes are summed per source; the target shares are filled up to a multiple of each source's size, the excess
going to the others by weight, in closed form over the sources; a source's repetition rate is target / size.
A document is emitted floor(rate) times and once more if its own draw, a number in [0, 1) hashed from the seed
and its doc_id, lies below the rate's fraction. Draws are independent: another document never changes a draw, only
the rate that it is held against. So a source's sum strays from its target by about the root of the sum of its
squared sizes; the README has figures. Rates are one row per source, joined by a broadcast where they are small;
documents are never shuffled.

The rates are worked out by one task that ranks the sources: 100 bytes each, so some ten million sources fit.

Defined results: null text has size 0; a null source is a source of its own; a source without words has rate
0; rows that repeat a doc_id share its draw; rows without doc_id draw by their text; an empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

#: Hexadecimal digits of a digest that make a draw: 52 bits, all that a double holds exactly.
DRAW_DIGITS = 13
SEPARATORS = "[\\x20\\x09-\\x0D]"


def n_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null: 0."""
    edge = lambda c: F.when(c.rlike(SEPARATORS), 1).otherwise(0)
    runs = F.size(F.split(text, SEPARATORS + "+")) - edge(F.substring(text, 1, 1)) - edge(F.substring(text, -1, 1))
    return F.when(text.isNull() | (text == ""), 0).otherwise(runs).cast("long")


def source_rates(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """(source, source_size, n_docs, weight, target, rate) from rows (source, size).

    weights repeat over the sources in code point order, null last. With the sources sorted by the level at
    which each reaches its limit, those below the water level are full; the level follows from running sums.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    k = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (k % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    # the sources are few: one row each
    fill = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = per.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum("limit").over(before), F.lit(0.0)).alias("full_before"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weight_from"),
    )
    level = (F.col("total") - F.col("full_before")) / F.col("weight_from")
    # taking a source as full raises the level just as long as it is below it: the water level is the highest
    per = per.withColumn("level", F.max(level).over(everything))
    target = F.least(F.col("limit"), F.col("level") * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    return per.select("source", "source_size", "n_docs", "weight", target.alias("target"), rate.alias("rate"))


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) from the seed and the document."""
    key = F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit(""))))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, DRAW_DIGITS)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(16**DRAW_DIGITS))


def drawn(docs: DataFrame, weights: tuple[float, ...], most: float, seed: int) -> DataFrame:
    """(row, source, size, source_size, target, copies): row has the columns of docs, whatever their names."""
    held = docs.select(F.struct("*").alias("row"), "source", n_words(F.col("text")).alias("size"))
    # written first, so that the planner knows their size: a handful is broadcast, many are sort-merged
    rates = store.saved(source_rates(docs.select("source", n_words(F.col("text")).alias("size")), weights, most), "rates")
    held = held.join(rates, held["source"].eqNullSafe(rates["source"])).drop(rates["source"])
    whole = F.floor("rate")
    extra = F.when(draw(F.col("row.doc_id"), F.col("row.text"), seed) < F.col("rate") - whole, 1).otherwise(0)
    return held.select("row", "source", "size", "source_size", "target", (whole + extra).cast("long").alias("copies"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, seed: int = 7) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies): how often each document is emitted."""
    docs = docs.select("doc_id", "text", "source")
    return drawn(docs, weights, most, seed).select("row.doc_id", "size", "source", "source_size", "target", "copies")


def emitted(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, seed: int = 7) -> DataFrame:
    """The mix itself: each row as often as it is taken, with its columns as they were."""
    held = drawn(docs, weights, most, seed).where("copies > 0")
    return held.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"), F.lit(1))).alias("copy")).select("row.*")
