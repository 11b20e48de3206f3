"""Document fingerprints by winnowing, with DataFrame functions alone.

The units of a text are its words, and the characters of words of more than LONG characters, so that scripts
without spaces have runs too. Each unit is hashed once; the hash of a run of K units is a polynomial in those of
its units and rolls: the unit that leaves is taken off, the one that comes is added (it starts anew every BLOCK
places, so that no array grows with the text while it is built). Of every W neighbouring runs the one with the
least hash is kept, the rightmost of equals, with its position. A kept value is one number: 31 bits of hash, then
the position counted down, so the least number is the least hash at the rightmost place. Two texts that share
K + W - 1 units in a row share a fingerprint.

Defined results: null text counts as empty; texts without words have no fingerprint; texts below K units have
one, of all their units; the likeness of two documents without fingerprints is 1; documents that repeat a
doc_id follow each other in order of text, those without doc_id come after all others, in order of text too; an
empty table gives an empty table; a single document is its own neighbour.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

K, W = 5, 8
PLACES = (1 << 31) - 1
#: Characters of a word from which on each of them is a unit of its own.
LONG = 25
#: The rolling hash is a polynomial with this base over the field of P elements, a Mersenne prime.
P, BASE = (1 << 31) - 1, 1_000_003
#: Places after which the rolling hash starts anew.
BLOCK = 32
#: Characters of a text by which documents without doc_id, or with the same, are cut into ranges.
LEAD = 64
SEPARATORS = "[\\x20\\x09-\\x0D]+"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def units(text: Column) -> Column:
    """The words of a text, long ones character by character."""
    words = F.split(F.trim(text, F.lit(" \t\n\x0b\x0c\r")), SEPARATORS)
    cut = F.flatten(F.transform(words, lambda w: F.when(F.char_length(w) >= LONG, F.split(w, "")).otherwise(F.array(w))))
    return F.when(text.rlike(f"[^\\x20\\x09-\\x0D]{{{LONG}}}"), cut).otherwise(words)


def rolled(h: Column, k: int = K) -> Column:
    """The hashes of all runs of k of the numbers h (each below P), of which there are k at least."""
    top = pow(BASE, k - 1, P)

    def block(start: Column) -> Column:
        first = F.lit(0).cast("long")
        for j in range(k):
            first = (first * BASE + F.get(h, start + j)) % P
        steps = F.sequence(start + 1, F.least(start + BLOCK - 1, F.size(h) - k))
        steps = F.when(start < F.size(h) - k, steps).otherwise(F.array().cast("array<int>"))

        def roll(held: Column, i: Column) -> Column:
            left = F.get(h, i - 1) * top % P
            return F.array_append(held, ((F.element_at(held, -1) + P - left) * BASE + F.get(h, i + k - 1)) % P)

        return F.aggregate(steps, F.array(first), roll)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(h) - k, F.lit(BLOCK)), block))


def fingerprint(text: Column, k: int = K, w: int = W) -> Column:
    """The kept values of a text, in order of position."""
    hashed = lambda x: F.pmod(F.xxhash64(x), F.lit(P))

    def value(h: Column, place: Column) -> Column:
        return F.shiftleft(h, 31).bitwiseOR(PLACES - place.cast("long"))

    def grams(us: Column) -> Column:
        runs = let(F.transform(us, hashed), lambda h: F.transform(rolled(h, k), value))
        return F.when(F.size(us) < k, F.array(value(hashed(us), F.lit(0)))).otherwise(runs)

    def kept(g: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(g) - w), lambda i: F.least(*[F.get(g, i + j) for j in range(w)]))
        return F.when(F.size(g) <= w, F.array(F.array_min(g))).otherwise(F.array_distinct(windows))

    none = F.array().cast("array<bigint>")
    return let(units(text), lambda us: F.when(F.get(us, 0) == "", none).otherwise(let(grams(us), kept)))


def hashes(fp: Column) -> Column:
    return F.array_distinct(F.transform(fp, lambda v: F.shiftright(v, 31)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints' hashes."""
    both = let(F.struct(hashes(a).alias("a"), hashes(b).alias("b")), lambda x: F.struct(F.size(F.array_intersect(x["a"], x["b"])).alias("i"), F.size(F.array_union(x["a"], x["b"])).alias("u")))
    return let(both, lambda x: F.when(x["u"] == 0, 1.0).otherwise(x["i"] / x["u"]))


def as_text(fp: Column) -> Column:
    """hash@position of each kept value."""
    one = lambda v: F.concat(F.lower(F.hex(F.shiftright(v, 31))), F.lit("@"), (PLACES - v.bitwiseAND(PLACES)).cast("string"))
    return F.array_join(F.transform(fp, one), " ")


def last_at_most(bounds: Column, key: Column, steps: int) -> Column:
    """Place of the last of the sorted bounds that isn't above the key, by halving; the first is never above it."""

    def halve(at: Column, _: Column) -> Column:
        mid = F.shiftright(at["lo"] + at["hi"], 1)
        below = F.get(bounds, mid) <= key
        return F.struct(F.when(below, mid).otherwise(at["lo"]).alias("lo"), F.when(below, at["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda at: at["lo"])


def with_next(docs: DataFrame, k: int = K, w: int = W, parts: int | None = None) -> DataFrame:
    """(doc_id, text, fp, next_text, next_fp): each document with the next in descending doc_id, the last with
    the first.

    Keys alone are dealt into ranges by Spark's own range partitioning; their first keys, one per range, are the
    bounds by which the texts are then shuffled, once. Each range also gets the first document of the range after
    it, as a row that is only looked at. Rows equal in doc_id go by their first characters, then by a hash of the text; only
    rows equal in doc_id and text share a range.
    """
    spark = docs.sparkSession
    n = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # ascending keys for descending doc_ids, nulls last
    parts_of_key = {"nameless": F.col("doc_id").isNull().cast("int"), "down": F.coalesce(F.bitwise_not("doc_id"), F.lit(0)), "lead": F.substring("text", 1, LEAD), "mark": F.xxhash64("text")}
    keyed = base.withColumn("key", F.struct(*[c.alias(name) for name, c in parts_of_key.items()]))
    dealt = keyed.select("key").repartitionByRange(n, "key").select("key", F.spark_partition_id().alias("part"))
    firsts = store.saved(dealt.groupBy("part").agg(F.min("key").alias("key")), "range-firsts")
    firsts = firsts.withColumn("part", F.row_number().over(Window.orderBy("key")) - 1)  # one row per range
    bounds = firsts.agg(F.array_sort(F.collect_list("key")).alias("keys")).scalar()
    rows = keyed.withColumn("bounds", bounds).withColumn("part", last_at_most(F.col("bounds"), F.col("key"), max(1, n.bit_length())))
    last = F.max("part").over(Window.partitionBy())
    above = firsts.select("key", F.when(F.col("part") > 0, F.col("part") - 1).otherwise(last).alias("part"))
    heads = keyed.join(above, "key").groupBy("part").agg(F.min("text").alias("text"))
    shown = rows.select("part", F.lit(0).alias("head"), "key", "doc_id", "text")
    shown = shown.unionByName(heads.withColumn("head", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy("part").orderBy("head", "key", "text")
    held = shown.repartition("part").withColumn("fp", fingerprint(F.col("text"), k, w))
    held = held.select("*", F.lead("text").over(order).alias("next_text"), F.lead("fp").over(order).alias("next_fp"))
    return held.where("head = 0").select("doc_id", "text", "fp", "next_text", "next_fp")


def with_edited(rows: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Adds n_chars, edited (the last half replaced by as much of the next text) and edited_fp."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    return rows.withColumn("edited", edited).withColumn("edited_fp", fingerprint(F.col("edited"), k, w))


def fingerprinted(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    rows = with_edited(with_next(docs, k, w), k, w)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
