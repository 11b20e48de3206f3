"""Map columns: counters, their sums, and look-ups with a default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(m: Column, key, default) -> Column:
    """The value of a key, or the default where the map is null, has no such key or has null there."""
    return F.coalesce(F.try_element_at(m, key if isinstance(key, Column) else F.lit(key)), default if isinstance(default, Column) else F.lit(default))


def merged(a: Column, b: Column) -> Column:
    """The sums of two counters by key; a null counter is empty."""
    none = F.create_map().cast("map<string,long>")
    return F.map_zip_with(F.coalesce(a, none), F.coalesce(b, none), lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def counters(df: DataFrame, by: list[str], key: str, name: str = "counts") -> DataFrame:
    """(by, counts): for each group how often each key occurs, as a map in order of keys; null keys count under "".

    Keys are counted before a group's rows meet, so a group is as large as it has distinct keys.
    """
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    each = df.groupBy(*by, k.alias("_k")).agg(F.count("*").alias("_n"))
    return each.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_n")))).alias(name))


def nested(df: DataFrame, outer: str, by: str, inner: str = "counts") -> DataFrame:
    """(outer, map of by to map of counts) of rows of counters() by outer and by."""
    return df.groupBy(outer).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(by).cast("string"), F.lit("")), inner)), lambda x, y: F.when(x["col1"] < y["col1"], -1).when(x["col1"] > y["col1"], 1).otherwise(0))).alias(inner))


def text(m: Column) -> Column:
    """A counter as key:value pairs in order of keys."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
