"""Maintained aggregates of the dashboard, and its pages by key.

Rollup: sums by day and type, and of sales by month and customer, in folders by year. A refresh works out the months of changed
dates only, and writes them with the other months that their years had; a manifest, written last, tells which
write each year is read from. KPIs, series, rankings and pies add up these few rows.

Pages: rows in their order in range partitions with counts. A page is read from the partitions that hold it, which
the counts tell, however deep it lies; the total is the sum of the counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators import movement
from sparkloom.sources import versions

MONEY = "decimal(38,4)"
DAILY = f"movement_date date, movement_type int, net_total {MONEY}, gross_total {MONEY}, due_total {MONEY}, n long, month int, year int"
CUSTOMERS = f"customer string, net_total {MONEY}, month int, year int"


def month_of(date: Column) -> Column:
    """Months since the year 0; 0 without a date."""
    return F.coalesce(F.year(date) * 12 + F.month(date) - 1, F.lit(0))


class Rollup:
    """The aggregates at a path of a shared folder, of active movements that source() gives: all columns of the view."""

    def __init__(self, spark: SparkSession, path: str, source: Callable[[], DataFrame]):
        self.spark, self.path, self.source = spark, path, source

    def refresh(self, dates: Iterable | None = None) -> int:
        """Works out the months of some dates (None among them: rows without date) anew, or all; returns the version."""
        now, content = versions.current(self.spark, self.path)
        number, write = versions.following(self.spark, self.path), uuid.uuid4().hex
        rows = movement.active(self.source()).withColumn("month", month_of(F.col("movement_date")))
        places, months, years = dict(content.get("places", {})), [], []
        if dates is None:
            places = {}
        else:
            months = sorted({0 if d is None else d.year * 12 + d.month - 1 for d in dates})
            years = sorted({m // 12 for m in months})
            rows = rows.where(F.col("month").isin(months))
        net, gross, due = (F.sum(movement.money(F.col(c))).cast(MONEY).alias(c) for c in ("net_total", "gross_total", "due_total"))
        daily = rows.groupBy("month", "movement_date", "movement_type").agg(net, gross, due, F.count("*").alias("n"))
        sales = rows.where((F.col("movement_type") == movement.SALE) & F.col("customer").isNotNull()).groupBy("month", "customer").agg(net)
        for name, part, schema in (("daily", daily, DAILY), ("customers", sales, CUSTOMERS)):
            part = part.withColumn("year", F.floor(F.col("month") / 12).cast("int"))
            if years:
                part = part.unionByName(self._read(name, schema).where(F.col("year").isin(years) & ~F.col("month").isin(months)))
            part.hint("rebalance", "year").write.partitionBy("year").parquet(f"{self.path}/{name}/{write}")
        held = self.spark.read.schema(DAILY).parquet(f"{self.path}/daily/{write}").select("year").distinct().collect()
        places = {y: w for y, w in places.items() if int(y) not in years} | {str(r["year"]): write for r in held}
        if versions.current(self.spark, self.path)[0] != now:
            raise versions.Conflict(f"version {now} of {self.path} isn't the last any more")
        versions.commit(self.spark, self.path, number, {"places": places})
        return number

    def _read(self, name: str, schema: str) -> DataFrame:
        by_write: dict[str, list[int]] = {}
        for year, write in versions.current(self.spark, self.path)[1].get("places", {}).items():
            by_write.setdefault(write, []).append(int(year))
        out = None
        for write, years in sorted(by_write.items()):
            part = self.spark.read.schema(schema).parquet(f"{self.path}/{name}/{write}").where(F.col("year").isin(years))
            out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], schema) if out is None else out

    def daily(self) -> DataFrame:
        return self._read("daily", DAILY)

    def kpis(self) -> DataFrame:
        return movement.kpis(self.daily())

    def formatted_kpis(self) -> DataFrame:
        return movement.formatted_kpis(self.daily())

    def revenue_by(self, unit: str) -> DataFrame:
        return movement.revenue_by(self.daily(), unit)

    def top_customers(self, n: int = 10) -> DataFrame:
        return movement.top_customers(self._read("customers", CUSTOMERS).withColumn("movement_type", F.lit(movement.SALE)), n)

    def by_type(self) -> DataFrame:
        return self.daily().where("movement_type is not null").groupBy("movement_type").agg(F.sum("n").alias("n"))

    def by_label(self) -> DataFrame:
        return self.by_type().groupBy(movement.label(F.col("movement_type")).alias("label")).agg(F.sum("n").alias("n"))


class Pages:
    """Rows in order, for reading pages of them. order: columns as orderBy takes them, a total order."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        _, content = versions.current(spark, path)
        self.schema, self.counts, self.write_id = content.get("schema"), content.get("counts", []), content.get("write")

    @classmethod
    def write(cls, rows: DataFrame, path: str, order: list[Column], parts: int) -> "Pages":
        """Writes the rows in range partitions, each in order; the rank within one is kept with its rows."""
        spark, write = rows.sparkSession, uuid.uuid4().hex
        number = versions.following(spark, path)
        dealt = rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
        at = F.row_number().over(Window.partitionBy("part").orderBy(*order))
        # ranges stay as they are dealt: the partition is one of the window
        dealt.withColumn("at", at.cast("long")).write.partitionBy("part").parquet(f"{path}/rows/{write}")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", at long, part int"
        held = spark.read.schema(schema).parquet(f"{path}/rows/{write}").groupBy("part").agg(F.count("*").alias("n")).collect()
        versions.commit(spark, path, number, {"schema": schema, "write": write, "counts": sorted([r["part"], r["n"]] for r in held)})
        return cls(spark, path)

    @property
    def total(self) -> int:
        return sum(n for _, n in self.counts)

    def places(self, number: int, size: int) -> list[tuple[int, int, int]]:
        """(partition, first, last) of a page's rows, by their rank in the partition."""
        out, before = [], 0
        lo, hi = (number - 1) * size, number * size
        for part, n in self.counts:
            first, last = max(lo - before, 0) + 1, min(hi - before, n)
            if first <= last:
                out.append((part, first, last))
            before += n
        return out

    def page(self, number: int, size: int) -> DataFrame:
        """The page's rows in order, with the total; numbers start at 1, a page beyond the last has no rows."""
        if not self.schema:
            raise ValueError(f"nothing has been written at {self.path}")
        held = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows/{self.write_id}")
        wanted = F.lit(False)
        for part, first, last in self.places(number, size):
            wanted = wanted | ((F.col("part") == part) & F.col("at").between(first, last))
        found = held.where(wanted).orderBy("part", "at")
        return found.drop("part", "at").withColumn("total", F.lit(self.total).cast("long"))
