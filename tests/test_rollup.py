"""Maintained aggregates equal those of scans, also after appends; a deep page reads one partition."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from sparkloom.operators import movement, rollup
from sparkloom.sources import tables

SCHEMA = "movement_id long, movement_date date, net_total decimal(18,4), gross_total decimal(18,2), due_total decimal(18,2), movement_type int, customer string, supplier string, status string"


def rows(n, seed=1):
    r = random.Random(seed)
    day = lambda: None if r.random() < 0.05 else dt.date(2020, 1, 1) + dt.timedelta(days=r.randrange(900))
    return [(seed * 10000 + i, day(), Decimal(r.randrange(10**6)) / 100, Decimal(i), Decimal(i) / 2, r.choice([1, 2, 2, 3, None]), r.choice(["a", "b", "é", None]), "s", r.choice("AAI")) for i in range(n)]


def all_of(x):
    return {
        "kpis": [tuple(r) for r in x.kpis().collect()], "day": sorted(map(tuple, x.revenue_by("day").collect())), "month": sorted(map(tuple, x.revenue_by("month").collect())),
        "year": sorted(map(tuple, x.revenue_by("year").collect())), "top": [tuple(r) for r in x.top_customers().collect()], "types": sorted(map(tuple, x.by_type().collect())), "labels": sorted(map(tuple, x.by_label().collect())),
    }


class Scan:
    def __init__(self, df):
        self.df = movement.active(df)

    def __getattr__(self, name):
        return lambda *a: getattr(movement, name)(self.df, *a)


def test_rollup_follows_appends(spark, tmp_path):
    held = rows(300)
    made = rollup.Rollup(spark, f"file://{tmp_path}/r", lambda: spark.createDataFrame(held, SCHEMA))
    assert made.kpis().first()["net_revenue"] == 0
    made.refresh()
    assert all_of(made) == all_of(Scan(spark.createDataFrame(held, SCHEMA)))
    more = [r for r in rows(40, 2) if r[1] is None or r[1].year == 2021]
    held = held + more + [(1, dt.date(2031, 5, 5), Decimal(7), Decimal(7), Decimal(7), 2, "z", "s", "A")]
    before = dict(rollup.versions.current(spark, made.path)[1]["places"])
    made.refresh([r[1] for r in more] + [dt.date(2031, 5, 5)])
    assert all_of(made) == all_of(Scan(spark.createDataFrame(held, SCHEMA)))
    after = rollup.versions.current(spark, made.path)[1]["places"]
    assert after["2020"] == before["2020"] and after["2021"] != before["2021"] and "2031" in after
    # what is gone goes
    held = [r for r in held if r[1] != dt.date(2031, 5, 5)]
    made.refresh([dt.date(2031, 5, 5)])
    assert all_of(made) == all_of(Scan(spark.createDataFrame(held, SCHEMA)))


def test_pages(spark, tmp_path):
    df = spark.createDataFrame(rows(500), SCHEMA).select(*movement.PAGE)
    made = rollup.Pages.write(df, f"file://{tmp_path}/p", movement.latest(), 6)
    whole = [tuple(r) for r in df.orderBy(*movement.latest()).collect()]
    assert made.total == 500
    for number, size in ((1, 7), (13, 7), (72, 7), (73, 7), (1, 1000), (3, 170)):
        got = [tuple(r) for r in made.page(number, size).collect()]
        assert got == [(*r, 500) for r in whole[(number - 1) * size : number * size]]
    assert len(made.places(60, 7)) <= 2 and len(made.counts) > 3
    plan = made.page(60, 7)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "part#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert rollup.Pages.write(df.limit(0), f"file://{tmp_path}/q", movement.latest(), 3).page(1, 5).collect() == []


def test_month_of(spark):
    assert spark.range(1).select(rollup.month_of(F.lit(dt.date(2020, 3, 1))), rollup.month_of(F.lit(None).cast("date"))).first()[:] == (2020 * 12 + 2, 0)


def test_lines_are_dealt_before_they_are_added_up(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    tables.views(spark, sf, "orders", "lineitem", "customer", "supplier")
    whole = sorted(map(tuple, spark.sql(movement.MOVEMENT_SQL).collect()))
    for size, dealt in ((1 << 30, "REPARTITION_BY_COL"), (3000, "REPARTITION_BY_NUM")):
        monkeypatch.setattr(movement, "LINE_BYTES", size)
        df = movement.movement(spark, sf)
        plan = [x.strip(" :+-*(0123456789)") for x in df._jdf.queryExecution().sparkPlan().toString().splitlines()]
        # below the sums, with no partial ones under it
        at = next(i for i, x in enumerate(plan) if dealt in x)
        assert any("Aggregate" in x for x in plan[:at]) and not any("Aggregate" in x for x in plan[at:])
        # what it takes is what the view takes
        assert sorted(map(tuple, df.collect())) == whole
    n = int(dealt == "REPARTITION_BY_NUM" and movement.lines(spark, sf).rdd.getNumPartitions())
    assert n == -(-sum(x[1] for x in rollup.versions.fingerprint(spark, f"{sf}/lineitem.parquet")) // 3000) > 4
