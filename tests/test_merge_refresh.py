"""Global positions, mergeable campaign counts and the incremental refresh."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from leadflow.operators import compare, distinct, ordering, rollups
from leadflow.plans import refresh
from leadflow.session import scratch_path
from leadflow.sources import io

D = dt.date


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------ order

def test_positions_are_the_sorted_places(spark):
    rows = [(random.Random(k).randrange(50) if k % 9 else None, k) for k in range(500)]
    df = spark.createDataFrame(rows, "v int, k int").repartition(7)
    out = ordering.with_position(df, F.col("v").desc_nulls_last(), F.col("k").asc())
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [(r.v, r.k) for r in sorted(out.collect(), key=lambda r: r.position)] == want
    assert sorted(r.position for r in out.collect()) == list(range(1, 501))
    assert "Window" not in plan_of(out)
    assert ordering.with_position(df.limit(0), F.col("k")).count() == 0


def test_sort_by_attribute_places_missing_last(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", None), ("c", 5.0), ("d", 2.0)], "campaign_id string, take_up_rate double")
    for up, want in ((True, "adcb"), (False, "cadb")):
        out = compare.sort_by_attribute(df, "take_up_rate", up, ties=["campaign_id"]).collect()
        assert "".join(r.campaign_id for r in out) == want and [r.position for r in out] == [1, 2, 3, 4]


# ------------------------------------------------------------ mergeable counts

def test_numbers_go_on_from_the_known_ones(spark):
    ids = lambda *c: spark.createDataFrame([(x,) for x in c], "campaign_id string")
    first = distinct.number_campaigns(ids("b", "a", "b", None))
    assert {r.campaign_id: r.campaign_no for r in first.collect()} == {"a": 1, "b": 2}
    more = distinct.number_campaigns(ids("c", "a", "0"), first)
    assert {r.campaign_id: r.campaign_no for r in more.collect()} == {"0": 3, "c": 4}
    assert distinct.number_campaigns(ids("x").limit(0)).count() == 0


def test_counts_merge_over_groups_and_buckets(spark):
    # campaign k is in groups k % 3 and k % 5, so most are in two; numbers fill two buckets and more
    n = 70_000
    cells = spark.range(1, n + 1).select(F.col("id").alias("campaign_no"), F.explode(F.array(F.col("id") % 3, 10 + F.col("id") % 5)).alias("g"),
                                         F.lit(1).cast("long").alias("leads"))
    agg = distinct.campaign_bits(cells, ["g"], ["leads"])
    got = distinct.merged_counts(agg, [], ["leads"]).first()
    assert (got.leads, got.total_campaigns) == (2 * n, n)
    some = distinct.merged_counts(agg.filter("g IN (0, 10, 11)"), [], ["leads"]).first()
    assert some.total_campaigns == sum(1 for k in range(1, n + 1) if k % 3 == 0 or k % 5 in (0, 1))
    by = {r.big: r.total_campaigns for r in distinct.merged_counts(agg.withColumn("big", F.col("g") >= 10), ["big"], ["leads"]).collect()}
    assert by == {False: n, True: n}
    assert {r.g: r.campaign_count for r in agg.collect()}[0] == n // 3


def test_rows_without_a_numbered_campaign_still_count_leads(spark):
    cells = spark.createDataFrame([(1, None, 5), (2, 7, 3)], "g int, campaign_no long, leads long")
    agg = distinct.campaign_bits(cells, ["g"], ["leads"])
    assert {r.g: r.campaign_count for r in agg.collect()} == {1: 0, 2: 1}
    assert tuple(distinct.merged_counts(agg, [], ["leads"]).first()) == (8, 1)
    assert tuple(distinct.merged_counts(agg.filter("g = 1"), [], ["leads"]).first()) == (5, 0)


# ------------------------------------------------------------ refresh

LEADS = ("cif string, nama_program string, flag_program string, jenis_leads string, media_blasting string, wilayah int, "
         "periode_start date, year int, month int, take_up_flag string, take_up_date date, time_to_take_up_days int, "
         "total_transaction_value double, campaign_id string")


def leads_of(spark, seed, months, n=120):
    """Some leads of these months of 2024; which campaigns there are depends on the seed."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        m = rng.choice(months)
        start = D(2024, m, rng.choice([1, 2, 29 if m != 2 else 28]))
        name = f"P{rng.randrange(4)}"
        gap = rng.choice([None, rng.randrange(40)])
        value = None if gap is None or rng.random() < 0.2 else rng.randrange(10 ** 6) / 100
        rows.append((str(k), name, f"F{rng.randrange(2)}", "x", rng.choice(["WA", "SMS", None]), rng.randrange(1, 4), start, 2024, m,
                     "NO" if gap is None else "YES", None if gap is None else start + dt.timedelta(gap), gap, value, f"{name}_{start}"))
    return spark.createDataFrame(rows, LEADS)


def tables(spark, zone):
    def rows(df, *drop):
        cols = sorted(c for c in df.columns if c not in drop)
        return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    over = refresh.overview(spark, zone)
    return {"leads": rows(io.read_enriched_leads(spark, zone.path("leads"))),
            "campaigns": rows(io.read_campaigns(spark, zone.path("campaigns"))),
            "weekly": rows(refresh.weekly(spark, zone)), "overview": rows(over, distinct.BITS),
            "totals": rows(rollups.overview_totals_from_agg(over)),
            "by region": rows(rollups.overview_by(over.filter("product = 'F0'"), ["region"]))}


@pytest.fixture(scope="module")
def catalogue(spark):
    """Some campaigns are long, so their periods are months."""
    return spark.createDataFrame([(f"P{p}_2024-{m:02d}-01", D(2024, m, 1), D(2024, m, 1) + dt.timedelta(200 if p % 2 else 10))
                                  for p in range(4) for m in range(1, 13)], "campaign_id string, start_date date, end_date date")


def rebuilt(spark, leads, catalogue):
    zone = refresh.Zone(scratch_path(spark, "t-zone"))
    refresh.build(spark, zone, leads, catalogue)
    return zone


def test_refresh_equals_a_rebuild(spark, catalogue):
    old, new = leads_of(spark, 1, [1, 2, 3, 4, 5]), leads_of(spark, 2, [3, 6], 60)      # April loses all its leads, June is new
    months = [(2024, 3), (2024, 4), (2024, 6)]
    zone = rebuilt(spark, old, catalogue)
    stage = refresh.stage(spark, zone, new, months, scratch_path(spark, "t-stage"), catalogue)
    before = tables(spark, zone)
    assert before == tables(spark, rebuilt(spark, old, catalogue))                       # staging touches nothing
    refresh.publish(spark, zone, stage)
    after = old.filter(~F.col("month").isin(3, 4)).unionByName(new)
    want = tables(spark, rebuilt(spark, after, catalogue))
    assert tables(spark, zone) == want and want != before
    refresh.publish(spark, zone, stage)                                                  # repeated after a failure
    assert tables(spark, zone) == want
    refresh.refresh(spark, zone, old, months, scratch_path(spark, "t-stage"), catalogue)  # and back again
    assert tables(spark, zone) == before


def test_refresh_reads_changed_partitions_only(spark, catalogue):
    zone = rebuilt(spark, leads_of(spark, 5, [1, 2, 3]), catalogue)
    master = io.read_campaigns(spark, zone.path("campaigns")).filter(refresh.in_months([(2024, 2)]))
    plan = plan_of(master)
    assert "PartitionFilters: [" in plan and "year" in plan.split("PartitionFilters: [")[1].split("]")[0] and "DataFilters: []" in plan


def test_replace_months_leaves_the_others(spark):
    path = scratch_path(spark, "t-months")
    df = spark.createDataFrame([("a", 2024, 1), ("b", 2024, 2), ("c", 2023, 2)], "campaign_id string, year int, month int")
    io.write_campaigns_partitioned(df, path)
    io.replace_months(spark.createDataFrame([("z", 2024, 2)], df.schema), path)
    got = sorted(tuple(r) for r in io.read_campaigns(spark, path).select("campaign_id", "year", "month").collect())
    assert got == [("a", 2024, 1), ("c", 2023, 2), ("z", 2024, 2)]
    io.drop_partition(spark, path, year=2024, month=2)
    io.drop_partition(spark, path, year=1999, month=1)
    assert io.read_campaigns(spark, path).count() == 2
