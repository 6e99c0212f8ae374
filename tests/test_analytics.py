"""Analytics semantics on small inline inputs, mirroring the product's own
unit tests (bins, statistics, shares, granularity, ranking, top-k)."""

import datetime as dt
import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from leadflow.functions.exprs import granularity
from leadflow.operators import compare, criteria, recommend, rollups, similarity, time_analysis

D = dt.date


def days_df(spark, per_campaign):
    rows = [(cid, "YES", D(2024, 1, 1), d, "WA", 1)
            for cid, ds in per_campaign.items() for d in ds]
    return spark.createDataFrame(
        rows, "campaign_id string, take_up_flag string, take_up_date date, "
              "time_to_take_up_days int, media_blasting string, wilayah int")


def test_histogram_bins_and_boundaries(spark):
    df = days_df(spark, {"A": [0, 1, 6, 7, 13, 95], "B": [90, 100, 200], "C": [-3, 5]})
    h = {(r.campaign_id, r.bin_index): r for r in time_analysis.time_histogram(df).collect()}
    assert [h[("A", i)]["count"] for i in range(7)] == [3, 2, 0, 0, 0, 0, 1]
    assert [h[("B", i)]["count"] for i in range(7)] == [0, 0, 0, 0, 0, 0, 3]
    assert h[("A", 6)].range_end is None and h[("A", 0)].range_end == 7
    assert h[("A", 0)].percentage == 50.0
    # a negative gap is in the total but in no bin
    assert h[("C", 0)]["count"] == 1 and h[("C", 0)].percentage == 50.0
    assert sum(h[("C", i)]["count"] for i in range(7)) == 1


def test_statistics_exact_median(spark):
    df = days_df(spark, {"A": [1, 2, 3, 4], "B": [1, 2, 3, 10], "C": [5]})
    s = {r.campaign_id: r for r in time_analysis.time_stats(df).collect()}
    assert s["A"].median_days == 2.5 and s["A"].mean_days == 2.5
    assert s["B"].median_days == 2.5 and (s["B"].min_days, s["B"].max_days) == (1, 10)
    assert s["C"].total_take_up == 1


def test_filter_channel_region(spark):
    df = days_df(spark, {"A": [1, 2]})
    assert time_analysis.filter_channel_region(df, channel="wa", region="1").count() == 2
    assert time_analysis.filter_channel_region(df, region="x").count() == 0


@pytest.mark.parametrize("counts", [{"X": 333, "Y": 333, "Z": 334}, {"A": 1, "B": 1, "C": 1},
                                    {"A": 7}, {"A": 1, "B": 2, "C": 3, "D": 5, "E": 11}])
def test_shares_sum_to_exactly_100(spark, counts):
    df = spark.createDataFrame([("c", "a", k, v) for k, v in counts.items()],
                               "campaign_id string, attribute string, label string, count long")
    out = {r.label: r.percentage for r in criteria.shares_to_100(df, ["campaign_id", "attribute"]).collect()}
    assert abs(sum(out.values()) - 100.0) < 1e-9
    if counts == {"A": 1, "B": 1, "C": 1}:
        assert out == {"A": 33.3333, "B": 33.3333, "C": 33.3334}


def test_criteria_skips_blank_labels(spark):
    df = spark.createDataFrame(
        [("c", " MASS ", "GEN Z", "WA", "CRS", "P", "YES"), ("c", "", None, "WA", "CRS", "P", "NO"),
         ("c", "MASS", "GEN Z", "WA", "CRS", "P", "NO")],
        "campaign_id string, segment_by_aum string, range_usia string, media_blasting string, "
        "segment_div_owner string, flag_program string, take_up_flag string")
    rows = {(r.attribute, r.label): r for r in criteria.criteria_distribution(df).collect()}
    assert rows[("segment_by_aum", "MASS")]["count"] == 2
    assert rows[("segment_by_aum", "MASS")].take_up_percentage == 50.0
    av = {r.attribute: r.available for r in criteria.criteria_availability(df).collect()}
    assert all(av.values())


def test_granularity_boundary(spark):
    df = spark.createDataFrame([(D(2024, 1, 1), D(2024, 3, 31)), (D(2024, 1, 1), D(2024, 4, 1))],
                               "s date, e date")
    got = [r[0] for r in df.select(granularity(F.datediff("e", "s"))).collect()]
    assert got == ["weekly", "monthly"]


def test_period_buckets(spark):
    df = spark.createDataFrame([(D(2024, 1, 10), "weekly"), (D(2024, 2, 10), "monthly")],
                               "periode_start date, granularity string")
    r = rollups.with_period_buckets(df).collect()
    assert (r[0].period_bucket, r[0].period_end) == (D(2024, 1, 8), D(2024, 1, 14))
    assert (r[1].period_bucket, r[1].period_end) == (D(2024, 2, 1), D(2024, 2, 29))


def test_compare_keeps_unknown_ids(spark):
    m = spark.createDataFrame([("A", "n", "p", 10, 2, 20.0, 5.0, 30)],
                              "campaign_id string, campaign_name string, flag_program string, "
                              "total_leads long, total_take_up long, take_up_rate double, "
                              "total_transaction_value double, duration_days int")
    out = {r.campaign_id: r for r in compare.compare_campaigns(m, ["A", "ZZ"]).collect()}
    assert out["ZZ"].total_leads == 0 and out["ZZ"].campaign_name == ""
    many = [f"X{i}" for i in range(8)] + ["A", "A"]
    assert compare.compare_campaigns(m, many).count() == 9          # any number of ids, each once
    with pytest.raises(ValueError):
        compare.sort_by_attribute(m, "wilayah")


def test_best_worst_segment_strict(spark):
    br = spark.createDataFrame(
        [("c", "segment_by_aum", "B", 10, 0, 0.0), ("c", "segment_by_aum", "A", 10, 5, 50.0),
         ("c", "segment_by_aum", "C", 10, 5, 50.0), ("c", "segment_by_aum", "D", 4, 4, 100.0)],
        "campaign_id string, breakdown string, label string, leads long, take_up long, take_up_rate double")
    r = recommend.best_worst_segment(br).first()
    assert (r.best_segment, r.best_segment_rate) == ("D", 100.0)
    assert (r.worst_segment, r.worst_segment_rate) == ("B", 0.0)


# ------------------------------------------------------------ similarity: exact top-k

def brute_force(dims, k, required=()):
    """All pairs in Python: the definition the index must reproduce."""
    out = {}
    for a, b in itertools.permutations(dims, 2):
        match = [d for d in similarity.DIMS
                 if a[d] is not None and b[d] is not None and a[d] == b[d]]
        if not match or not set(required) <= set(match):
            continue
        out.setdefault(a["campaign_id"], []).append((-len(match), -b["take_up_rate"], b["campaign_id"]))
    return {cid: [x[2] for x in sorted(v)[:k]] for cid, v in out.items()}


def dim_df(spark, dims):
    return spark.createDataFrame(
        [(d["campaign_id"], d["campaign_id"], d["flag_program"], d["jenis_leads"],
          d["media_blasting"], d["take_up_rate"], 10, 1) for d in dims],
        "campaign_id string, nama_program string, flag_program string, jenis_leads string, "
        "media_blasting string, take_up_rate double, total_leads long, total_take_up long")


def random_dims(seed, n):
    rnd = random.Random(seed)
    pick = lambda vals: rnd.choice(vals)
    return [{"campaign_id": f"C{i:03d}",
             "flag_program": pick(["H1", "H1", "H1", "H2", None]),       # skewed + nulls
             "jenis_leads": pick(["Y1", "Y2", "Y3"]),
             "media_blasting": pick(["WA", "SMS", "EMAIL", None]),
             "take_up_rate": float(rnd.randint(0, 8) * 12.5)}             # many ties
            for i in range(n)]


@settings(max_examples=6, deadline=None)
@given(seed=st.integers(0, 10_000), n=st.integers(2, 40), k=st.integers(1, 50),
       required=st.sampled_from([(), ("media_blasting",), ("flag_program", "jenis_leads")]))
def test_similar_topk_equals_brute_force(spark, seed, n, k, required):
    dims = random_dims(seed, n)
    got = {}
    for r in similarity.similar_topk(dim_df(spark, dims), k, list(required) or None).collect():
        got.setdefault(r.campaign_id, []).append((r["rank"], r.similar_campaign_id))
    got = {c: [x[1] for x in sorted(v)] for c, v in got.items()}
    assert got == brute_force(dims, k, required)


def test_similarity_counts_and_limits(spark):
    dims = random_dims(7, 30)
    counts = {}
    for r in similarity.similarity_counts(dim_df(spark, dims)).collect():
        counts[r.campaign_id] = counts.get(r.campaign_id, 0) + r.similar_campaigns
    full = brute_force(dims, 10 ** 6)
    assert counts == {c: len(v) for c, v in full.items()}
    with pytest.raises(ValueError):
        similarity.similar_topk(dim_df(spark, dims), 0)
    with pytest.raises(ValueError):
        similarity.similar_candidates(dim_df(spark, dims), 5, ["region"])


def enriched_df(spark, rows):
    return spark.createDataFrame(
        rows, "campaign_id string, media_blasting string, segment_by_aum string, wilayah int, "
              "take_up_flag string, time_to_take_up_days int")


def test_campaign_picks_regions_and_segments(spark):
    rows = ([("c", "WA", "MASS", 1, "YES", 3)] * 3 + [("c", "WA", "MASS", 1, "NO", None)]      # r1 75 %
            + [("c", "WA", "EMERALD", 2, "YES", 5)] + [("c", "WA", "EMERALD", 2, "NO", None)] * 3  # r2 25 %
            + [("c", "WA", "EMERALD", 3, "NO", None)] * 2                                        # r3 0 %
            + [("c", "WA", "EMERALD", 4, "YES", 9)]                                              # 1 lead
            + [("d", "SMS", "MASS", 5, "NO", None)])
    got = {r.campaign_id: r for r in recommend.campaign_picks(enriched_df(spark, rows)).collect()}
    c = got["c"]
    assert c.take_up_rate == 45.45 and c.avg_days == 4.6          # 5 of 11; days 3,3,3,5,9
    assert (c.best_region, c.best_region_rate) == (1, 75.0)       # region 4 has one lead only
    assert c.low_regions == "3"                                   # below half of 45.45
    assert (c.best_segment, c.worst_segment) == ("MASS", "EMERALD")
    d = got["d"]
    assert d.take_up_rate == 0.0 and d.avg_days is None
    assert d.best_region is None and d.low_regions is None and d.best_segment is None
    assert d.worst_segment == "MASS"
    regions = {r.campaign_id for r in recommend.best_and_low_regions(enriched_df(spark, rows)).collect()}
    assert regions == {"c"}


def test_recommendation_facts_one_pass_over_leads(spark):
    rows = [("C%03d" % i, "WA", "MASS", i % 3 + 1, "YES" if i % 2 else "NO", i % 7)
            for i in range(8)]
    facts = recommend.recommendation_facts(enriched_df(spark, rows), dim_df(spark, random_dims(3, 8)))
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand [") == 1       # one grouping-sets aggregation, no self-join copies
    assert facts.count() == 8


def test_learning_summary_top_result_and_empty(spark):
    dims = [
        {"campaign_id": "A", "flag_program": "H1", "jenis_leads": "Y1", "media_blasting": "WA",
         "take_up_rate": 10.0},
        # shares all three with A, lower rate: still A's top (dimension count first)
        {"campaign_id": "B", "flag_program": "H1", "jenis_leads": "Y1", "media_blasting": "WA",
         "take_up_rate": 18.75},
        # shares two with A, higher rate
        {"campaign_id": "C", "flag_program": "H1", "jenis_leads": "Y1", "media_blasting": "SMS",
         "take_up_rate": 66.666666666},
        # shares nothing with anyone
        {"campaign_id": "D", "flag_program": "H2", "jenis_leads": "Y9", "media_blasting": None,
         "take_up_rate": 5.0},
    ]
    got = {r.campaign_id: r for r in similarity.learning_summary(dim_df(spark, dims)).collect()}
    assert got["A"].top_similar_campaign_id == "B"
    assert got["A"].take_up_rate_formatted == "18.75%"
    assert (got["A"].top_segment, got["A"].top_region, got["A"].message) == ("N/A", "N/A", None)
    assert got["B"].top_similar_campaign_id == "A" and got["B"].take_up_rate_formatted == "10.00%"
    assert got["C"].top_similar_campaign_id == "B"       # two shared dims each, B has the higher rate
    assert got["D"].top_similar_campaign_id is None and got["D"].take_up_rate_formatted is None
    assert got["D"].message.startswith("Tidak ada campaign serupa")
    # a required dimension nobody shares with C leaves C without a summary
    req = {r.campaign_id: r for r in
           similarity.learning_summary(dim_df(spark, dims), ["media_blasting"]).collect()}
    assert req["C"].top_similar_campaign_id is None and req["A"].top_similar_campaign_id == "B"
    half = [dict(dims[0]), dict(dims[1], take_up_rate=66.666666666)]
    rows = similarity.learning_summary(dim_df(spark, half)).collect()
    assert {r.take_up_rate_formatted for r in rows} == {"66.67%", "10.00%"}


def test_similarity_plan_has_no_pair_join(spark):
    plan = similarity.similarity_index(dim_df(spark, random_dims(1, 10)))._jdf \
        .queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


# ------------------------------------------------------------ campaigns with several channels and programs

def many_channel_leads(spark):
    rows = [("X", "NX", "P1", "J", c, 1, D(2024, 1, 1), 2024, 1, f, 2.0, 5)
            for c, f in (("WA", "YES"), ("WA", "NO"), ("SMS", "NO"), ("EMAIL", "YES"))]
    rows += [("X", "NX", "P2", "J", "WA", 2, D(2024, 1, 1), 2024, 1, "NO", None, None),
             ("Y", "NY", "P1", "J", "WA", 1, D(2024, 1, 1), 2024, 1, "NO", None, None)]
    return spark.createDataFrame(
        rows, "campaign_id string, nama_program string, flag_program string, jenis_leads string, media_blasting string, "
              "wilayah int, periode_start date, year int, month int, take_up_flag string, total_transaction_value double, "
              "time_to_take_up_days int")


def test_one_row_per_campaign_everywhere(spark):
    leads = many_channel_leads(spark)
    dim = rollups.campaign_dim(rollups.campaign_master(leads))
    got = {r.campaign_id: r for r in dim.collect()}
    assert dim.count() == 2 and (got["X"].total_leads, got["X"].total_take_up) == (5, 2)
    assert (got["X"].media_blasting, got["X"].flag_program) == ("WA", "P1")      # the combination with most leads
    metrics = compare.campaign_metrics(leads)
    assert sorted((r.campaign_id, r.total_leads, r.flag_program) for r in metrics.collect()) == [("X", 5, "P1"), ("Y", 1, "P1")]
    rates = recommend.campaign_rates(leads)
    assert {r.campaign_id: r.total_leads for r in rates.collect()} == {"X": 5, "Y": 1} and rates.count() == 2
    chans = {r.campaign_id: r.suggested_channels for r in recommend.unused_channels(rates).collect()}
    assert chans == {"X": "digisales,telesales", "Y": "digisales,telesales"}
    top = similarity.similar_topk(dim, 2).collect()
    assert sorted((r.campaign_id, r.similar_campaign_id) for r in top) == [("X", "Y"), ("Y", "X")]


def test_requested_campaigns_reach_the_scan(spark):
    out = compare.compare_requested(many_channel_leads(spark), None, ["X", "ZZ"])
    assert sorted((r.campaign_id, r.total_leads) for r in out.collect()) == [("X", 5), ("ZZ", 0)]


def test_rollups_collapse_and_keep_eight_weeks(spark):
    weeks = [(f"2024-0{1 + i // 4}-{1 + 7 * (i % 4):02d}", i) for i in range(12)]
    weekly = spark.createDataFrame([("C", 1, D.fromisoformat(w), 10, i % 3, 0.0, 1.0 * i) for w, i in weeks],
                                   "campaign_id string, region int, week_start date, leads_count long, take_up_count long, "
                                   "take_up_rate double, avg_transaction_value double")
    last = rollups.regional_trend_8w(weekly).collect()
    assert sorted(r.week_start for r in last) == [D.fromisoformat(w) for w, _ in weeks[4:]]
    one = rollups.regional_summary(weekly).collect()
    assert len(one) == 1 and (one[0].leads_count, one[0].take_up_count) == (120, 12)
    leads = many_channel_leads(spark)
    agg = rollups.overview_agg(rollups.campaign_master(leads))
    wa = [r for r in agg.collect() if r["product"] == "P1" and r.channel == "WA" and r.region == "1"]
    assert len(wa) == 1 and (wa[0].campaign_count, wa[0].total_leads) == (2, 3)   # two campaigns in one group


def test_filters_reach_the_scan(spark):
    from leadflow.operators import filters
    from leadflow.session import scratch_path
    path = scratch_path(spark, "t-push")
    spark.range(10).selectExpr("cast(id as int) AS wilayah", "date'2024-01-01' AS start_date", "'a' AS cabang").write.parquet(path)
    df = spark.read.parquet(path)
    plan = lambda f: filters.filter_active(df, f)._jdf.queryExecution().executedPlan().toString()
    assert "In(wilayah" in plan([("wilayah", ["3", 4])]) and filters.filter_active(df, [("wilayah", ["3", 4])]).count() == 2
    assert "start_date" in plan([("period", ["2024-01-01"])]).split("PushedFilters")[1]
    assert filters.filter_active(df, [("wilayah", ["03"])]).count() == 0          # text comparison, as before
