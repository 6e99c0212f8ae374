"""The product's property invariants, checked on the real (sf0.001) outputs
of the registered queries."""

from collections import defaultdict

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def q(spark):
    cache = {}

    def run(name):
        if name not in cache:
            cache[name] = E.queries()[name](spark, SF_SMALL).collect()
        return cache[name]
    return run


def test_histogram_has_seven_bins_and_counts_add_up(q):
    per = defaultdict(list)
    for r in q("time_histogram"):
        per[r.campaign_id].append(r)
    stats = {r.campaign_id: r for r in q("time_stats")}
    assert per and set(per) == set(stats)
    for cid, bins in per.items():
        assert sorted(b.bin_index for b in bins) == list(range(7))
        # days are never negative in this binding, so every value is in a bin
        assert sum(b["count"] for b in bins) == stats[cid].total_take_up


def test_stats_ordered(q):
    for r in q("time_stats"):
        assert r.max_days >= r.min_days >= 0
        assert r.min_days <= r.median_days <= r.max_days
        assert r.min_days <= r.mean_days <= r.max_days


def test_shares_sum_to_100(q):
    tot = defaultdict(float)
    for r in q("criteria_distribution"):
        tot[(r.campaign_id, r.attribute)] += r.percentage
    assert tot and all(abs(v - 100.0) < 0.01 for v in tot.values())


def test_regions_ranked_by_rate(q):
    per = defaultdict(list)
    for r in q("regional_ranked"):
        per[r.campaign_id].append(r)
    for rows in per.values():
        rows.sort(key=lambda r: r.region_rank)
        rates = [r.take_up_rate for r in rows]
        assert rates == sorted(rates, reverse=True)
        assert [r.region_rank for r in rows] == list(range(1, len(rows) + 1))


def test_similar_order_and_length(q):
    per = defaultdict(list)
    for r in q("similar_topk"):
        per[r.campaign_id].append(r)
    assert per
    for rows in per.values():
        assert len(rows) <= 5
        rows.sort(key=lambda r: r["rank"])
        keys = [(-r.dimension_count, -r.take_up_rate, r.similar_campaign_id) for r in rows]
        assert keys == sorted(keys)
        assert all(r.similar_campaign_id != r.campaign_id for r in rows)


def test_similar_by_dimensions_superset(q):
    assert all("media_blasting" in r.matching_dimensions.split(",") for r in q("similar_by_dimensions"))


@pytest.mark.parametrize("name", ["overview_agg", "regional_weekly", "regional_from_leads",
                                  "time_stats", "time_histogram", "criteria_distribution",
                                  "compare_campaigns", "similarity_index", "recommendation_facts",
                                  "strip_pii"])
def test_no_customer_id_in_reports(spark, name):
    assert "cif" not in E.queries()[name](spark, SF_SMALL).columns


def test_trend_ascending_and_unique(q):
    rows = q("overview_trend_filtered")
    keys = [(r.period_start, r.period_end) for r in rows]
    assert len(keys) == len(set(keys))


def test_facet_filters_are_and(q):
    for r in q("filter_leads_facets"):
        assert r.flag_program == "PROGRAM H1" and r.media_blasting in ("URGENT", "HIGH")
        assert 1 <= r.wilayah <= 8


def test_totals_agree(q):
    t = q("overview_totals")[0]
    a = q("overview_totals_from_agg")[0]
    assert (t.total_leads, t.total_take_up) == (a.total_leads, a.total_take_up)
    assert a.campaign_group_count >= t.total_campaigns
