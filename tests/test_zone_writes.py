"""Partitioned tables: written without a shuffle where the rows lie by campaign, and without a sort."""

import pytest
from pyspark.sql import functions as F

from leadflow.plans import views
from leadflow.session import scratch_path
from leadflow.sources import io
from tests.conftest import SF_SMALL

CONF = "spark.sql.maxConcurrentOutputFileWriters"


@pytest.fixture
def hints(spark, monkeypatch):
    """The hints given while a test runs."""
    kind, seen = type(spark.range(1)), []
    given = kind.hint
    monkeypatch.setattr(kind, "hint", lambda self, name, *by: (seen.append((name, *by)), given(self, name, *by))[1])
    return seen


def leads(spark, campaigns, n=2_000):
    return spark.range(n).select(F.format_string("C%03d", F.col("id") % campaigns).alias("campaign_id"), F.col("id").cast("string").alias("cif"),
                                 F.when(F.col("id") % 3 == 0, "YES").otherwise("NO").alias("take_up_flag"))


def rows(df):
    return sorted((r.campaign_id, r.cif, r.take_up_flag) for r in df.collect())


def test_clustered_leads_are_not_shuffled_again(spark, hints):
    zone, flat, path = scratch_path(spark, "t-zone"), scratch_path(spark, "t-flat"), scratch_path(spark, "t-by-campaign")
    df = leads(spark, 40)
    io.write_clustered(df, zone, ["campaign_id", "cif"])
    io.write_leads_partitioned(spark.read.parquet(zone), path, clustered=True)
    assert not hints
    io.write_leads_partitioned(df, flat)
    assert hints == [("rebalance", "campaign_id")]
    assert rows(io.read_enriched_leads(spark, path)) == rows(df) == rows(io.read_enriched_leads(spark, flat))
    assert len([c for c in io.children(spark, path) if c.startswith("campaign_id=")]) == 40


def test_the_session_zone_holds_the_stored_leads(spark, hints):
    v = views.Views(spark, SF_SMALL)
    key = (spark.sparkContext.applicationId, f"{SF_SMALL}|leads_zone")
    views._STORED.pop(key, None)
    names = ["campaign_id", "cif", "take_up_flag"]
    assert rows(io.read_enriched_leads(spark, v.leads_zone).select(*names)) == rows(v.enriched.select(*names))
    assert not hints


@pytest.mark.parametrize("most", [3, 64])
def test_more_folders_than_open_files(spark, monkeypatch, most):
    monkeypatch.setattr(io, "OPEN_FILES", most)
    old, asked, path = spark.conf.get(CONF), [], scratch_path(spark, "t-open")
    put = type(spark.conf).set
    monkeypatch.setattr(type(spark.conf), "set", lambda self, k, x: (asked.append((k, x)), put(self, k, x))[1])
    df = leads(spark, 50).coalesce(1)
    io.write_partitioned(df, path, ["take_up_flag", "campaign_id"])
    assert (CONF, most) in asked and spark.conf.get(CONF) == old
    assert rows(spark.read.parquet(path)) == rows(df)
