"""What the one-pass split spends on a row, and that the cheaper forms give the same."""

import glob
import threading
from datetime import date as D
from types import SimpleNamespace

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from leadflow.functions.domains import DATE_FORMATS
from leadflow.functions.exprs import campaign_slug, parse_mixed_date
from leadflow.operators import clean
from leadflow.plans import pipeline, registry
from leadflow.session import scratch_path
from leadflow.sources import io
from tests.test_clean import df_of, lead, mon


def as_text(df):
    return df.select(*[F.col(c).cast("string") for c in df.columns])


def paths(root):
    return pipeline.Paths(raw_leads=f"{root}/leads", raw_monitoring=f"{root}/mon", enriched=f"{root}/clean", campaigns=f"{root}/campaigns",
                          overview=f"{root}/o", regional=f"{root}/r", similarity=f"{root}/s")


def test_each_date_is_parsed_once(spark):
    p = paths(scratch_path(spark, "t-cost"))
    io.write_csv(as_text(df_of(spark, [lead("1")], io.LEADS_SCHEMA)), p.raw_leads)
    io.write_csv(as_text(df_of(spark, [mon("1")], io.MONITORING_SCHEMA)), p.raw_monitoring)
    out = clean.split_by_status(io.read_raw(spark, p.raw_leads, io.LEADS_SCHEMA), io.read_raw(spark, p.raw_monitoring, io.MONITORING_SCHEMA),
                                (io.malformed(io.LEADS_SCHEMA), io.malformed(io.MONITORING_SCHEMA)), clean.EtlWatch())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # a lead's start, an outcome's start and its take-up date, each by the five formats
    assert plan.count("gettimestamp(") == 3 * len(DATE_FORMATS)


def test_text_with_separators_but_no_digits_is_no_date(spark):
    near = ["2024-01-0x", "+123-01-01", "-123-01-01", "01/01/+123", "1 /01/2024", "2024-+1-01", "2024-01-01T", "2024-1-01", "12024-01-01",
            "2023-02-29", "13/13/2024", "２０２４-01-01", "\t2024-01-01", "é024-01-01", "  ", None]
    df = spark.createDataFrame([(t,) for t in [*near, " 2024-02-29 ", "12/31/2024"]], "s string")
    got = [r[0] for r in df.select(parse_mixed_date("s")).collect()]
    assert got == [None] * len(near) + [D(2024, 2, 29), D(2024, 12, 31)]


def test_slug_of_odd_names_and_dates(spark):
    names = ["1-URGENT", "4-NOT  SPECIFIED", " a\t\n b ", "é+x", "+", "", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(campaign_slug("n", F.lit("2024-01-05").cast("date"))).collect()]
    assert got == ["1-URGENT_2024-01-05", "4-NOT_SPECIFIED_2024-01-05", "_a_b__2024-01-05", "x_2024-01-05", "_2024-01-05", "_2024-01-05", None]
    year = df.limit(1).select(campaign_slug("n", F.expr("date'12024-01-05'")), campaign_slug("n", F.lit(None).cast("date"))).first()
    assert tuple(year) == ("1-URGENT_12024-01-05", None)


def test_columns_that_do_not_repeat_try_no_dictionary(spark):
    p = paths(scratch_path(spark, "t-dict"))
    rows = as_text(df_of(spark, [lead("7")] * 50, io.LEADS_SCHEMA)).withColumn("wilayah", F.lit("north"))
    io.write_csv(rows.coalesce(1), p.raw_leads)
    io.write_csv(as_text(df_of(spark, [mon("1")], io.MONITORING_SCHEMA)), p.raw_monitoring)
    pipeline.split_raw(spark, p)
    meta = pq.ParquetFile(glob.glob(f"{p.enriched}/status=malformed/*/*.parquet")[0]).metadata.row_group(0)
    tried = {c.path_in_schema: c.has_dictionary_page for c in (meta.column(i) for i in range(meta.num_columns))}
    assert not tried["cif"] and not tried["raw_line"] and tried["nama_program"]


def test_both_drops_are_written_at_the_same_time(spark, monkeypatch):
    together, write = threading.Barrier(2, timeout=60), io.write_csv

    def meet(df, path):
        together.wait()
        write(df, path)
    monkeypatch.setattr(io, "write_csv", meet)
    leads = df_of(spark, [lead("1"), lead("2")], io.LEADS_SCHEMA).withColumn("_src_orderkey", F.lit(1))
    p = registry._dirty_drop(SimpleNamespace(spark=spark, leads_raw=leads, monitoring_raw=df_of(spark, [mon("1")], io.MONITORING_SCHEMA)))
    assert (io.read_leads(spark, p.raw_leads).count(), io.read_monitoring(spark, p.raw_monitoring).count()) == (2, 1)
