"""Stored tables follow the tables they were built from."""

import shutil

import pyarrow.parquet as pq

import __spark_entry__ as E
from tests.conftest import SF_SMALL


def test_changed_inputs_are_read_anew(spark, tmp_path):
    for t in ("orders", "customer", "lineitem", "events"):
        shutil.copyfile(f"{SF_SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")
    q = E.queries()
    first = q["overview_totals"](spark, str(tmp_path)).first()
    stats = q["time_stats"](spark, str(tmp_path)).count()
    assert q["overview_totals"](spark, str(tmp_path)).first() == first
    orders = pq.read_table(f"{SF_SMALL}/orders.parquet")
    pq.write_table(orders.slice(0, orders.num_rows // 2), tmp_path / "orders.parquet")
    again = q["overview_totals"](spark, str(tmp_path)).first()
    assert 0 < again.total_leads < first.total_leads
    assert q["time_stats"](spark, str(tmp_path)).count() < stats
