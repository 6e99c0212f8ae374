import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from leadflow.session import get_session
    s = get_session(master="local[4]", shuffle_partitions=8, app_name="leadflow-tests",
                    extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="leadflow-test-ckpt-")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in ["orders", "customer", "lineitem", "events", "part", "supplier", "nation", "region"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con
