import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from strata.session import get_session

    # tests run without a cluster: give them their own checkpoint folder
    ck = tempfile.mkdtemp(prefix="strata-test-ckpt-")
    wh = tempfile.mkdtemp(prefix="strata-test-warehouse-")
    s = get_session("local[4]", shuffle_partitions=4, app_name="strata-tests",
                    extra={"spark.checkpoint.dir": ck, "spark.sql.warehouse.dir": wh})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    from strata.sources import DRIVER_TABLES

    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    return con
