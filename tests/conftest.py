import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pkgsieve.session import local_session

    s = local_session("4", app="pkgsieve-tests", **{"spark.sql.shuffle.partitions": "8"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    from pkgsieve import tables as T

    def make(sf):
        con = duckdb.connect()
        for t in T.BASE_TABLES:
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        return con

    return make
