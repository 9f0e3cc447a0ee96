"""The feed state queries with a small serial-block width (many blocks per
key and for the global W1 order) still equal their oracles."""
import pytest

from tests.conftest import SF_SMALL
from tests.test_oracles import _norm


@pytest.mark.parametrize("name", ["refresh_triggers", "project_incarnations", "release_state", "project_roles"])
def test_small_blocks_match_oracle(spark, duck, name):
    from __spark_entry__ import oracle_sql, queries
    from pkgsieve.plans.changelog import FEED_BLOCK_CONF

    spark.conf.set(FEED_BLOCK_CONF, "500")
    try:
        df = queries()[name](spark, SF_SMALL)
        got = [tuple(r) for r in df.collect()]
    finally:
        spark.conf.unset(FEED_BLOCK_CONF)
    cur = duck(SF_SMALL).execute(oracle_sql()[name])
    exp = cur.fetchall()
    assert _norm(got, df.columns) == _norm(exp, [d[0] for d in cur.description])
