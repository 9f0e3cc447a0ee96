"""Queries with SQL oracles, on the smallest scale; duplicates are in other tests."""
import pytest

from tests.conftest import SF_SMALL
from tests.test_oracles import _norm

NAMES = ["op3_mix_sources", "op6_url_filter", "op8_warc_archive", "op9_host_quality", "op12_prefix_trie", "op13_orchard_codes"]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    from pkgsieve.llm.queries import ORACLES, QUERIES

    df = QUERIES[name](spark, SF_SMALL)
    cur = duck(SF_SMALL).execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert _norm([tuple(r) for r in df.collect()], df.columns) == _norm(cur.fetchall(), cols)
