"""Registered queries vs their DuckDB oracles on the smallest scale."""
import math

import pytest

from tests.conftest import SF_SMALL

FAST = ["project_suspicion", "signal_levenshtein", "signal_swap", "signal_import_hijack", "action_parse",
        "changelog_enriched", "refresh_triggers", "project_incarnations", "release_state", "project_roles",
        "project_merge", "feed_name_reuse", "incremental_scan", "latest_serial", "version_parse", "snapshot_stale",
        "latest_popular", "scan_dispatch", "json_metadata", "simple_json", "html_anchor_text", "html_li_text",
        "content_router", "html_release_versions", "popular_rows", "known_bad_links", "download_tasks",
        "download_top", "analysis_queue", "pending_downloads", "pending_analysis", "insert_ignore",
        "upsert_results", "upsert_private", "release_analyzed", "file_selection", "file_selection_rules",
        "effective_lines", "import_names", "alias_build", "archive_members", "word_typosquat", "issues", "resolved_calls", "taint_reach", "name_bindings", "def_use", "taint_sources", "sink_calls",
        "sink_args", "arg_taints", "import_bindings", "code_facts", "alerts", "scan_report", "project_metadata", "release_urls",
        "simple_files", "project_document", "release_document", "metadata_merge", "lookup_keyed", "known_bad_join",
        "project_remove_time", "html_elements", "download_order", "analysis_order", "severity_histogram", "lookup_pruned",
        "file_metrics", "package_metrics", "behaviour_order"]


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def n(v):
        return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v

    return sorted((tuple(n(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module", autouse=True)
def one_scan():
    """The scan queries each scan the corpus; here they share one scan."""
    from pkgsieve.plans import taint

    scan, held = taint.scanned, {}
    taint.scanned = lambda spark, sf: held.setdefault(sf, None) or held.__setitem__(sf, scan(spark, sf)) or held[sf]
    yield
    taint.scanned = scan


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    from __spark_entry__ import oracle_sql, queries

    df = queries()[name](spark, SF_SMALL)
    got = [tuple(r) for r in df.collect()]
    cur = duck(SF_SMALL).execute(oracle_sql()[name])
    exp = cur.fetchall()
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert _norm(got, df.columns) == _norm(exp, cols)


def test_entry_smoke(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"c_custkey", "project", "suspicion", "n_signals", "suspicion_info"}


def test_every_query_of_the_library_has_an_oracle():
    from __spark_entry__ import oracle_sql, queries
    from pkgsieve import plans

    assert set(oracle_sql()) <= set(queries())
    assert set(plans.ORACLES) == set(plans.QUERIES)
