"""Tables of a scan: dealt by file, joined in place, never broadcast; steps run when asked for."""
import re

import pytest

from pkgsieve.operators.common import checkpoint_cut, joined_in_place
from pkgsieve.plans import QUERIES
from pkgsieve.taint import arrivals, engine, reach, scanner
from pkgsieve.taint.scanner import TEMPLATES, file_metrics, scan_corpus


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, f"pkg{i % 3}", f"/p/{i}.py", TEMPLATES[i % len(TEMPLATES)]) for i in range(60)]
    return spark.createDataFrame(rows, "file_id long, package string, path string, content string")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_of_a_scan_are_joined_in_place(spark, corpus):
    res = scan_corpus(corpus)
    pairs = [(res.name_info, res.facts.nodes), (res.facts.calls, res.facts.nodes), (res.call_names, res.name_info)]
    for a, b in pairs:
        with joined_in_place(spark):
            plan = _plan(a.select("file_id", "seq", "ns" if "ns" in a.columns else "name").join(b.select("file_id", "seq"), ["file_id", "seq"]))
        assert "SortMergeJoin" in plan and "Broadcast" not in plan and "Exchange" not in plan
    assert "BroadcastHashJoin" not in _plan(file_metrics(res).select("file_id", "lines"))
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("pkgsieve_")]


def test_bucketed_table_holds_all_rows_and_settings_stay(spark):
    keys = ["spark.sql.maxConcurrentOutputFileWriters", "spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.hive.manageFilesourcePartitions"]
    before = [spark.conf.get(k) for k in keys]
    rows = spark.range(1000).selectExpr("id div 10 as file_id", "cast(id as int) seq", "cast(id % 5 as string) kind", "nullif(id % 7, 0) v")
    for kind in (None, "kind"):
        out = checkpoint_cut(rows, by=kind, bucket="file_id")
        assert not out.select(*rows.columns).exceptAll(rows).count() and out.count() == 1000
    assert [spark.conf.get(k) for k in keys] == before


def test_only_the_steps_asked_for_run(corpus, monkeypatch):
    monkeypatch.setattr(scanner, "resolve", lambda *a: pytest.fail("resolved for nothing"))
    res = scan_corpus(corpus)
    assert res.facts.imports.where("file_id = 4").count() == 2
    assert res.name_info.where("file_id = 2 and name = 'a'").first().rec_ns == ""


def test_lines_are_counted_below_the_joins(corpus):
    plan = _plan(file_metrics(scan_corpus(corpus)))
    exchanged = [line for line in plan.splitlines() if "SortMergeJoin" in line or "BroadcastHashJoin" in line]
    first_join = plan.index(exchanged[-1])
    assert "content" not in plan[:first_join]


def test_stations_are_kept_where_a_taint_begins_or_is_read(corpus):
    nodes = scan_corpus(corpus).facts.nodes.where("size(up) > 0")
    kinds = {(r.ntype, r.ctx) for r in nodes.select("ntype", "ctx").distinct().collect()}
    assert ("Name", "Load") in kinds and not [k for k in kinds if k[1] != "Load" and k[0] not in ("Call", "Constant")]


def test_a_round_of_imports_joins_no_names(corpus, monkeypatch):
    plans = []
    monkeypatch.setattr(engine, "checkpoint_cut", lambda df, **k: plans.append((df.columns, _plan(df))) or checkpoint_cut(df, **k))
    calls = scan_corpus(corpus).call_names
    rounds = [plan for columns, plan in plans if columns == ["file_id", "seq", "dyn"]]
    assert len(rounds) == 2 and max(p.count("SortMergeJoin") for p in rounds) <= 3
    assert {r.func for r in calls.where("file_id = 14").collect()} == {"importlib.import_module", "os.system", "os.path.exists"}


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("docs"))
    spark.range(40).selectExpr("id as doc_id", "concat('line ', id) as text").write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.fixture
def written(monkeypatch):
    """The columns and plans of the tables that a scan writes."""
    out = []
    for module in (arrivals, engine, reach, scanner):
        monkeypatch.setattr(module, "checkpoint_cut", lambda df, *a, **k: out.append((df.columns, _plan(df))) or checkpoint_cut(df, *a, **k))
    return out


@pytest.mark.parametrize("query", ["resolved_calls", "scan_report"])
def test_rules_alone_are_broadcast(spark, documents, written, query):
    """what is broadcast is built in the driver, so no table of a scan is."""
    last = QUERIES[query](spark, documents)
    plans = [plan for _, plan in written] + [_plan(last)]
    assert len(plans) > 8 and sum(p.count("SortMergeJoin") for p in plans) > 8
    for plan in plans:
        lines = plan.splitlines()
        for at in [i for i, line in enumerate(lines) if "BroadcastExchange" in line]:
            depth = re.search(r"\w", lines[at]).start()
            below = []
            for line in lines[at + 1:]:
                if re.search(r"\w", line).start() <= depth:
                    break
                below.append(line)
            assert below and "LocalTableScan" in below[-1] and not any("FileScan" in x for x in below), plan


def test_imports_write_the_facts_alone(spark, documents, written):
    """the imports of the files need the facts, dealt once, and no other table."""
    rows = QUERIES["import_bindings"](spark, documents)
    assert [("kind" in columns, plan.count("Exchange")) for columns, plan in written] == [(True, 1)]
    assert "Exchange" not in _plan(rows) and "Join" not in _plan(rows)
    assert rows.where("doc_id = 24").count() == 2
