"""Fact rows: columns per kind, files that share a batch, few and bounded batches; copies followed in one pass."""
import pyarrow as pa

from pkgsieve.operators.common import checkpoint_cut
from pkgsieve.taint import engine, facts


def _batches(files):
    given = pa.RecordBatch.from_arrays([pa.array(list(files), pa.int64()), pa.array(list(files.values()), pa.string())], names=["file_id", "content"])
    return list(facts._extract_batches([given]))


def test_small_files_share_batches():
    files = {i: f"a = {i}\npass\nf(a.b, c=a)" for i in range(300)}
    found = _batches({**files, 300: "def f(:"})
    assert len(found) < 40 and all(b.num_rows <= facts.ROWS_PER_BATCH for b in found)
    rows = [r for b in found for r in b.to_pylist()]
    mine = [{k: v for k, v in r.items() if v is not None} for r in rows if r["file_id"] == 7]
    assign = next(r for r in mine if r["kind"] == "assign")
    assert assign == {"file_id": 7, "kind": "assign", "seq": 1, "ns": "", "name": "a", "keyword": "name", "ref_type": "Constant", "ref_seq": 4}
    skip = next(r for r in mine if r.get("ntype") == "Pass")
    assert (skip["seq"], skip["lineno"], skip["end_col"], skip["end_seq"], skip["up"]) == (5, 2, 4, 5, [])
    args = [(r.get("pos"), r.get("keyword"), r["ref_type"]) for r in mine if r["kind"] == "arg"]
    assert args == [(0, None, "Attribute"), (None, "c", "Name")]
    read = next(r for r in mine if r["kind"] == "node" and r["seq"] == 11)
    assert read["ntype"] == "Name" and read["up"] == [{"seq": 10, "lines": [3]}]
    assert [r["name"] for r in rows if r["kind"] == "error"] == ["SyntaxError"]


def test_large_file_fills_several_batches():
    found = _batches({1: "x = y\n" * 9000})
    assert max(b.num_rows for b in found) == facts.ROWS_PER_BATCH and sum(b.num_rows for b in found) == 1 + 8 * 9000


def test_files_are_walked_with_the_collector_off(monkeypatch):
    import gc

    seen, parse = [], facts.ast.parse
    monkeypatch.setattr(facts.ast, "parse", lambda text: seen.append(gc.isenabled()) or parse(text))
    rows = [r for b in _batches({1: "f(a)", 2: "f(:"}) for r in b.to_pylist()]
    assert seen == [False, False] and gc.isenabled()
    names = [(r["seq"], r["parent"], r["ntype"], r["ctx"], r["end_seq"], r["up"]) for r in rows if r["kind"] == "node" and r["seq"] > 2]
    assert names == [(3, 2, "Name", "Load", 4, []), (4, 3, "Load", None, 4, []), (5, 2, "Name", "Load", 6, []),
                     (6, 5, "Load", None, 6, [{"seq": 5, "lines": []}])]


def test_facts_are_written_without_a_sort(spark, tmp_path):
    seen = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    out = checkpoint_cut(spark.range(1000).selectExpr("id", "cast(id % 5 as string) as kind"), by="kind")
    assert out.where("kind = '3'").count() == 200 and out.count() == 1000
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == seen


def test_copies_take_no_rounds(spark, monkeypatch):
    rows = [(1, "", f"v{i}", i, i, "Name", "k" if i == 0 else None, "m" if i == 0 else None, *(("", f"v{i - 1}", i - 1) if i else (None,) * 3),
             None, None) for i in range(500)]
    rows += [(2, "", "a", 1, 1, "Attribute", None, None, "", "p", 0, "t", "p"), (2, "", "b", 2, 2, "Attribute", None, None, "", "a", 1, "u", "a")]
    links = spark.createDataFrame(rows, engine.RECORDS + ", p_ns string, p_name string, p_seq int, tail string, fallback string")
    written = []
    monkeypatch.setattr(engine, "checkpoint_cut", lambda df, **k: written.append(1) or checkpoint_cut(df, **k))
    got = {(r.file_id, r.name): (r.value, r.variable) for r in engine._follow(links).collect()}
    assert got[1, "v499"] == ("k", "m") and got[2, "b"] == (None, "p.t.u") and len(got) == 502 and len(written) == 1


def test_rules_are_local_rows(spark):
    from pkgsieve.sources.rules import PAIR_SCHEMA, SPEC_SCHEMA, catalogue, load_rule_docs, rule_tables

    cat = catalogue(load_rule_docs())
    specs, pairs = rule_tables(spark)
    for df, rows, schema in ((specs, cat.specs, SPEC_SCHEMA), (pairs, cat.pairs, PAIR_SCHEMA), (rule_tables(spark, rules={})[0], [], SPEC_SCHEMA)):
        assert [tuple(r) for r in df.collect()] == rows and df.schema == schema
        assert "LocalTableScan" in df._jdf.queryExecution().executedPlan().toString()
