"""Keyed tables: same rows as rewriting everything, files of untouched keys left alone."""
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from pkgsieve.operators import keyed
from pkgsieve.operators.keyed import KeyedTable

SCHEMA = "k string, n long, v string"


def files(root):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{root}/runs/*/bucket=*/*.parquet")}


def written(root, before):
    return sum(os.path.getsize(p) for p, t in files(root).items() if before.get(p) != t)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_batches_replace_keys_as_a_dict_would(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "GROWTH", 1)
    rnd = random.Random(3)
    t, want = KeyedTable(spark, f"file:{tmp_path}/t", SCHEMA, ["k"], 4), {}
    for bid in range(7):
        keys = [f"k{rnd.randrange(30)}" for _ in range([20, 3, 1, 0, 6, 2, 9][bid])]
        new = {k: [(k, i, f"{bid}") for i in range(rnd.randrange(3))] for k in keys}  # some have no row left
        batch = spark.createDataFrame([r for v in new.values() for r in v], SCHEMA)
        touched = spark.createDataFrame([(k,) for k in new], "k string")
        before = rows(t.rows(touched, bid - 1))
        assert before == sorted(r for k in new for r in want.get(k, []))
        for _ in range(2 if bid in (2, 4) else 1):  # handled again after a failure
            t.commit(bid, batch, touched)
        want.update(new)
        assert rows(t.rows()) == sorted(r for v in want.values() for r in v)
    assert t.last() == 6 and len(t._folders(f"file:{tmp_path}/t/manifest")) == 2


def test_untouched_files_keep_names_and_times(spark, tmp_path):
    for n in (2000, 20_000):  # what a batch writes follows the batch, not the table
        root = f"{tmp_path}/{n}"
        t = KeyedTable(spark, f"file:{root}", SCHEMA, ["k"], 8)
        t.upsert(0, spark.range(n).selectExpr("concat('k', id) as k", "id as n", "'x' as v"), ["n"])
        first = files(root)
        for bid in range(1, 5):
            before = files(root)
            t.upsert(bid, spark.range(40).selectExpr(f"concat('k', id * {bid}) as k", "id as n", f"'{bid}' as v"), ["n"])
            assert written(root, before) < 25_000
        now = files(root)
        assert all(now.get(p) == m for p, m in first.items())
        assert t.rows().count() == n and t.rows().where("v <> 'x'").count() > 40
    assert os.path.isdir(f"{root}/runs")


def test_reading_a_batch_s_keys_opens_their_buckets_only(spark, tmp_path):
    t = KeyedTable(spark, f"file:{tmp_path}/t", SCHEMA, ["k"], 16)
    t.upsert(0, spark.range(500).selectExpr("concat('k', id) as k", "id as n", "'x' as v"), ["n"])
    found = t.rows(spark.createDataFrame([("k7",), ("none",)], "k string"))
    assert rows(found) == [("k7", 7, "x")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(k" in plan or "PushedFilters: [Or(EqualTo(k" in plan or "In(k, [" in plan
    read = {r[0] for r in t._merged([r for r, _ in t.runs(0)], [r[0] for r in spark.createDataFrame([("k7",)], "k string")
                                                                .select(t._bucket()).collect()]).select(F.input_file_name()).distinct().collect()}
    assert len(read) == 1 and len(files(f"{tmp_path}/t")) == 16  # one bucket's file of all
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


@pytest.mark.parametrize("first", [True, False])
def test_sinks(spark, tmp_path, first):
    t = KeyedTable(spark, f"file:{tmp_path}/t", SCHEMA, ["k"], 4)
    sink = t.insert_ignore if first else t.upsert
    sink(0, spark.createDataFrame([("a", 2, "two"), ("a", 1, "one"), ("b", 5, "five")], SCHEMA), ["n"])
    sink(1, spark.createDataFrame([("a", 9, "nine"), ("c", 3, "three"), ("c", 4, "four")], SCHEMA), ["n"])
    sink(2, spark.createDataFrame([], SCHEMA), ["n"])
    want = [("a", 1, "one"), ("b", 5, "five"), ("c", 3, "three")] if first else [("a", 9, "nine"), ("b", 5, "five"), ("c", 4, "four")]
    assert rows(t.rows()) == want
    s = KeyedTable(spark, f"file:{tmp_path}/s", "k string, item string", ["k", "item"], 4)
    s.add(0, spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "k string, item string"))
    s.add(1, spark.createDataFrame([("a", "x"), ("a", "z")], "k string, item string"))
    assert rows(s.rows()) == [("a", "x"), ("a", "z"), ("b", "y")]


def test_set_add_works_its_items_out_once(spark, tmp_path):
    t = KeyedTable(spark, f"file:{tmp_path}/t", "k string, v string", ["k", "v"], 4)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    items = spark.createDataFrame([(f"k{i % 9}", f"v{i % 4}") for i in range(50)], "k string, v string").coalesce(1)
    t.add(0, items.where("k < 'k5'"))
    t.add(1, items.mapInArrow(count, "k string, v string"))
    assert seen.value == 50
    assert rows(t.rows()) == sorted({(f"k{i % 9}", f"v{i % 4}") for i in range(50)})
