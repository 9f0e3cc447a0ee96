"""Streamed state equals the batch operators."""
from pyspark.sql import functions as F

from pkgsieve import tables as T
from pkgsieve.operators import changelog as C
from pkgsieve.plans import streams
from pkgsieve.streaming.monitor import FeedMonitor
from tests.conftest import SF_SMALL

INC = ["project", "incarnation", "open_serial", "opened_by", "open_ts", "close_serial", "close_ts", "live"]


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def check(spark, mon, feed, pm, rm):
    ev = C.with_refresh(C.enrich(C.parse_feed(feed), pm, rm))
    cols = ["serial", "project", "version", "kind", "skipped", "triggers"]
    assert rows(mon.events(), *cols) == rows(ev, *cols)
    inc = C.project_incarnations(ev)
    assert rows(mon.incarnations(), *INC) == rows(inc, *INC)
    assert rows(mon.members(), *C.MEMBER_KEY) == rows(C.project_roles(ev, inc), *C.MEMBER_KEY)


def test_stream_equals_batch_and_replays(spark):
    feed = T.derived(spark, SF_SMALL, "changelog")
    pm, rm = T.derived(spark, SF_SMALL, "project_meta"), T.derived(spark, SF_SMALL, "release_meta")
    # one project takes about half of all rows
    feed = feed.withColumn("project", F.when(F.col("serial") % 2 == 0, F.lit("pkg-1")).otherwise(F.col("project")))
    last = 1
    mon = streams._monitor(spark, SF_SMALL, feed, pages=last + 1)
    page = spark.read.schema(feed.schema).parquet(f"{mon.root}/feed/page={last}")
    mon.handle_batch(page, last)  # handled again, as after a failure before the commit
    first = spark.read.schema(feed.schema).parquet(f"{mon.root}/feed/page=0")
    mon.handle_batch(first, last + 1)  # an old page sent once more as a new batch
    check(spark, mon, feed, pm, rm)


def test_carry_outlives_batches_without_processed_rows(spark):
    feed = [(1, "gone", "1.0", 0, "new release"), (2, "gone", None, 0, "create"),           # all skipped
            (3, "p", "1.0", 0, "add source file p-1.0.tar.gz"), (4, "p", "1.0", 0, "add source file p-1.0.zip"),
            (5, "gone", None, 0, "create"), (6, "p", "1.0", 0, "add source file p-1.0.whl"), (7, "p", "1.1", 0, "new release")]
    schema = "serial long, project string, version string, ts long, action string"
    pm = spark.createDataFrame([("p",)], "name string")
    rm = spark.createDataFrame([("p", "1.0"), ("p", "1.1")], "name string, version string")
    mon = FeedMonitor(spark, pm, rm)
    for bid, cut in enumerate([feed[:2], feed[2:3], [], feed[3:4], feed[4:5], feed[5:]]):
        mon.handle_batch(spark.createDataFrame(cut, schema), bid)
    check(spark, mon, spark.createDataFrame(feed, schema), pm, rm)
    assert {r["serial"] for r in mon.events().where("triggers").collect()} == {1, 3, 7}


def test_metadata_is_reduced_once(spark):
    from pkgsieve.streaming.monitor import FeedMonitor

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    meta = spark.createDataFrame([("p", "1"), ("p", "1"), ("q", None)], "name string, version string").coalesce(1)
    meta = meta.mapInArrow(count, meta.schema)
    mon = FeedMonitor(spark, meta, meta)
    assert seen.value == 6
    assert sorted(map(tuple, mon.rm.collect()), key=str) == [("p", "1"), ("q", None)] and mon.pm.count() == 2
    assert seen.value == 6
