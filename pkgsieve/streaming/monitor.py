"""Structured Streaming monitor.

The registry feed arrives as files of feed rows, in pages of rising serials.
One streaming query reads them (``readStream`` + ``trigger(availableNow)`` for
a catch-up run over what is there, or ``processingTime`` for the 60 s poll)
and hands each micro-batch to ``foreachBatch``, which runs the *batch*
operators on it and merges their results into the state tables:

* events: the parsed, enriched and W1-flagged rows;
* carry (one row): the last serial handled and the last processed row, which
  W1 compares the next batch's first rows with;
* projects: per project its number of incarnations and the live one (W2);
* members: owners and maintainers of live incarnations (W4);
* closed incarnations and their members, appended by the batch that closes them.

Projects and members are keyed tables (``operators/keyed.py``): a batch reads
the buckets of the projects it touches and writes the rows of those projects
alone, so what it writes follows the batch and not the number of projects.
A batch starts from the tables of the batch before it and writes under its own
id, overwriting: a replayed batch leaves the same tables, and batches are read
in the order of their ids.  Rows up to the last handled serial have
been handled (the poll asks for later ones) and are skipped.  No table is
written by one task, and a busy project is split by the blocked prefix scans
like in the batch operators.  All paths lie under the shared checkpoint folder.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import changelog as C
from ..operators.common import checkpoint_cut
from ..operators.folds import DEFAULT_BLOCK
from ..operators.keyed import KeyedTable
from ..session import ensure_checkpoint_dir

FEED_SCHEMA = T.StructType([
    T.StructField("serial", T.LongType()), T.StructField("project", T.StringType()),
    T.StructField("version", T.StringType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("action", T.StringType()),
])
CARRY = "last_serial long, processed boolean, project string, version string"
PROJECTS = "project string, n long, live boolean, open_serial long, opened_by string, open_ts long"
MEMBERS = "project string, incarnation long, role string, user string"
INCARNATIONS = ("project string, incarnation long, open_serial long, opened_by string, open_ts long, "
                "close_serial long, close_ts long, live boolean")


class FeedMonitor:
    """Incremental feed ingestion; see the module's text for its tables."""

    def __init__(self, spark: SparkSession, project_meta: DataFrame, release_meta: DataFrame,
                 root: str | None = None, block: int = DEFAULT_BLOCK, buckets: int = 16):
        self.spark = spark
        self.root = root or f"{ensure_checkpoint_dir(spark)}/monitor-{uuid.uuid4().hex[:8]}"
        # every batch looks its events up in them: reduced to their keys once
        self.pm = checkpoint_cut(project_meta.select("name").distinct())
        self.rm = checkpoint_cut(release_meta.select("name", "version").distinct())
        self.block = block
        self.projects = KeyedTable(spark, f"{self.root}/projects", PROJECTS, ["project"], buckets)
        self.members_now = KeyedTable(spark, f"{self.root}/members", MEMBERS, ["project"], buckets)

    def _path(self, table: str, bid: int) -> str:
        return f"{self.root}/{table}/batch_id={bid}"

    def _write(self, df: DataFrame, table: str, bid: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self._path(table, bid))
        return self.spark.read.schema(df.schema).parquet(self._path(table, bid))

    def _prior(self, table: str, schema: str, bid: int) -> DataFrame:
        """The table that the batch before ``bid`` wrote; empty before the
        first.  A table that should be there and is not raises."""
        if bid == 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(table, bid - 1))

    def handle_batch(self, batch: DataFrame, bid: int) -> None:
        carry = self._prior("carry", CARRY, bid).first()  # one row
        parsed = C.parse_feed(batch)
        if carry is not None:
            parsed = parsed.where(F.col("serial") > carry["last_serial"])
        enriched = C.enrich(parsed, self.pm, self.rm)
        if carry is not None and carry["processed"]:
            # the last processed row before this batch stands in front of it
            before = {"serial": carry["last_serial"], "project": carry["project"], "version": carry["version"], "kind": "other",
                      "skipped": False}
            row = self.spark.range(1).select(*[F.lit(before.get(f.name)).cast(f.dataType).alias(f.name) for f in enriched.schema])
            enriched = enriched.unionByName(row)
        ev = C.with_refresh(enriched, self.block)
        if carry is not None:
            ev = ev.where(F.col("serial") > carry["last_serial"])
        ev = self._write(ev.repartitionByRange("serial").sortWithinPartitions("serial"), "events", bid)
        last = ev.agg(F.max("serial").alias("s"), F.max_by(F.struct("project", "version"), F.when(~F.col("skipped"), F.col("serial")))
                      .alias("row")).first()
        if last["row"] is None:  # nothing processed in this batch: what was carried stays
            row = (carry["processed"], carry["project"], carry["version"]) if carry is not None else (False, None, None)
        else:
            row = (True, last["row"]["project"], last["row"]["version"])
        serial = last["s"] if last["s"] is not None else carry["last_serial"] if carry is not None else -1
        self._write(self.spark.createDataFrame([(serial, *row)], CARRY).coalesce(1), "carry", bid)  # one row
        self._merge_state(ev, bid)

    def _merge_state(self, ev: DataFrame, bid: int) -> None:
        """W2 and W4 on this batch's events, continuing the live incarnations."""
        names = checkpoint_cut(ev.select("project").distinct())
        touched = checkpoint_cut(self.projects.rows(names, bid - 1))
        reopened = touched.where("live").select(
            "project", F.col("open_serial").alias("serial"), F.col("open_ts").alias("ts_s"), F.col("opened_by").alias("kind"),
            F.lit(True).alias("project_found"), F.lit(True).alias("refresh"))
        own = ["project", "serial", "ts_s", "kind", "project_found", "refresh"]
        inc = C.project_incarnations(ev.select(*own).unionByName(reopened), self.block)
        earlier = touched.select("project", (F.col("n") - F.col("live").cast("long")).alias("earlier"))
        inc = inc.join(earlier, "project", "left").withColumn(
            "incarnation", F.col("incarnation") + F.coalesce("earlier", F.lit(0))).drop("earlier")
        inc = checkpoint_cut(inc)
        newest = inc.groupBy("project").agg(F.max("incarnation").alias("n"), F.max_by(
            F.struct("live", "open_serial", "opened_by", "open_ts"), "incarnation").alias("x")).select("project", "n", "x.*")
        self.projects.commit(bid, newest)
        closed = self._write(inc.where(~F.col("live")), "closed", bid)

        moves = checkpoint_cut(C.role_moves(ev, inc, self.block))
        pulled = moves.where("sign < 0").select(*C.MEMBER_KEY).distinct()
        prior = self.members_now.rows(names, bid - 1)
        now = prior.join(pulled, C.MEMBER_KEY, "left_anti").unionByName(C.members(moves)).distinct()
        now = checkpoint_cut(now)
        gone = closed.select("project", "incarnation")
        self._write(now.join(gone, ["project", "incarnation"], "left_semi"), "closed_members", bid)
        self.members_now.commit(bid, now.join(gone, ["project", "incarnation"], "left_anti"), touched=names)

    def start(self, feed_path: str, poll: str | None = None):
        """Start the ingestion query.  ``poll=None`` handles what is there
        and not yet handled (``availableNow``) and stops; ``poll="60 seconds"``
        keeps polling.  Returns the StreamingQuery."""
        stream = self.spark.readStream.schema(FEED_SCHEMA).option("recursiveFileLookup", "true").parquet(feed_path)
        w = stream.writeStream.foreachBatch(self.handle_batch).option("checkpointLocation", f"{self.root}/_checkpoint")
        w = w.trigger(availableNow=True) if poll is None else w.trigger(processingTime=poll)
        return w.start()

    def run(self, feed_path: str) -> "FeedMonitor":
        """Catch-up run over the pages that have arrived."""
        self.start(feed_path).awaitTermination()
        return self

    def _all(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}")

    def events(self) -> DataFrame:
        return self._all("events").drop("batch_id")

    def incarnations(self) -> DataFrame:
        none = F.lit(None).cast("long")
        live = self.projects.rows().where("live").select(
            "project", F.col("n").alias("incarnation"), "open_serial", "opened_by", "open_ts",
            none.alias("close_serial"), none.alias("close_ts"), "live")
        columns = [c.split(" ")[0] for c in INCARNATIONS.split(", ")]
        return self._all("closed").select(*columns).unionByName(live)

    def members(self) -> DataFrame:
        return self._all("closed_members").select(*C.MEMBER_KEY).unionByName(self.members_now.rows())
