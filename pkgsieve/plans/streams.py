"""Streaming queries (C1-C4): the stream's final tables must equal the
batch operators' results, so they share the batch oracles."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import tables as T
from ..session import ensure_checkpoint_dir
from ..streaming.monitor import FeedMonitor
from ..streaming.scan import ScanStream
from ..taint.scanner import code_corpus
from . import changelog as CL
from . import taint as TQ
from .registry import ORACLES, register

N_PAGES = 3


def _root(spark):
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex[:8]}"


def _monitor(spark, sf, feed=None, pages=N_PAGES):
    """The derived feed arrives in pages of rising serials; the monitor runs
    after each one, as after a poll."""
    feed = T.derived(spark, sf, "changelog") if feed is None else feed
    mon = FeedMonitor(spark, T.derived(spark, sf, "project_meta"), T.derived(spark, sf, "release_meta"),
                      root=_root(spark), block=CL.feed_block(spark))
    low, high = feed.agg(F.min("serial"), F.max("serial")).first()
    step = (high - low) // pages + 1
    for k in range(pages):
        page = feed.where((F.col("serial") >= low + k * step) & (F.col("serial") < low + (k + 1) * step))
        page.write.parquet(f"{mon.root}/feed/page={k}")
        mon.run(f"{mon.root}/feed")
    return mon


@register("stream_ingest", ORACLES["refresh_triggers"])
def stream_ingest(spark, sf):
    """C1 + C3 (+ W1 across micro-batches): the streamed, W1-flagged feed."""
    ev = _monitor(spark, sf).events()
    return (ev.where(F.col("kind").isin("new release", "yank release", "unyank release", "file"))
              .select("serial", "project", "version", "kind", "skipped", "triggers"))


@register("stream_state", ORACLES["project_incarnations"])
def stream_state(spark, sf):
    """C2 (W2 batch by batch): project incarnations merged into the state
    tables by each micro-batch."""
    return _monitor(spark, sf).incarnations()


@register("stream_roles", ORACLES["project_roles"])
def stream_roles(spark, sf):
    """C2 (W2 + W4 batch by batch): members merged by each micro-batch."""
    return _monitor(spark, sf).members()


def _scan(spark, sf):
    """The derived corpus arrives in two pages; the second one holds some files of the first again."""
    root = _root(spark)
    corpus = code_corpus(T.read(spark, sf, "documents"))
    stream = ScanStream(spark, root)
    for k in range(2):
        page = corpus.where((F.col("file_id") % 2 == k) | (F.lit(k) == 1) & (F.col("file_id") % 10 == 2))
        page.write.parquet(f"{root}/incoming/page={k}")
        stream.run(f"{root}/incoming")
    return stream


@register("stream_scan", ORACLES["issues"])
def stream_scan(spark, sf):
    """C4: source files arriving as a stream are scanned per micro-batch; a
    file that arrives again replaces its issues."""
    return TQ.issue_columns(_scan(spark, sf).issues())


@register("stream_results", ORACLES["file_metrics"])
def stream_results(spark, sf):
    """C4: the results table of the streamed scan, one row per file."""
    return _scan(spark, sf).results().select(F.col("file_id").alias("doc_id"), "files", "lines", "cnt", "low", "medium", "high")
