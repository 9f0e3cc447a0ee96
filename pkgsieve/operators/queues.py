"""Download / analysis queues.

The monitor's priority queues become ordered tables: each task carries its
priority key ``(-suspicion, project, version, last_serial, seq)``, with the file
path after the version in the analysis queue.  ``positions`` numbers a whole
queue without a single-task sort; a top-k report uses ``orderBy(...).limit(k)``
(a distributed ``TakeOrderedAndProject``: each partition keeps k rows).  ``seq`` -- the
queue's tie-break counter -- is a ``row_number`` per release ordered by the
feed serial and file index, so no global single-task window is needed.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint_cut


def download_tasks(releases: DataFrame, suspicion: DataFrame) -> DataFrame:
    """J13 + W8: explode each release's ``urls`` array into one task per file,
    carrying the project's suspicion (0 when unscored).

    ``releases``: ``project, version, last_serial, urls ARRAY<STRUCT<idx, filename>>``;
    ``suspicion``: ``project, suspicion``.
    """
    t = releases.select("project", "version", "last_serial", F.explode("urls").alias("u")).select(
        "project", "version", "last_serial", "u.idx", "u.filename")
    t = t.join(suspicion, "project", "left").withColumn("suspicion", F.coalesce("suspicion", F.lit(0)))
    # tie-break within one fetch of the release: bounded by that fetch's files
    w = Window.partitionBy("project", "version", "last_serial").orderBy("idx", "filename")
    return t.withColumn("seq", F.row_number().over(w).cast("long"))


def priority_order(df: DataFrame, *extra: str):
    """T1/T2 queue order."""
    return [F.desc("suspicion"), F.asc("project"), F.asc("version"), *[F.asc(c) for c in extra],
            F.asc("last_serial"), F.asc("seq")]


def positions(tasks: DataFrame, order: Sequence[Column], out: str = "position") -> DataFrame:
    """Every task's place in the whole queue, from 0 without gaps.

    The queue is dealt into ranges of the order and written; each range is
    numbered on its own and shifted by the tasks of the ranges before it (a
    table of one row per range).  Tasks equal in ``order`` take places side by
    side, in either order."""
    dealt = checkpoint_cut(tasks.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    shift = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    local = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    numbered = dealt.withColumn(out, local).join(shift, "__range")
    return numbered.withColumn(out, (F.col(out) + F.col("__before")).cast("long")).drop("__range", "__before")


def analysis_filter(tasks: DataFrame, threshold: int = -1, file_type: str = "tgz") -> DataFrame:
    """P4 + P5: scanning off at threshold -1, else ``suspicion >= threshold``;
    archive kind ``*``, ``tgz`` (``.tar.gz``) or ``whl``."""
    if threshold <= -1:
        return tasks.where(F.lit(False))
    t = tasks.where(F.col("suspicion") >= threshold)
    if file_type == "*":
        return t
    if file_type == "tgz":
        return t.where(F.col("filename").endswith(".tar.gz"))
    if file_type == "whl":
        return t.where(F.col("filename").endswith(".whl"))
    return t.where(F.lit(False))


def skip_existing(tasks: DataFrame, existing: DataFrame, cover: bool = False) -> DataFrame:
    """Drop tasks whose file name is already stored / analysed
    (``left_anti`` on the file name) unless ``cover``."""
    if cover:
        return tasks
    return tasks.join(existing.select("filename").distinct(), "filename", "left_anti")
