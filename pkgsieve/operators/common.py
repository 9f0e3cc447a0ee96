"""Small plan helpers shared by the operators."""
from __future__ import annotations

import gc
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

WRITERS = 32


@contextmanager
def _settings(spark: SparkSession, **wanted: str) -> Iterator[None]:
    """Session settings (``spark.sql.`` left out, ``.`` as ``__``) for the jobs started within."""
    keys = {f"spark.sql.{k.replace('__', '.')}": v for k, v in wanted.items()}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def joined_in_place(spark: SparkSession):
    """Joins on a bucketed table's column and others need no shuffle for jobs started within."""
    return _settings(spark, requireAllClusterKeysForCoPartition="false")


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without_gc(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A pass over batches with the cycle collector off: it makes millions of
    small tuples and no cycles, and the collector would visit them all over again."""
    @wraps(run)
    def passed(batches: Iterator) -> Iterator:
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()

    return passed


def local_rows(spark: SparkSession, rows: Sequence[tuple], schema: StructType) -> DataFrame:
    """A few rows known to the driver as a local relation: no task and no
    Python worker makes them, unlike rows given to ``createDataFrame`` plainly."""
    kinds = to_arrow_schema(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in kinds]
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds), schema)


def checkpoint_cut(df: DataFrame, table: bool = True, by: str | None = None, bucket: str | None = None, dealt: bool = False) -> DataFrame:
    """Cut lineage in the shared folder named by ``spark.checkpoint.dir``.

    ``table=True`` writes ``df`` as a parquet table there and reads it back:
    computed once (a reliable ``Dataset.checkpoint`` runs a count job and then
    recomputes the plan to write it) -- used for the many small loop states of
    the scanner.  ``by`` lays the table out in a folder per value of that
    column, so that a filter on it reads those files alone; it has few values,
    and a task keeps a file open for each (``WRITERS`` at most) instead of
    sorting all its rows by it.  ``bucket`` deals the table by that column into
    as many buckets as a shuffle has partitions, so that joins of such tables
    on it (and more columns) shuffle nothing while ``joined_in_place``; they are
    merge joins, since a table's size on disk says little of its rows' size in
    the driver, where a broadcast is built.  ``dealt``: ``df`` is dealt so already.
    ``table=False`` uses the reliable checkpoint, which keeps the plan's output
    partitioning, so a following window / join on the same keys needs no new
    shuffle -- used for the feed intermediates.  Both survive executor loss;
    local checkpoints are never used.
    """
    import uuid

    from ..session import ensure_checkpoint_dir

    spark = df.sparkSession
    if not table:
        ensure_checkpoint_dir(spark)
        return df.checkpoint(eager=True)
    name = uuid.uuid4().hex
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}"
    writers = {"maxConcurrentOutputFileWriters": str(WRITERS)} if by or bucket else {}
    if bucket is None:
        with _settings(spark, **writers):
            df.write.mode("error").partitionBy(*([by] if by else [])).parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    n = buckets(spark)
    rows = df if dealt else df.repartition(n, bucket)
    with _settings(spark, hive__manageFilesourcePartitions="false", **writers), joined_in_place(spark):
        out = rows.write.mode("error").format("parquet").option("path", path).bucketBy(n, bucket)
        (out.partitionBy(by) if by else out).saveAsTable(f"pkgsieve_{name}")
        found = spark.table(f"pkgsieve_{name}")
    spark.sql(f"drop table pkgsieve_{name}")  # the files stay; the plan has found them
    return found.hint("merge")
