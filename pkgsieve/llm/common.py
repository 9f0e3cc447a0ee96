"""Helpers shared by the training-data operators.

Words are maximal runs of characters other than space and U+0009..U+000D
(``WORD``); a null text has none.  Operators add helper columns under names
made by ``fresh`` so that extra input columns, whatever their names, survive.
"""
from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.common import checkpoint_cut
from ..session import ensure_checkpoint_dir, ship_code

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def prepare(spark: SparkSession) -> str:
    """Ship the package to the Python workers; the shared folder's URI."""
    ship_code(spark)
    return ensure_checkpoint_dir(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later reads
    neither recompute it nor depend on the executors that made it."""
    prepare(df.sparkSession)
    return checkpoint_cut(df)


def cut_packed(df: DataFrame) -> DataFrame:
    """Like ``cut``, for tables that are mostly text or bytes: compressed
    harder (zstd), to take less of the shared folder."""
    path = f"{prepare(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names starting with ``bases`` that ``df`` does not use."""
    used = {c.lower() for c in df.columns}
    out = []
    for b in bases:
        name, i = b, 0
        while name.lower() in used:
            i += 1
            name = f"{b}_{i}"
        used.add(name.lower())
        out.append(name)
    return out


def give_way(df: DataFrame, *results: str, keep: Sequence[str] = ()) -> DataFrame:
    """``df`` with its own columns that are named like a result column (in any
    case of letters) renamed to a free name, ``<name>_1`` or the next; those in
    ``keep``, which the operator reads, may not be among them."""
    taken = {r.lower() for r in results}
    if bad := [c for c in keep if c.lower() in taken]:
        raise ValueError(f"column {bad[0]} is read and has the name of a result")
    names, used = {}, {c.lower() for c in df.columns} | taken
    for c in df.columns:
        if c.lower() in taken:
            i = next(i for i in range(1, len(used) + 2) if f"{c}_{i}".lower() not in used)
            names[c] = f"{c}_{i}"
            used.add(names[c].lower())
    return df.withColumnsRenamed(names)


def n_words(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def global_rank(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """Add ``out``: the row's rank from 0 in ``order`` over all rows, with no
    single-task sort.  Range partitions are numbered, ranked on their own and
    shifted by the rows before them; the window without keys sees one row per
    range partition."""
    part, base, n = fresh(df, "__part", "__base", "__n")
    t = cut(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    sizes = t.groupBy(part).agg(F.count(F.lit(1)).alias(n))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base))
    local = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    return (t.withColumn(out, local).join(sizes, part)
            .withColumn(out, (F.col(out) + F.col(base)).cast("long")).drop(part, base))
