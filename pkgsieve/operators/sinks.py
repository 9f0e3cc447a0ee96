"""Keyed sinks (S16-S18, A7): insert-ignore, upsert, set-add.

All are expressed as anti-joins and group-bys on the key so they run as one
shuffle on the key; a batch is de-duplicated with ``min_by`` / ``max_by``
(partial aggregation, so a key repeated a million times costs one row per
map task).  For streaming use they run inside ``foreachBatch``.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, key: Sequence[str], order: Sequence[str], latest: bool) -> DataFrame:
    key, order = list(key), list(order)
    rest = [c for c in df.columns if c not in key]
    agg = F.max_by if latest else F.min_by
    picked = df.groupBy(*key).agg(agg(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*key, *[F.col(f"__row.{c}").alias(c) for c in rest])


def insert_ignore(target: DataFrame, batch: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First write wins on ``key``: the earliest batch row per key, and
    only for keys not already in ``target``; returns the new table."""
    first = _pick(batch, key, order, latest=False)
    fresh = first.join(target.select(*key).distinct(), list(key), "left_anti")
    return target.unionByName(fresh)


def upsert(target: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """New values overwrite on ``key`` (latest batch row per key)."""
    last = _pick(new, key, order, latest=True)
    kept = target.join(last.select(*key), list(key), "left_anti")
    return kept.unionByName(last)


def set_add_rows(target: DataFrame, adds: DataFrame, key: Sequence[str], item: str,
                 flag: str | None = None) -> DataFrame:
    """A7 as a relation: the set is one row per (key, item); ``$addToSet`` is a
    distinct union, and ``flag`` marks keys whose set is not empty.  Keys
    without items keep one row with a null item."""
    key = list(key)
    items = adds.select(*key, item).distinct()
    out = target.select(*key).distinct().join(items, key, "left")
    if flag is not None:
        out = out.withColumn(flag, F.col(item).isNotNull())
    return out.select(*key, *([flag] if flag else []), item)
