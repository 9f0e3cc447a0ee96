"""Ordered folds over a feed as blocked two-pass prefix scans.

The monitor's state updates depend on feed order (serial).  A plain window
``partitionBy(key).orderBy(serial)`` puts a whole key -- or, with no key,
the whole feed -- into one task.  These helpers split each key's rows into
serial blocks of bounded width (serials are unique, so a block holds at most
``block`` rows):

1. per (key, block): the block's own summary (last value / sum) -- a
   partial-aggregated group-by, so a hot key costs one row per block;
2. per key: the carry into each block from all earlier blocks -- a window
   over the (tiny) block-summary table; without a key, a window per group of
   ``GROUP`` blocks and one over the groups, so no task sees all blocks;
3. per row: a window partitioned by (key, block) plus the carry-in joined
   on (key, block).

Result equals the single window; tasks never exceed one block of one key.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 1 << 20
GROUP = 1 << 12


def _blk(order_col: str, block: int) -> Column:
    return F.floor(F.col(order_col) / F.lit(block)).cast("long")


def _before(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _carry(summ: DataFrame, keys: list[str], value: str, over, merge) -> DataFrame:
    """(keys, __blk, __carry): ``over`` the earlier blocks' ``value``; ``merge``
    adds what the earlier groups of blocks carry."""
    if keys:
        return summ.select(*keys, "__blk", over(value).over(_before(keys, "__blk")).alias("__carry"))
    g = summ.withColumn("__grp", F.floor(F.col("__blk") / GROUP))
    inner = g.select("__grp", "__blk", over(value).over(_before(["__grp"], "__blk")).alias("__in"))
    each = g.groupBy("__grp").agg((F.max_by(value, F.when(F.col(value).isNotNull(), F.col("__blk")))
                                   if over is _last else F.sum(value)).alias("__v"))
    outer = each.withColumn("__one", F.lit(0)).select("__grp", over("__v").over(_before(["__one"], "__grp")).alias("__out"))
    return inner.join(outer, "__grp").select("__blk", merge(F.col("__in"), F.col("__out")).alias("__carry"))


def _last(c):
    return F.last(c, ignorenulls=True)


def prefix_last(
    df: DataFrame,
    keys: Sequence[str],
    order_col: str,
    value: Column,
    out: str,
    block: int = DEFAULT_BLOCK,
    inclusive: bool = False,
) -> DataFrame:
    """Add ``out`` = last non-null ``value`` (by ``order_col``) among earlier
    rows of the same key (``inclusive`` also counts the row itself).

    ``order_col`` must be unique within a key (the feed serial).
    """
    keys = list(keys)
    tmp = f"__v_{out}"
    d = df.withColumn(tmp, value).withColumn("__blk", _blk(order_col, block))
    # 1. last non-null value per (key, block); every block gets a row
    summ = (d.groupBy(*keys, "__blk")
             .agg(F.max_by(F.col(tmp), F.when(F.col(tmp).isNotNull(), F.col(order_col))).alias("__last")))
    # 2. carry-in: last non-null over strictly earlier blocks of the key
    bc = _carry(summ, keys, "__last", _last, F.coalesce)
    # 3. within-block window + carry
    frame = (Window.partitionBy(*keys, "__blk").orderBy(order_col)
             .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    res = d.withColumn("__in", F.last(tmp, ignorenulls=True).over(frame))
    res = res.join(bc, [*keys, "__blk"], "left")
    return res.withColumn(out, F.coalesce("__in", "__carry")).drop(tmp, "__blk", "__in", "__carry")


def prefix_sum(
    df: DataFrame,
    keys: Sequence[str],
    order_col: str,
    value: Column,
    out: str,
    block: int = DEFAULT_BLOCK,
    inclusive: bool = True,
) -> DataFrame:
    """Add ``out`` = running sum of ``value`` over the key's rows up to this
    row (``inclusive``) or strictly before it."""
    keys = list(keys)
    tmp = f"__v_{out}"
    d = df.withColumn(tmp, F.coalesce(value.cast("long"), F.lit(0))).withColumn("__blk", _blk(order_col, block))
    summ = d.groupBy(*keys, "__blk").agg(F.sum(tmp).alias("__s"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    carry = _carry(summ, keys, "__s", F.sum, lambda a, b: zero(a) + zero(b)).withColumn("__carry", zero(F.col("__carry")))
    frame = (Window.partitionBy(*keys, "__blk").orderBy(order_col)
             .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    res = d.withColumn("__in", F.coalesce(F.sum(tmp).over(frame), F.lit(0)))
    res = res.join(carry, [*keys, "__blk"], "left")
    return res.withColumn(out, (F.col("__in") + F.col("__carry")).cast("long")).drop(tmp, "__blk", "__in", "__carry")
