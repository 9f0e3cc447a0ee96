"""Weighted rendezvous hashing of record keys over shards.

Every (key, shard) pair has a hash u in (0, 1) and a score -weight / ln(u);
a record goes to the shard with the highest score.  A further shard can only
take records into itself, and a shard's share is proportional to its weight.

``slot`` numbers the rows of a shard from 0 without gaps.  A shard is cut into
blocks by a hash of the row, blocks are numbered on their own and shifted by
the rows before them, so no task sorts a whole shard.

Defined cases: a null key hashes like a fixed word of its own; equal keys
share a shard; a null text has size 16 and the CRC of nothing; equal rows get
consecutive slots in either order; a text of any length is one row, sized and
hashed as it stands; an empty table gives an empty result; columns other than
key and text are not read.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh

OVERHEAD = 16
ROWS_PER_BLOCK = 1 << 16


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0..len(weights)-1) of ``key``; the lower shard wins a tie."""
    name = F.coalesce(key.cast("string"), F.lit("\0null"))
    scores = []
    for shard, weight in enumerate(weights):
        bits = F.shiftrightunsigned(F.xxhash64(name, F.lit(shard)), 11)
        u = (bits + F.lit(0.5)) / F.lit(float(1 << 53))
        scores.append(F.struct((F.lit(-float(weight)) / F.ln(u)).alias("score"), F.lit(-shard).alias("shard")))
    best = F.array_max(F.array(*scores)) if len(scores) > 1 else scores[0]
    return -best["shard"]


def place(docs: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * 40,
          grown: float = 1.0) -> DataFrame:
    """(key, size, text_crc32, shard, grown_shard) per row; ``grown_shard``
    is the shard with one more shard of weight ``grown``."""
    t = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(
        F.col(key), (F.octet_length(t) + OVERHEAD).cast("long").alias("size"), F.crc32(t).alias("text_crc32"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), (*weights, grown)).alias("grown_shard"))


def number(placed: DataFrame, shard: str = "shard", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Add ``slot``, gapless from 0 in each shard.  Rows are ordered by a hash
    of all their columns; a block holds about ``rows_per_block`` of them."""
    t = cut(placed)
    block, base, mix = fresh(t, "__block", "__base", "__mix")
    blocks = max(1, -(-t.count() // rows_per_block))
    t = t.withColumn(mix, F.xxhash64(*placed.columns))
    t = t.withColumn(block, F.pmod(F.col(mix), F.lit(blocks)))
    sizes = t.groupBy(shard, block).agg(F.count(F.lit(1)).alias(base))
    before = Window.partitionBy(shard).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(shard, block, F.coalesce(F.sum(base).over(before), F.lit(0)).alias(base))
    local = F.row_number().over(Window.partitionBy(shard, block).orderBy(mix, *placed.columns)) - 1
    t = t.withColumn("slot", local).join(sizes, [shard, block])
    return t.withColumn("slot", (F.col("slot") + F.col(base)).cast("long")).select(*placed.columns, "slot")
