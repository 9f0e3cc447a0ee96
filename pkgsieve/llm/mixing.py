"""Mixing sources to target weights (DataFrame functions only).

Words are summed per source, every source gets a share of the mix by its
weight, no source more than ``cap`` times its own size (the excess goes to the
others by weight until none is above), and a document is emitted floor(rate)
times plus once more with probability equal to the fraction of its source's
rate.  The coin is a hash of the record and the seed: reruns agree.

Defined cases: a null text has size 0; a null source is a source of its own,
ranked last; a source of size 0 has target 0; rows that are equal in doc_id
and text toss the same coin; a text of any length is counted whole; an empty
table gives an empty result.  Extra columns, whatever their names, pass through
``mix``; ``mix_plan`` gives its own columns alone.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, global_rank, n_words

WEIGHTS = (5, 2, 1)
TOTAL_PERCENT = 150
CAP = 2
COIN = 2 ** 52


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, total_percent: int = TOTAL_PERCENT,
                   cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from rows (source, size).  Each round of
    the loop is one aggregate over the source table and gives the words per
    unit of weight left for the sources below their cap; it ends when no
    further source is above."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").asc_nulls_last()]
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    ranked = global_rank(per, order, "rank")
    ranked = cut(ranked.withColumn("weight", F.get(cycle, (F.col("rank") % len(weights)).cast("int"))))
    whole = ranked.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    budget, free = (whole["s"] or 0) * total_percent, whole["w"] or 1  # in hundredths of a word
    limit = F.col("source_size") * cap
    while True:
        above = limit.cast("double") * F.lit(float(free)) <= F.col("weight") * F.lit(budget / 100)
        got = ranked.agg(F.sum(F.when(above, limit)).alias("capped"),
                         F.sum(F.when(~above, F.col("weight"))).alias("free")).first()
        left = (whole["s"] or 0) * total_percent - 100 * (got["capped"] or 0)
        if not got["free"] or (left, got["free"]) == (budget, free):
            break
        budget, free = left, got["free"]
    target = F.when(above, limit.cast("double")).otherwise(
        F.col("weight") * F.lit(budget / 100) / F.lit(float(free)))
    return ranked.select("source", "source_size", target.alias("target"))


def coin(doc_id: Column, text: Column, seed: int) -> Column:
    """Uniform in [0, 1), from the first 52 bits of an MD5 of the record."""
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")),
                      F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(COIN))


def copies(target: Column, source_size: Column, toss: Column) -> Column:
    """Times a document is emitted."""
    rate = F.when(source_size > 0, target / source_size).otherwise(0.0)
    return (F.floor(rate) + F.when(toss < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def measure(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, toss) per row, written once: the only pass over
    the texts."""
    return cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"),
                           coin(F.col("doc_id"), F.col("text"), seed).alias("toss")))


def _with_targets(rows: DataFrame, source: str, targets: DataFrame) -> DataFrame:
    key = fresh(rows, "__source")[0]
    t = targets.withColumnRenamed("source", key)
    return rows.join(t, F.col(source).eqNullSafe(F.col(key)), "left").drop(key)


def mix_plan(docs: DataFrame, seed: int = 0, **targets) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) per document."""
    m = measure(docs, seed)
    d = _with_targets(m, "source", source_targets(m, **targets))
    d = d.withColumn("copies", copies(F.col("target"), F.col("source_size"), F.col("toss"))).drop("toss")
    return d.withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, seed: int = 0, **targets) -> DataFrame:
    """The mixed corpus: every document repeated as often as it is taken, with
    the columns of ``docs``."""
    size, toss = fresh(docs, "__size", "__toss")
    names = dict(zip(docs.columns, fresh(docs, *[f"__c{i}" for i in range(len(docs.columns))])))
    by = source_targets(cut(docs.select("source", n_words(F.col("text")).alias("size"))), **targets)
    d = docs.withColumnsRenamed(names)
    d = d.withColumn(toss, coin(F.col(names["doc_id"]), F.col(names["text"]), seed))
    d = _with_targets(d, names["source"], by)
    times = copies(F.col("target"), F.col("source_size"), F.col(toss))
    d = d.withColumn(size, F.explode(F.array_repeat(F.lit(0), times.cast("int"))))
    return d.select(*[F.col(n).alias(c) for c, n in names.items()])
