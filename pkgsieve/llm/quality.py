"""Host-level quality rules (DataFrame functions only).

Each document is measured and checked against a few rules.  Rule failures are
counted per host, the host's failure rates are shrunk towards a beta prior
fitted to all hosts, and a host whose shrunk rate passes the limit of a rule
loses all its documents.  A document is kept if it passes the base rule
(length, repeated 5-word windows), the symbol and the upper-case rule itself
and its host is not rejected; repeated lines count against the host alone.

Defined cases: a null text counts as empty and fails the base rule; a null
host is a host of its own; repeated rows are judged alike; an empty table
gives an empty result; the prior is flat (1, 1) when the hosts' rates do not
vary; a text of any length is measured whole, as one row.  Extra columns pass
through; one named like a result column is kept under a new name
(``give_way``).
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, WORD, cut, fresh, give_way

WINDOW = 5
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper")


@dataclass(frozen=True)
class Limits:
    """``host_rate``: a host goes when its shrunk failure rate of a rule is above."""

    min_words: int = 10
    repeat_percent: int = 20
    symbols_per_100_words: int = 10
    upper_percent: int = 50
    dup_lines_per_100_words: int = 10
    host_rate: float = 0.5


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _windows(words: Column, size: int) -> Column:
    """One 64-bit hash per window of ``size`` words, in text order."""
    starts = F.sequence(F.lit(1), F.size(words) - (size - 1))
    hashed = F.transform(starts, lambda i: F.xxhash64(*[F.element_at(words, i + j) for j in range(size)]))
    return F.when(F.size(words) >= size, hashed).otherwise(F.array().cast("array<long>"))


def _paired(windows: Column) -> Column:
    """(hash, place) pairs in order, which puts equal windows side by side;
    empty for a text without equal windows, the usual case."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:long,i:int>>")
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), pairs).otherwise(none)


def _repeated(pairs: Column) -> Column:
    """Places, in order, of the windows that have an equal neighbour."""
    same = F.transform(pairs, lambda p, k: F.when(
        F.get(pairs, k - 1)["h"].eqNullSafe(p["h"]) | F.get(pairs, k + 1)["h"].eqNullSafe(p["h"]), p["i"]))
    return F.array_sort(F.array_compact(same))


def _union_length(places: Column, size: int) -> Column:
    """Words covered by windows of ``size`` words at ``places`` (ascending)."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-size).alias("last"))
    return F.aggregate(places, start, lambda a, p: F.struct(
        (a["n"] + F.least(F.lit(size), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and the columns of ``MEASURES`` (long).  The texts are split
    once and only counts leave the stage.  Each step is a column of its own, so
    that a lambda reads it instead of working it out per element."""
    docs = give_way(docs, *MEASURES, keep=(text,))
    w, g, pairs, places, lines = fresh(docs, "__words", "__windows", "__pairs", "__places", "__lines")
    t = F.coalesce(F.col(text), F.lit(""))
    no_space = F.translate(t, " \t\n\x0b\f\r", "")
    with_word = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    out = docs.withColumn(w, _words(F.col(text))).withColumn(lines, with_word)
    out = out.withColumn(g, _windows(F.col(w), WINDOW)).withColumn(pairs, _paired(F.col(g)))
    out = out.withColumn(places, _repeated(F.col(pairs)))
    return out.select(
        *docs.columns,
        F.size(w).cast("long").alias("n_words"),
        F.length(no_space).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _union_length(F.col(places), WINDOW).cast("long").alias("n_repeat_words"),
        (F.length(t) - F.length(F.translate(t, UPPER, ""))).cast("long").alias("n_upper"))


def failures(lim: Limits) -> dict[str, Column]:
    n = F.col("n_words")
    return {
        "base_failed": (n < lim.min_words) | (100 * F.col("n_repeat_words") > lim.repeat_percent * n),
        "symbols_failed": 100 * F.col("n_symbols") > lim.symbols_per_100_words * n,
        "upper_failed": 100 * F.col("n_upper") > lim.upper_percent * F.col("word_chars"),
        "lines_failed": 100 * F.col("n_dup_lines") > lim.dup_lines_per_100_words * n,
    }


def host_verdicts(measured: DataFrame, host: str = "source", lim: Limits = Limits()) -> DataFrame:
    """Per host: rows, shrunk failure rate of each rule, ``host_rejected``.

    The prior of a rule is the beta distribution with the mean m and variance
    v of the hosts' rates: strength s = m(1-m)/v - 1, rate = (k + s m)/(n + s).
    """
    checks = failures(lim)
    per = measured.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c.cast("long")).alias(r) for r, c in checks.items()])
    per = cut(per)
    prior = per.agg(*[f(F.col(r) / F.col("n")).alias(f"{r}_{k}")
                      for r in checks for k, f in (("m", F.avg), ("v", F.var_pop))])
    joined = per.join(F.broadcast(prior))  # one row
    rates = {}
    for r in checks:
        m, v = F.col(f"{r}_m"), F.col(f"{r}_v")
        s = F.when(v > 0, F.greatest(m * (1 - m) / v - 1, F.lit(0.0)))
        rates[r] = F.when(s.isNull(), (F.col(r) + 1) / (F.col("n") + 2)).otherwise(
            (F.col(r) + s * m) / (F.col("n") + s))
    rejected = F.greatest(*rates.values()) > lim.host_rate
    return joined.select("host", "n", *[x.alias(f"{r}_rate") for r, x in rates.items()],
                         rejected.alias("host_rejected"))


def judge(measured: DataFrame, host: str = "source", lim: Limits = Limits()) -> DataFrame:
    """The rows of ``measured`` with each rule's failure, the host's shrunk
    rates and verdict, and ``kept``.  ``measured`` is read twice (counts per
    host, then the join of the verdicts), so pass a written table.  Only the
    host table moves if it is small; else a hot host is split by the adaptive
    skew join."""
    checks = failures(lim)
    d = measured = give_way(measured, *checks, *[f"{r}_rate" for r in checks], "host_rejected", "kept", keep=(host,))
    for r, c in checks.items():
        d = d.withColumn(r, c)
    key = fresh(d, "__host")[0]
    verdicts = host_verdicts(measured, host, lim).drop("n").withColumnRenamed("host", key)
    d = d.join(verdicts, F.col(host).eqNullSafe(F.col(key)), "left").drop(key)
    bad = F.col("base_failed") | F.col("symbols_failed") | F.col("upper_failed") | F.col("host_rejected")
    return d.withColumn("kept", ~bad)


def filter_docs(docs: DataFrame, text: str = "text", host: str = "source", lim: Limits = Limits()) -> DataFrame:
    """The kept rows of ``docs`` with its own columns."""
    names = dict(zip(docs.columns, fresh(docs, *[f"__c{i}" for i in range(len(docs.columns))])))
    t = measure(docs.withColumnsRenamed(names), names[text])
    return (judge(cut(t), names[host], lim).where("kept")
            .select(*[F.col(n).alias(c) for c, n in names.items()]))
