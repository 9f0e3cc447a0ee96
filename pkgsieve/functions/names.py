"""Name-similarity column expressions (F1-F3) and the blocking keys that make
the fuzzy joins equi-joins.

Everything here is a JVM-side ``Column``; nothing runs in Python per row.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def within_distance(a: str | Column, b: str | Column, d: int = 1) -> Column:
    """``0 < levenshtein(a, b) <= d`` (code-point edit distance).

    The thresholded built-in returns -1 once the distance exceeds ``d``, so
    the DP stops early instead of filling the whole matrix.
    """
    dist = F.levenshtein(_col(a), _col(b), d)
    return (dist >= 1) & (dist <= d)


def deletion_keys(name: str | Column, depth: int = 1) -> Column:
    """Deletion neighbourhood of ``name``: itself plus every string obtained by
    deleting up to ``depth`` characters.

    Two names within edit distance ``depth`` always share a key, so an
    equi-join on the exploded keys finds every candidate pair (no cross join);
    the pairs are verified with :func:`within_distance` afterwards.
    """
    keys = F.array(_col(name))
    for _ in range(depth):
        keys = F.array_distinct(F.flatten(F.transform(keys, _one_deletion)))
    return keys


def _one_deletion(s: Column) -> Column:
    # position 0 keeps the string itself, position i drops character i
    return F.transform(
        F.sequence(F.lit(0), F.length(s)),
        lambda i: F.when(i == 0, s).otherwise(
            F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s)))
        ),
    )


def _segment(length: Column, i: Column, parts: int) -> tuple[Column, Column]:
    """First character (from 1) and size of segment ``i`` (from 1) of ``parts``
    near-equal ones; the longer ones come last."""
    base, more = F.floor(length / parts), length % parts
    short = parts - more  # segments of size base
    start = (i - 1) * base + F.greatest(i - 1 - short, F.lit(0)) + 1
    return start.cast("int"), (base + F.when(i > short, 1).otherwise(0)).cast("int")


def segment_keys(name: str | Column, d: int) -> Column:
    """The d + 1 segments of ``name`` as (length, i, segment).

    d edits leave one segment intact, so a string within distance d holds it,
    at one of the places listed by :func:`probe_keys`."""
    s = _col(name)
    n = F.length(s)

    def key(i):
        start, size = _segment(n, i, d + 1)
        return F.struct(n.alias("n"), i.cast("int").alias("i"), F.substring(s, start, size).alias("part"))

    return F.transform(F.sequence(F.lit(1), F.lit(d + 1)), key)


def probe_keys(name: str | Column, d: int) -> Column:
    """The substrings of ``name`` that may be a segment of a string within
    distance ``d``: for each length within d, segment i is sought where the
    i - 1 segments before it and the d + 1 - i after it can have shifted it.
    The number of keys depends on d alone, not on the name's length."""
    s = _col(name)
    n = F.length(s)

    def of_length(delta):  # the other string has n - delta characters
        def of_segment(i):
            start, size = _segment(n - delta, i, d + 1)
            before, after = i - 1, d + 1 - i
            low = F.greatest(F.lit(1), start - before, start + delta - after)
            high = F.least(n - size + 1, start + before, start + delta + after)
            keys = F.transform(F.sequence(low, F.greatest(low, high)), lambda at: F.struct(
                (n - delta).cast("int").alias("n"), i.cast("int").alias("i"), F.substring(s, at, size).alias("part")))
            return F.when(high >= low, keys).otherwise(F.slice(keys, 1, 0))

        found = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(d + 1)), of_segment))
        return F.when(n >= delta, found).otherwise(F.slice(found, 1, 0))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(-d), F.lit(d)), of_length)))


def sorted_chars(name: str | Column) -> Column:
    """Multiset key for the swap join (J3): the characters in sorted order."""
    return F.array_join(F.array_sort(F.split(_col(name), "")), "")


def mismatches(a: str | Column, b: str | Column) -> Column:
    """Hamming distance of two equal-length strings (positions that differ).

    The lambdas see their own arguments alone: a predicate whose lambda body
    names a column of the other side of a join can be pushed below the join."""
    differ = F.zip_with(F.split(_col(a), ""), F.split(_col(b), ""), lambda x, y: ~x.eqNullSafe(y))
    return F.size(F.filter(differ, lambda d: d))


def is_swap(a: str | Column, b: str | Column) -> Column:
    """same length, exactly two differing positions whose characters are
    exchanged (positions need not be adjacent).

    Equal character multisets plus exactly two mismatching positions imply
    the two characters are swapped, so this is the reference rule exactly.
    """
    a, b = _col(a), _col(b)
    return (F.length(a) == F.length(b)) & (sorted_chars(a) == sorted_chars(b)) & (mismatches(a, b) == 2)
