"""Scoped lookups by one ordered sweep.

The events of a name in a file -- definitions, ``del``s, import aliases,
imported modules and reads -- are dealt by (file, name), sorted by visit number
and streamed once.  The sweep holds, for the name at hand, the definition that
is live in each scope; a read takes that of the innermost enclosing scope that
has one, a ``del`` ends it there, so each event costs one row whatever the
depth of the scopes or the number of ``del``s.  A task holds one name's live
scopes; the names of a large file are shared by tasks.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.common import without_gc

# what an event is; at one visit number reads come first, definitions after
READ, DEL, DEF, ALIAS, MODULE = range(5)
SEEN = "file_id long, seq int, name string, rec_ns string, rec_seq int, alias_target string, in_imports boolean"


def events(rows: DataFrame, what: int, seq: str, name: str, ns: str | None = None, target: str | None = None) -> DataFrame:
    """Rows of one kind of event in the sweep's columns."""
    text = lambda c: (F.lit(None) if c is None else F.col(c)).cast("string")
    return rows.select("file_id", F.col(name).alias("name"), F.col(seq).cast("int").alias("seq"), F.lit(what).alias("what"),
                       text(ns).alias("ns"), text(target).alias("target"))


def holder(live: dict[str, int], ns: str) -> str | None:
    """The innermost scope of ``ns`` and those around it that has a live definition."""
    while live:
        if ns in live:
            return ns
        if not ns:
            return None
        ns = ns[:ns.rindex(".")]
    return None


def sweep(stream: DataFrame) -> DataFrame:
    """One row (``SEEN``) per read: the record it sees (null if none), the
    alias bound before it and whether the name was imported before it."""
    ordered = stream.repartition("file_id", "name").sortWithinPartitions("file_id", "name", "seq", "what")

    @without_gc
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = name = alias = None
        live, module = {}, False
        for batch in batches:
            at, names, scopes, records, aliases, modules = [], [], [], [], [], []
            files = []
            for f, n, seq, what, ns, target in zip(*[c.to_pylist() for c in batch.columns]):
                if n != name or f != file:
                    file, name, alias, live, module = f, n, None, {}, False
                if what == DEF:
                    live[ns] = seq
                elif what == ALIAS:
                    alias = target
                elif what == MODULE:
                    module = True
                else:
                    scope = holder(live, ns)
                    if what == READ:
                        files.append(f)
                        at.append(seq)
                        names.append(n)
                        scopes.append(scope)
                        records.append(None if scope is None else live[scope])
                        aliases.append(alias)
                        modules.append(module)
                    elif scope is not None:
                        del live[scope]
            yield pa.RecordBatch.from_arrays([
                pa.array(files, pa.int64()), pa.array(at, pa.int32()), pa.array(names, pa.string()), pa.array(scopes, pa.string()),
                pa.array(records, pa.int32()), pa.array(aliases, pa.string()), pa.array(modules, pa.bool_())],
                names=["file_id", "seq", "name", "rec_ns", "rec_seq", "alias_target", "in_imports"])

    return ordered.mapInArrow(run, SEEN)


def scoped_lookup(uses: DataFrame, defs: DataFrame) -> DataFrame:
    """For each use ``(file_id, useq, ns, name)`` the record visible there:
    ``(file_id, useq, name, rec_ns, rec_seq)``; no row when none is.
    ``defs``: ``file_id, ns, name, dseq``."""
    seen = sweep(events(uses, READ, "useq", "name", "ns").unionByName(events(defs, DEF, "dseq", "name", "ns")))
    return seen.where("rec_seq is not null").select("file_id", F.col("seq").alias("useq"), "name", "rec_ns", "rec_seq")


def record_id(ns: Column | str, name: Column | str, seq: Column | str) -> Column:
    """A definition's number within its file."""
    return F.xxhash64(ns, name, seq)
