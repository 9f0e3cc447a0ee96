"""When a taint first arrives at each record of a file.

Seeds put taints on records at a visit number; an edge (r, a, b) is a read of
record a at visit r that feeds record b and carries on what reached a before
r.  A guarded taint does not pass an edge whose lines hold the taint's own.

A file's visits are cut into blocks of bounded width, as in
``operators/folds.py``:

1. per (file, block): the block's transfer -- which records that may be
   tainted when the block begins reach which records read after it, with the
   guard lines met on the way -- and what the block's own seeds leave behind;
2. per file: the carry into each block, from the transfers of the blocks
   before it (rows go with the records that live across blocks, not with the
   edges);
3. per (file, block): the arrivals within the block, its carry standing first.

So the blocks of a large file are shared by tasks, and a task holds one
block's edges.  Files that fit one block need step 3 alone.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import checkpoint_cut, without_gc

BLOCK = 1 << 15  # visits
BATCH = 20_000  # rows handed on at once, a block at least
# rows of a block, in this order: guard lines (1.) or what is carried in (3.), then seeds and edges by visit
ROWS = ["file_id", "blk", "first", "r", "a", "b", "tid", "line", "guarded", "lines", "opens", "lives"]
KINDS = ["long", "int", "boolean", "int", "long", "long", "long", "int", "boolean", "array<int>", "boolean", "boolean"]
READ, PASS, LEAVE = range(3)  # rows of a block's summary
SUMMARY = "file_id long, blk int, what int, a long, b long, tid long, line int, guarded boolean, lines array<int>"
CARRY = "file_id long, blk int, a long, tid long, line int, guarded boolean"
ARRIVALS = "file_id long, rid long, tid long, at int"


def _rows(df: DataFrame, **given) -> DataFrame:
    return df.select(*[given.get(c, F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in zip(ROWS, KINDS)])


def _dealt(rows: DataFrame) -> DataFrame:
    # a seed at visit r is not seen by a read at r; seeds come first all the same
    return rows.repartition("file_id", "blk").sortWithinPartitions("file_id", "blk", F.desc("first"), "r", F.col("tid").isNull())


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    fields = [f.split(" ") for f in ddl.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


class _Block:
    """Taints held by the records of a block while its rows go by."""

    def __init__(self):
        self.held: dict[int, dict[int, int]] = {}  # record -> taint -> arrival
        self.how: dict[int, tuple[int, bool]] = {}  # taint -> line, guarded

    def put(self, record: int, tid: int, at: int, line: int, guarded: bool) -> None:
        self.how[tid] = line, guarded
        self.held.setdefault(record, {}).setdefault(tid, at)

    def read(self, r: int, a: int, b: int, lines: list[int]) -> None:
        for tid, at in list(self.held.get(a, {}).items()):
            line, guarded = self.how[tid]
            if at < r and not (guarded and line in lines):
                self.held.setdefault(b, {}).setdefault(tid, r)


class _Transfer(_Block):
    """A block whose entry is not known yet: besides the taints of its own
    seeds, the records that may be tainted on entry are followed as they are,
    each with the guard lines met (only smallest sets are kept)."""

    def __init__(self):
        super().__init__()
        self.guards: set[int] = set()
        self.ways: dict[int, dict[int, list[frozenset]]] = {}  # record -> entry record -> sets of lines met
        self.entries: set[int] = set()
        self.lasting: set[int] = set()

    def read(self, r, a, b, lines, opens=False, lives=False):
        super().read(r, a, b, lines)
        if lives:
            self.lasting.add(b)
        met = frozenset(self.guards.intersection(lines))
        found = {e: list(sets) for e, sets in self.ways.get(a, {}).items()}
        if opens:
            self.entries.add(a)
            found[a] = [frozenset()]
        for entry, sets in found.items():
            if entry == b:
                continue
            known = self.ways.setdefault(b, {}).setdefault(entry, [])
            for way in (s | met for s in sets):
                if not any(k <= way for k in known):
                    known[:] = [k for k in known if not way <= k] + [way]

    def summary(self, file: int, blk: int) -> list[tuple]:
        rows = [(file, blk, READ, a, None, None, None, None, None) for a in self.entries]
        for b in self.lasting:
            rows += [(file, blk, PASS, e, b, None, None, None, sorted(s)) for e, sets in self.ways.get(b, {}).items() for s in sets]
            rows += [(file, blk, LEAVE, None, b, tid, *self.how[tid], None) for tid in self.held.get(b, {})]
        return rows


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, block = None, _Transfer()
    for batch in batches:
        for file, blk, first, r, a, b, tid, line, guarded, lines, opens, lives in zip(*[c.to_pylist() for c in batch.columns]):
            if (file, blk) != key:
                if key:
                    yield _batch(block.summary(*key), SUMMARY)
                key, block = (file, blk), _Transfer()
            if first:
                block.guards.add(line)
            elif tid is not None:
                block.put(b, tid, r, line, guarded)
                if lives:
                    block.lasting.add(b)
            else:
                block.read(r, a, b, lines, opens, lives)
    if key:
        yield _batch(block.summary(*key), SUMMARY)


def _carries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    file = blk = None
    held, how, pending = {}, {}, []
    for batch in batches:
        out = []
        for f, k, what, a, b, tid, line, guarded, lines in zip(*[c.to_pylist() for c in batch.columns]):
            if f != file or k != blk:
                if f != file:
                    held, how, pending = {}, {}, []
                for record, tids in pending:  # a block's rows all see what held when it began
                    held.setdefault(record, set()).update(tids)
                file, blk, pending = f, k, []
            if what == READ:
                out += [(f, k, a, t, *how[t]) for t in held.get(a, ())]
            elif what == PASS:
                through = [t for t in held.get(a, ()) if not (how[t][1] and how[t][0] in lines)]
                if through:
                    pending.append((b, through))
            else:
                how[tid] = line, guarded
                pending.append((b, [tid]))
        yield _batch(out, CARRY)


@without_gc
def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, block, found = None, _Block(), []

    def end() -> None:
        found.extend([(key[0], rid, tid, at) for rid, taints in block.held.items() for tid, at in taints.items() if at >= 0])

    for batch in batches:
        for file, blk, first, r, a, b, tid, line, guarded, lines, _, _ in zip(*[c.to_pylist() for c in batch.columns]):
            if (file, blk) != key:
                if key:
                    end()
                    if len(found) >= BATCH:  # small blocks share a batch
                        yield _batch(found, ARRIVALS)
                        found = []
                key, block = (file, blk), _Block()
            if first:
                block.put(a, tid, -1, line, guarded)
            elif tid is not None:
                block.put(b, tid, r, line, guarded)
            else:
                block.read(r, a, b, lines)
    if key:
        end()
    yield _batch(found, ARRIVALS)


def carry_in(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(``CARRY``): the taints of records read in a block that reached them in
    an earlier one.  ``edges`` and ``seeds`` have their ``blk``."""
    uses = edges.select("file_id", F.col("a").alias("rec"), "blk", F.lit(True).alias("read"))
    fills = edges.select("file_id", F.col("b").alias("rec"), "blk", F.lit(False).alias("read"))
    fills = fills.unionByName(seeds.select("file_id", F.col("rid").alias("rec"), "blk", F.lit(False).alias("read")))
    life = checkpoint_cut(uses.unionByName(fills).groupBy("file_id", "rec").agg(
        F.max(F.when(F.col("read"), F.col("blk"))).alias("last_read"), F.min(F.when(~F.col("read"), F.col("blk"))).alias("first_fill")))
    source = life.select("file_id", F.col("rec").alias("a"), "first_fill")
    target = life.select("file_id", F.col("rec").alias("b"), "last_read")
    lives, opens = F.coalesce(F.col("last_read") > F.col("blk"), F.lit(False)), F.coalesce(F.col("first_fill") < F.col("blk"), F.lit(False))
    own = _rows(edges.join(source, ["file_id", "a"]).join(target, ["file_id", "b"]).withColumns({"opens": opens, "lives": lives}), first=F.lit(False))
    own = own.unionByName(_rows(seeds.withColumnRenamed("rid", "b").join(target, ["file_id", "b"]).withColumn("lives", lives),
                                first=F.lit(False), r=F.col("at")))
    lines = edges.select("file_id", "blk", F.explode("lines").alias("line")).distinct()
    guards = lines.join(seeds.where("guarded").select("file_id", "line").distinct(), ["file_id", "line"])
    rows = _dealt(own.unionByName(_rows(guards, first=F.lit(True))))
    summary = checkpoint_cut(rows.mapInArrow(_summaries, SUMMARY))
    return summary.repartition("file_id").sortWithinPartitions("file_id", "blk", "what").mapInArrow(_carries, CARRY)


def earliest(edges: DataFrame, seeds: DataFrame, long_files: DataFrame, block: int = BLOCK) -> DataFrame:
    """(file_id, rid, tid, at): the earliest arrival of each taint at each record.

    ``seeds`` (file_id, rid, tid, at, line, guarded): taints put on records;
    ``edges`` (file_id, r, a, b, lines); ``long_files`` (file_id): those with
    visits beyond the first block."""
    edges = edges.withColumn("blk", F.floor(F.col("r") / block).cast("int"))
    seeds = seeds.withColumn("blk", F.floor(F.col("at") / block).cast("int"))
    rows = _rows(edges, first=F.lit(False))
    rows = rows.unionByName(_rows(seeds, first=F.lit(False), r=F.col("at"), b=F.col("rid")))
    if long_files.isEmpty():
        return _dealt(rows).mapInArrow(_within, ARRIVALS)
    cuts = [checkpoint_cut(x.join(long_files, "file_id", "left_semi")) for x in (edges, seeds)]
    rows = rows.unionByName(_rows(carry_in(*cuts), first=F.lit(True), r=F.lit(-1)))
    found = _dealt(rows).mapInArrow(_within, ARRIVALS)
    return found.groupBy("file_id", "rid", "tid").agg(F.min("at").alias("at"))
