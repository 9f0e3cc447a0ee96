"""Near-duplicate vectors by NN-descent.

Every distinct vector keeps a list of its K nearest vectors so far.  The lists
start from blocks of vectors with neighbouring random-projection codes (a few
draws, each block compared within itself).  In a round a vector looks at the
lists of its neighbours: what is nearer than the last of its own list enters
it, and a neighbour whose list would take the vector gets it too.  Rounds go on
for vectors that gained a link.  A list whose every entry is a link is
saturated: it is doubled, up to ``LONGEST``; a vector still saturated then is
counted exactly (below).  These steps work on vectors rounded to one byte per
component; each pair near the threshold is then compared in double precision
and kept only at or above it.

Exact count of dense groups: in a component that holds a vector with a full
list of links all pairs are judged.  Vectors within half the threshold's angle
of the group's mean direction are linked to one another for certain (triangle
inequality), so they are counted without comparing them; the others are
compared with all members, a block of one with a block of the other per task.

Audit: ``AUDIT`` vectors, those of lowest hash, are compared with all vectors;
while the share of their links that was found is under ``TARGET`` more draws
and rounds follow, until they add nothing.

Only the audited vectors (a fixed number), a few counts and the audit's
result reach the driver.

Defined cases: a vector that is null, zero, holds null or non-finite
components or has another length than most links with nothing; equal vectors
are one vector with a weight and link with each other; a null vec_id never
names a component (null where all members' are null, and such a row is not
kept); rows with equal ids keep their own vectors; an empty table gives an
empty result.  Columns of other names are not read; texts play no part.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .simhash import components

THRESHOLD = 0.9
SHORTEST, LONGEST = 8, 32  # entries of a list
DRAWS = 4
CODE_BITS = 24
BLOCK = 512  # vectors compared with one another for the first lists
PER_TASK = 8192  # vectors of a task while the first lists are made
UNIT = 127
MARGIN = 0.02  # of the rounded cosine
AUDIT, TARGET = 1024, 0.98
OUTER, INNER = 256, 2048  # a task's block of far members, of all members
SLICE = 2000
NEAR = "array<struct<s:int,u:long>>"
NEAR_ARROW = pa.list_(pa.struct([("s", pa.int32()), ("u", pa.int64())]))


@dataclass
class Graph:
    """``table`` (vec_id, n_links, component_id, kept), ``links`` (a, b) between
    ``points`` (vid, first = smallest vec_id, weight, vec) found by the lists
    (dense groups hold more), the audited share ``recall``."""

    table: DataFrame
    links: DataFrame
    points: DataFrame
    recall: float


def _floats(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int8).reshape(len(column), -1)


def distinct_points(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, points): rows (vec_id, h1, h2), the hashes null where the vector
    links with nothing; points (vid, h1, h2, first, weight, vec, unit)."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("embedding").isNotNull() & good & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", F.when(good, F.col("embedding")).alias("vec"))
    sizes = rows.where("vec is not null").groupBy(F.size("vec").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    most = sizes.orderBy(F.desc("rows"), F.desc("n")).first()
    rows = rows.withColumn("vec", F.when(F.size("vec") == (most["n"] if most else 0), F.col("vec")))
    distinct = (rows.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("weight"))
                .select(F.monotonically_increasing_id().alias("vid"), *_hashes(), "first", "weight", "vec"))

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = np.rint(_unit(_floats(batch.column(5))) * UNIT).astype(np.int8) if len(batch) else np.zeros((0, 1), np.int8)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([u.tobytes() for u in unit], pa.binary())],
                                             names=[*batch.schema.names, "unit"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in distinct.schema)
    points = cut(distinct.mapInArrow(quantise, kinds + ", unit binary"))
    hashed = [F.when(F.col("vec").isNotNull(), h).alias(n) for h, n in zip(_hashes(), ("h1", "h2"))]
    return rows.select("vec_id", *hashed), points


def _hashes():
    return [F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2")]


def _lists(target: np.ndarray, s: np.ndarray, u: np.ndarray, most: int) -> pa.RecordBatch:
    """Rows (vid, near): for each target its ``most`` best distinct entries."""
    order = np.lexsort((u, -s, target))
    target, s, u = target[order], s[order], u[order]
    new = np.ones(len(target), dtype=bool)
    new[1:] = (target[1:] != target[:-1]) | (u[1:] != u[:-1]) | (s[1:] != s[:-1])
    target, s, u = target[new], s[new], u[new]
    first = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.r_[first, len(target)])
    keep = np.arange(len(target)) - np.repeat(first, sizes) < most
    ids = target[first]
    target, s, u = target[keep], s[keep], u[keep]
    offsets = np.r_[0, np.cumsum(np.minimum(sizes, most))].astype(np.int32)
    entries = pa.StructArray.from_arrays([pa.array(s, pa.int32()), pa.array(u, pa.int64())], names=["s", "u"])
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), entries)],
                                      names=["vid", "near"])


def first_lists(points: DataFrame, n: int, draw: int, draws: int = DRAWS) -> DataFrame:
    """(vid, near): the best of each vector's block, for draws ``draw`` on.
    Vectors with equal codes are dealt by a hash that differs by draw."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _bytes(batch.column(1)).astype(np.float32)
            for d in range(draw, draw + draws):
                planes = np.random.default_rng(d).normal(size=(x.shape[1], CODE_BITS)).astype(np.float32)
                code = (x @ planes > 0) @ (1 << np.arange(CODE_BITS, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), d, dtype=np.int32)), pa.array(code), *batch.columns],
                                                 names=["draw", "code", "vid", "unit"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        held = pa.Table.from_batches(held).sort_by([("draw", "ascending"), ("code", "ascending"), ("tie", "ascending")]).combine_chunks()
        at, vid = held["draw"].to_numpy(), held["vid"].to_numpy()
        units = _bytes(held["unit"].combine_chunks()).astype(np.float32)
        for rows in np.split(np.arange(len(at)), np.flatnonzero(at[1:] != at[:-1]) + 1):
            for block in np.array_split(rows, -(-len(rows) // BLOCK)):
                if len(block) < 2:
                    continue
                s = units[block] @ units[block].T  # whole numbers below 2 ** 24: exact
                np.fill_diagonal(s, -np.inf)
                k = min(SHORTEST, len(block) - 1)
                best = np.argpartition(-s, k - 1, axis=1)[:, :k]
                yield _lists(np.repeat(vid[block], k), np.take_along_axis(s, best, axis=1).ravel().astype(np.int32), vid[block][best].ravel(), k)

    coded = points.select("vid", "unit").mapInArrow(project, "draw int, code long, vid long, unit binary")
    coded = coded.withColumn("tie", F.xxhash64("draw", "vid"))
    coded = coded.repartitionByRange(max(1, -(-n * draws // PER_TASK)), "draw", "code", "tie")
    return coded.mapInArrow(compare, f"vid long, near {NEAR}")


def merge(lists: DataFrame, least: int) -> DataFrame:
    """Lists (vid, near, k, before) put together to one per vector: the k best;
    ``links`` of them reach ``least``; a list of links alone is doubled."""
    flat = lists.groupBy("vid").agg(F.flatten(F.collect_list("near")).alias("near"), F.max("k").alias("k"), F.max("before").alias("before"))
    best = flat.withColumn("near", F.slice(F.sort_array(F.array_distinct("near"), asc=False), F.lit(1), F.col("k")))
    best = best.withColumn("links", F.size(F.filter("near", lambda e: e["s"] >= least)))
    full = F.col("links") == F.col("k")
    grow = full & (F.col("k") < LONGEST)
    last = F.when(F.size("near") == F.col("k"), F.get("near", F.col("k") - 1)["s"]).otherwise(F.lit(-(1 << 30)))
    return best.select("vid", "near", F.when(grow, 2 * F.col("k")).otherwise(F.col("k")).cast("int").alias("k"), "links",
                       F.when(grow, F.lit(-(1 << 30))).otherwise(last).cast("int").alias("last"), (full & ~grow).alias("saturated"),
                       (grow | (F.col("links") > F.col("before"))).alias("active"))


def look_around(state: DataFrame, points: DataFrame) -> DataFrame:
    """(vid, near): what active vectors find in the lists of their neighbours,
    and what their neighbours gain by them."""
    units = points.select("vid", "unit")
    own = state.where("active").join(units, "vid")
    edges = own.select("vid", "unit", "last", F.explode("near").alias("e")).select(
        "vid", "unit", "last", F.col("e.u").alias("u"), F.col("e.s").alias("s"))
    asked = edges.select("u").distinct()
    lists = state.select(F.col("vid").alias("u"), F.col("last").alias("last_u"), "near").join(asked, "u", "left_semi")
    entries = lists.select("u", "last_u", F.explode("near").alias("e")).select("u", "last_u", F.col("e.u").alias("vid"))
    packed = entries.join(units, "vid").groupBy("u").agg(  # at most LONGEST entries
        F.max("last_u").alias("last_u"), F.collect_list("vid").alias("w"), F.collect_list("unit").alias("units"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            found: list[list[np.ndarray]] = [[], [], []]
            for a in range(0, len(whole), SLICE):
                u, vid, unit, last, s, last_u, w, theirs = whole.slice(a, SLICE).columns
                sizes = np.diff(w.offsets.to_numpy())
                row = np.repeat(np.arange(len(sizes)), sizes)
                mine, other = _bytes(unit).astype(np.float32), _bytes(theirs.flatten()).astype(np.float32)
                cos = np.einsum("ij,ij->i", mine[row], other).astype(np.int32)
                vid, last, w = vid.to_numpy(), last.to_numpy(), w.flatten().to_numpy()
                better = (cos > last[row]) & (w != vid[row])
                back = s.to_numpy() > last_u.to_numpy()
                for out, x, y in zip(found, (vid[row], cos, w), (u.to_numpy(), s.to_numpy(), vid)):
                    out += [x[better], y[back]]
            target, cos, w = (np.concatenate(f) if f else np.zeros(0, dtype=np.int64) for f in found)
            yield _lists(target, cos, w, LONGEST)

    joined = edges.join(packed, "u").select("u", "vid", "unit", "last", "s", "last_u", "w", "units")
    return joined.mapInArrow(run, f"vid long, near {NEAR}")


def verified(pairs: DataFrame, points: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose cosine in double precision reaches ``threshold``."""
    side = lambda c: points.select(F.col("vid").alias(c), F.col("vec").alias(f"vec_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                cos = _cosines(_floats(batch.column(2)), _floats(batch.column(3)))
                batch = batch.filter(pa.array(cos >= threshold))
                yield batch.select(["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "vec_a", "vec_b").mapInArrow(run, "a long, b long")


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", _unit(x), _unit(y))


def list_links(state: DataFrame, points: DataFrame, least: int, threshold: float) -> DataFrame:
    near = state.select("vid", F.explode(F.filter("near", lambda e: e["s"] >= least)).alias("e"))
    pairs = near.select(F.least("vid", "e.u").alias("a"), F.greatest("vid", "e.u").alias("b")).distinct()
    return cut(verified(pairs, points, threshold))


def dense_counts(members: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(vid, n): links of each member (label, vid, weight, vec) of the dense
    groups, without its own copies; exact."""
    half = math.acos(threshold) / 2 - 1e-6

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                label, place = np.unique(batch.column(0).to_numpy(), return_inverse=True)
                total = np.zeros((len(label), dim))
                np.add.at(total, place, _unit(_floats(batch.column(1))))
                yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["label", "sums"])

    partial = members.select("label", "vec").mapInArrow(sums, "label long, sums array<double>")
    pivots = cut(partial.groupBy("label").agg(F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(dim)]).alias("pivot")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                pivot = _floats(batch.column(4))
                pivot[~pivot.any(axis=1)] = 1.0  # no mean direction: any will do
                angle = np.arccos(np.clip(_cosines(_floats(batch.column(3)), pivot), -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(angle <= half)], names=["label", "vid", "weight", "vec", "inner"])

    kind = members.schema["vec"].dataType.simpleString()
    placed = members.join(pivots, "label").select("label", "vid", "weight", "vec", "pivot")
    placed = cut(placed.mapInArrow(place, f"label long, vid long, weight long, vec {kind}, inner boolean"))
    sizes = placed.groupBy("label").agg(F.coalesce(F.sum(F.when(F.col("inner"), F.col("weight"))), F.lit(0)).alias("inside"),
                                        F.ceil(F.count(F.lit(1)) / INNER).alias("chunks"),
                                        F.ceil(F.count(F.when(~F.col("inner"), 1)) / OUTER).alias("blocks"))
    sized = placed.join(cut(sizes), "label")
    certain = sized.where("inner").select("vid", (F.col("inside") - F.col("weight")).alias("n"))
    rows = sized.where("blocks > 0")
    chunk, block = F.pmod(F.xxhash64("vid"), "chunks"), F.pmod(F.xxhash64("vid"), "blocks")
    far = rows.where("not inner").select(F.col("label").alias("far_label"), block.alias("far_block"),
                                         F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("far_chunk"),
                                         *[F.col(c).alias(f"far_{c}") for c in ("vid", "weight", "vec")])
    near = rows.select("label", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), chunk.alias("chunk"),
                       "vid", "weight", "inner", "vec")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"vid": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        x, y = (_unit(_floats(v.combine_chunks())) for v in (left["far_vec"], right["vec"]))
        a, b = left["far_vid"].to_numpy(), right["vid"].to_numpy()
        link = (x @ y.T >= threshold) & (a[:, None] != b[None, :])
        inner = right["inner"].to_numpy()
        of_far, of_inner = link @ right["weight"].to_numpy(), left["far_weight"].to_numpy() @ link[:, inner]
        return pa.table({"vid": pa.array(np.r_[a, b[inner]], pa.int64()), "n": pa.array(np.r_[of_far, of_inner].astype(np.int64))})

    key = ["label", "block", "chunk"]
    compared = far.groupBy(*[f"far_{c}" for c in key]).cogroup(near.groupBy(key)).applyInArrow(compare, "vid long, n long")
    return certain.union(compared).groupBy("vid").agg(F.sum("n").alias("n"))


def audit(points: DataFrame, counts: DataFrame, threshold: float, most: int = AUDIT) -> float:
    """Share of the links of ``most`` vectors (lowest hash) that were found."""
    picked = points.orderBy(F.xxhash64("vid"), "vid").limit(most)
    sample = picked.select("vid", "vec").collect()
    if not sample:
        return 1.0
    ids, x = np.array([r["vid"] for r in sample]), _unit(np.array([r["vec"] for r in sample], dtype=np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), dtype=np.int64)
        for batch in batches:
            for a in range(0, len(batch), SLICE):
                vid, weight, vec = batch.slice(a, SLICE).columns
                link = (_unit(_floats(vec)) @ x.T >= threshold) & (vid.to_numpy()[:, None] != ids[None, :])
                total += weight.to_numpy() @ link
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["vid", "true"])

    true = points.select("vid", "weight", "vec").mapInArrow(run, "vid long, true long").groupBy("vid").agg(F.sum("true").alias("true"))
    both = true.join(counts, "vid", "left").agg(F.sum(F.least("true", F.coalesce("n", F.lit(0)))).alias("found"), F.sum("true").alias("true")).first()
    return both["found"] / both["true"] if both["true"] else 1.0


def neighbour_graph(vectors: DataFrame, threshold: float = THRESHOLD, target: float = TARGET) -> Graph:
    """The graph of links at cosine >= ``threshold`` between rows (vec_id, embedding)."""
    rows, points = distinct_points(vectors)
    n = points.count()
    dim = len(points.select("vec").first()["vec"]) if n else 0
    least = math.floor((threshold - MARGIN) * UNIT * UNIT)
    state, draw, known = None, 0, -1
    while True:
        lists = first_lists(points, n, draw).select("vid", "near", F.lit(SHORTEST).alias("k"), F.lit(-1).alias("before"))
        state = cut(merge(lists if state is None else lists.union(_as_lists(state)), least))
        draw += DRAWS
        held = -1
        while True:
            sums = state.agg(F.sum("links"), F.count_if("active")).first()
            if not sums[1] or held == sums[0]:
                break
            held = sums[0]
            new = look_around(state, points).select("vid", "near", F.lit(0).alias("k"), F.lit(0).alias("before"))
            state = cut(merge(_as_lists(state).union(new), least))
        links = list_links(state, points, least, threshold)
        labels = cut(components(links).withColumnRenamed("fp", "vid"))
        counts = cut(_counts(state, links, labels, points, dim, threshold))
        recall = audit(points, counts, threshold)
        found = links.count()
        if recall >= target or found == known:
            break
        known = found
    return Graph(_table(rows, points, counts, labels), links, points, recall)


def _as_lists(state: DataFrame) -> DataFrame:
    return state.select("vid", "near", "k", F.col("links").alias("before"))


def _counts(state: DataFrame, links: DataFrame, labels: DataFrame, points: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(vid, n): links of each vector with others, in rows; copies of the
    vector itself are not among them."""
    full = state.where("saturated").select("vid").join(labels, "vid").select("label").distinct()
    dense = cut(labels.join(full, "label", "left_semi"))
    members = cut(dense.join(points.select("vid", "weight", "vec"), "vid").select("label", "vid", "weight", "vec"))
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(
        points.select(F.col("vid").alias("b"), "weight"), "b")
    listed = both.groupBy(F.col("a").alias("vid")).agg(F.sum("weight").alias("n")).join(dense.select("vid"), "vid", "left_anti")
    return listed.union(dense_counts(members, dim, threshold)) if dim else listed


def _table(rows: DataFrame, points: DataFrame, counts: DataFrame, labels: DataFrame) -> DataFrame:
    each = points.select("vid", "h1", "h2", "first", "weight").join(labels, "vid", "left").join(counts, "vid", "left")
    each = cut(each.select("h1", "h2", "first", F.coalesce("label", "vid").alias("label"),
                           (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    named = each.groupBy("label").agg(F.min("first").alias("component_id"))
    found = each.join(named, "label").select("h1", "h2", "n_links", "component_id")
    out = rows.join(found, ["h1", "h2"], "left")
    alone = F.col("h1").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
