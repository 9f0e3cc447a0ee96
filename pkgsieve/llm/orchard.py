"""Vector codes: product quantisation with Orchard's nearest-entry search.

A vector's components become integers (floor of ``scale`` times the component);
the vector is cut into ``parts`` equal consecutive parts, each coded by the
index of the nearest entry of its position's codebook.  Codebooks start as the
parts of the first vectors and are refined in Lloyd rounds.

Orchard's search: for every entry a list of all others, sorted by distance, is
kept.  From a current entry at distance d the list is walked; an entry nearer
than the current one becomes current and its list is walked instead; entries
compared once are marked and not compared again; the walk stops at the first
list entry farther than 2 d from the current one, for by the triangle
inequality no entry from there on is as near.  All numbers are integers, so
the result is exact: the nearest entry, ties to the lower index.

Only codebooks (parts x entries) reach the driver.  Sums for a round are
formed per task, then by Spark.

Defined cases: rows whose vector is null, holds null or non-finite components
or has another length than most vectors (ties: the longest) are left out; a
length that ``parts`` does not divide gives the first parts one component
more; integer components are held within a bound that keeps squared distances
inside a long (beyond +-500,000 for 64 components); repeated rows are coded
each; a null vec_id comes last among the seeds, equal ids by their vectors;
null labels form a group; fewer rows than entries give smaller codebooks; an
empty table gives an empty result.  Other columns, whatever their names, are
not read.  Texts play no part.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256


class Orchard:
    """Nearest entry of one codebook (rows of integers)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        k = len(entries)
        apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        others = np.argsort(apart, axis=1, kind="stable")
        others = others[others != np.arange(k)[:, None]].reshape(k, k - 1)
        end = np.zeros((k, 1), dtype=others.dtype)
        self.order = np.hstack([others, end])
        far = np.full((k, 1), np.iinfo(np.int64).max)
        self.radius = np.hstack([np.take_along_axis(apart, others, axis=1), far])

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index, squared distance) per point, and the comparisons made; all
        points walk their lists side by side."""
        n = len(points)
        current = np.zeros(n, dtype=np.int64)
        d = ((points - self.entries[0]) ** 2).sum(axis=1)
        marked = np.zeros((n, len(self.entries)), dtype=bool)
        marked[:, 0] = True
        at = np.zeros(n, dtype=np.int64)
        walking, compared = np.arange(n), n
        while len(walking):
            here, place = current[walking], at[walking]
            within = self.radius[here, place] <= 4 * d[walking]
            walking, here, place = walking[within], here[within], place[within]
            entry = self.order[here, place]
            at[walking] += 1
            new = ~marked[walking, entry]
            row, entry = walking[new], entry[new]
            marked[row, entry] = True
            compared += len(row)
            dist = ((points[row] - self.entries[entry]) ** 2).sum(axis=1)
            better = (dist < d[row]) | ((dist == d[row]) & (entry < current[row]))
            row = row[better]
            current[row], d[row], at[row] = entry[better], dist[better], 0
        return current, d, compared


@dataclass
class Codebooks:
    """``books[p]``: the entries of part p, a row of integers each."""

    books: list[np.ndarray]
    scale: int = SCALE

    @property
    def spans(self) -> list[tuple[int, int]]:
        ends = np.cumsum([b.shape[1] for b in self.books]).tolist()
        return list(zip([0, *ends[:-1]], ends))

    def sha256(self) -> str:
        """Hash of all entries' components by part, entry, position."""
        return hashlib.sha256(",".join(str(x) for b in self.books for x in b.ravel().tolist()).encode()).hexdigest()


def _finite(vector: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & good


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, ``v`` an array of longs."""
    finite = vectors.select("vec_id", "label", "embedding").where(_finite(F.col("embedding")))
    sizes = finite.groupBy(F.size("embedding").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    most = sizes.orderBy(F.desc("rows"), F.desc("n")).first()
    n = most["n"] if most else 0
    bound = 1 << ((62 - max(n, 1).bit_length()) // 2 - 1)
    x = lambda c: F.greatest(F.lit(-bound), F.least(F.lit(bound), F.floor(c.cast("double") * scale)))
    return cut(finite.where(F.size("embedding") == n).select(
        "vec_id", "label", F.transform("embedding", lambda c: x(c).cast("long")).alias("v")))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(part, entry, n, sums): what each entry's parts add up to."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Orchard(b) for b in books.books]
        counts = [np.zeros(len(b), dtype=np.int64) for b in books.books]
        sums = [np.zeros_like(b) for b in books.books]
        for batch in batches:
            v = _matrix(batch.column(0))
            for p, (a, b) in enumerate(books.spans):
                code, _, _ = search[p].nearest(v[:, a:b])
                np.add.at(counts[p], code, 1)
                np.add.at(sums[p], code, v[:, a:b])
        found = [(p, e, int(counts[p][e]), sums[p][e].tolist()) for p in range(len(sums)) for e in np.flatnonzero(counts[p])]
        yield pa.RecordBatch.from_arrays([
            pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()),
            pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.list_(pa.int64()))],
            names=["part", "entry", "n", "sums"])

    partial = rows.select("v").mapInArrow(per_task, "part int, entry int, n long, sums array<long>")
    width = max(b.shape[1] for b in books.books)
    return (partial.groupBy("part", "entry")
            .agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums")))


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of ``quantised`` rows; None if there are none."""
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not seeds:
        return None
    first = np.array([r["v"] for r in seeds], dtype=np.int64).reshape(len(seeds), -1)
    books = Codebooks([np.ascontiguousarray(x) for x in np.array_split(first, parts, axis=1)], scale)
    for _ in range(rounds):
        new = [b.copy() for b in books.books]
        for r in _sums(rows, books).collect():  # at most parts x entries rows
            book = new[r["part"]]
            book[r["entry"]] = np.array(r["sums"][: book.shape[1]], dtype=np.int64) // r["n"]
        books = Codebooks(new, scale)
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) of ``quantised`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Orchard(b) for b in books.books]
        for batch in batches:
            v = _matrix(batch.column(2))
            codes = np.zeros((len(v), len(search)), dtype=np.uint8 if max(map(len, books.books)) <= 256 else np.uint16)
            error = np.zeros(len(v), dtype=np.int64)
            for p, (a, b) in enumerate(books.spans):
                codes[:, p], dist, _ = search[p].nearest(v[:, a:b])
                error += dist
            code = [row.astype(row.dtype.newbyteorder(">")).tobytes().hex() for row in codes]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error)],
                                             names=["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select("vec_id", "label", "v").mapInArrow(
        run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """``codes`` with ``embedding``, the vector that the code stands for: the
    middle of the cell of each integer component."""

    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        out = []
        for code in column.to_pylist():
            step = 2 if max(map(len, books.books)) <= 256 else 4
            entry = [int(code[i:i + step], 16) for i in range(0, len(code), step)] if code is not None else []
            out.append(np.concatenate([(b[e] + 0.5) / books.scale for b, e in zip(books.books, entry)]).tolist() if entry else None)
        return pa.array(out, pa.list_(pa.float64()))

    return codes.withColumn("embedding", run("code"))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of rows
    (vec_id, embedding, label); label_error is summed over equal labels."""
    rows = quantised(vectors)
    books = fit(rows, parts, entries, rounds)
    if books is None:
        none = rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return none.select("*", F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    coded = cut(encode(rows, books))
    per = coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    return (coded.join(per, coded["label"].eqNullSafe(per["of"]))
            .select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")))
