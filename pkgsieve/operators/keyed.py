"""Keyed tables that a batch changes without copying them.

A table is a short list of runs, each a folder of parquet files dealt by a hash
of the key into ``bucket=...`` folders.  A batch writes one run that holds the
rows of the keys it touched and nothing else; a key's rows are those of the
newest run that names it (a key whose rows are all gone leaves a marker).  What
a batch needs of the old table is read from the buckets of its own keys.

Runs of like size are merged as they come (the last two, while the older is at
most ``GROWTH`` times the newer), so there are about as many as the logarithm
of the table and a row is rewritten about as often; every other file keeps its
name and time.  A batch is committed by its manifest, written last under its
id: a batch handled again overwrites its run and manifest, and starts from the
manifest before it.  Runs that neither the last manifest nor the one before it
names are removed.

All paths lie under the folder given, which must be shared by the executors.
Key columns hold no nulls; a key may have any number of rows.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructType

from .common import checkpoint_cut, local_rows
from .sinks import _pick

BUCKETS = 64
GROWTH = 2
FEW_KEYS = 200
MANIFEST = "ord int, run string, n long"


class KeyedTable:
    """Rows of ``schema`` replaced key by key; batches are numbered from 0."""

    def __init__(self, spark: SparkSession, root: str, schema: str | StructType, key: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), list(key), buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.columns = self.schema.fieldNames()
        self.stored = StructType([*self.schema.fields]).add("__gone", BooleanType()).add("bucket", IntegerType())

    # -- files ---------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _folders(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _remove(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def last(self) -> int | None:
        """The last committed batch."""
        done = [int(n.split("=")[1]) for n in self._folders(f"{self.root}/manifest")
                if "_SUCCESS" in self._folders(f"{self.root}/manifest/{n}")]
        return max(done, default=None)

    def runs(self, bid: int | None) -> list[tuple[str, int]]:
        """(run, number of rows) after batch ``bid``, oldest first; a manifest
        that should be there and is not raises."""
        if bid is None or bid < 0:
            return []
        found = self.spark.read.schema(MANIFEST).json(f"{self.root}/manifest/batch={bid}").orderBy("ord").collect()
        return [(r["run"], r["n"]) for r in found]

    # -- reading -------------------------------------------------------------

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _merged(self, runs: Sequence[str], buckets: list[int] | None = None) -> DataFrame:
        """The stored rows of each key's newest run among ``runs``."""
        parts = []
        for k, run in enumerate(runs):
            part = self.spark.read.schema(self.stored).parquet(f"{self.root}/runs/{run}").withColumn("__run", F.lit(k))
            parts.append(part if buckets is None else part.where(F.col("bucket").isin(buckets)))  # prunes folders
        rows = reduce(DataFrame.unionByName, parts)
        if len(runs) > 1:
            newest = rows.groupBy(*self.key).agg(F.max("__run").alias("__run"))
            rows = rows.join(newest, [*self.key, "__run"])
        return rows.select(*self.stored.fieldNames())

    def rows(self, of: DataFrame | None = None, bid: int | None = None) -> DataFrame:
        """The table after batch ``bid`` (the last one); of the keys in ``of``
        alone, read from their buckets."""
        runs = [r for r, _ in self.runs(self.last() if bid is None else bid)]
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        if of is None:
            return self._merged(runs).where("not __gone").select(*self.columns)
        of = of.select(*self.key).distinct()
        # at most ``buckets`` numbers and FEW_KEYS + 1 keys reach the driver
        wanted = [r[0] for r in of.select(self._bucket()).distinct().collect()]
        found = self._merged(runs, wanted)
        if len(self.key) == 1:
            few = [r[0] for r in of.limit(FEW_KEYS + 1).collect()]
            if len(few) <= FEW_KEYS:  # held against the statistics of the files, which are sorted by key
                found = found.where(F.col(self.key[0]).isin(few))
        return found.where("not __gone").select(*self.columns).join(of, self.key, "left_semi")

    # -- writing -------------------------------------------------------------

    def commit(self, bid: int, rows: DataFrame, touched: DataFrame | None = None) -> None:
        """Batch ``bid``: ``rows`` are all rows of the keys in ``touched``
        from now on (keys without rows are gone); without ``touched`` the
        rows' own keys are meant."""
        new = rows.select(*self.columns).withColumn("__gone", F.lit(False))
        if touched is not None:
            gone = touched.select(*self.key).distinct().join(rows.select(*self.key).distinct(), self.key, "left_anti")
            new = new.unionByName(gone.withColumn("__gone", F.lit(True)), allowMissingColumns=True)
        runs = self.runs(bid - 1)
        run, n = self._write(new, f"{bid}")
        runs += [(run, n)] if n else []
        while len(runs) > 1 and runs[-2][1] <= GROWTH * runs[-1][1]:
            merged = self._merged([r for r, _ in runs[-2:]])
            if len(runs) == 2:  # nothing older that a marker could hide
                merged = merged.where("not __gone")
            run, n = self._write(merged, f"{bid}-{len(runs) - 1}")
            runs = runs[:-2] + ([(run, n)] if n else [])
        manifest = local_rows(self.spark, [(k, r, n) for k, (r, n) in enumerate(runs)], StructType.fromDDL(MANIFEST))
        manifest.coalesce(1).write.mode("overwrite").json(f"{self.root}/manifest/batch={bid}")
        self._clean(bid, {r for r, _ in runs})

    def _write(self, rows: DataFrame, run: str) -> tuple[str, int]:
        path = f"{self.root}/runs/{run}"
        dealt = rows.withColumn("bucket", self._bucket()).repartition("bucket").sortWithinPartitions("bucket", *self.key)
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(path)
        return run, self.spark.read.schema(self.stored).parquet(path).count()

    def _clean(self, bid: int, named: set[str]) -> None:
        before = {r for r, _ in self.runs(bid - 1)} if bid else set()
        for run in self._folders(f"{self.root}/runs"):
            if run not in named and run not in before:
                self._remove(f"{self.root}/runs/{run}")
        for name in self._folders(f"{self.root}/manifest"):
            if int(name.split("=")[1]) < bid - 1:
                self._remove(f"{self.root}/manifest/{name}")

    # -- the sinks -----------------------------------------------------------

    def insert_ignore(self, bid: int, batch: DataFrame, order: Sequence[str]) -> None:
        """First write wins: the earliest batch row per key, for keys not yet there."""
        first = _pick(batch, self.key, order, latest=False)
        known = self.rows(first, bid - 1).select(*self.key)
        self.commit(bid, first.join(known, self.key, "left_anti"))

    def upsert(self, bid: int, batch: DataFrame, order: Sequence[str]) -> None:
        """The latest batch row per key replaces what the key had."""
        self.commit(bid, _pick(batch, self.key, order, latest=True))

    def add(self, bid: int, items: DataFrame) -> None:
        """Set-add, for a table whose key is all its columns."""
        fresh = checkpoint_cut(items.select(*self.key).distinct())  # read for its buckets, its keys and its rows
        self.commit(bid, fresh.join(self.rows(fresh, bid - 1), self.key, "left_anti"))
