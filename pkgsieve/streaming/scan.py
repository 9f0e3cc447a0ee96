"""C4: streamed scanning -- source files land as files, each micro-batch is
scanned with the batch scanner.  Issues and file results are keyed tables
(``operators/keyed.py``): a batch writes those of the files it scanned, in
place of what these files had; a replay overwrites the batch's own run."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.common import checkpoint_cut
from ..operators.keyed import KeyedTable
from ..taint.scanner import file_metrics, scan_corpus

CORPUS_SCHEMA = T.StructType([
    T.StructField("file_id", T.LongType()), T.StructField("package", T.StringType()),
    T.StructField("path", T.StringType()), T.StructField("content", T.StringType()),
])


class ScanStream:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark = spark
        self.root = root
        self.buckets = buckets

    def _table(self, name: str, like: DataFrame | None = None) -> KeyedTable:
        """A keyed table; its columns are those of the first batch's rows, noted beside it."""
        note = f"{self.root}/{name}/_columns"
        if like is not None:
            like.limit(0).write.mode("ignore").parquet(note)
        return KeyedTable(self.spark, f"{self.root}/{name}", self.spark.read.parquet(note).schema, ["file_id"], self.buckets)

    def handle_batch(self, batch: DataFrame, bid: int) -> None:
        res = scan_corpus(batch)
        files = batch.select("file_id").distinct()
        for name, rows in (("issues", res.scan.issues), ("results", file_metrics(res))):
            self._table(name, rows).commit(bid, checkpoint_cut(rows), touched=files)

    def run(self, path: str) -> "ScanStream":
        """Scan the files that have arrived since the last run."""
        s = self.spark.readStream.schema(CORPUS_SCHEMA).option("recursiveFileLookup", "true").parquet(path)
        q = (s.writeStream.foreachBatch(self.handle_batch).option("checkpointLocation", f"{self.root}/_checkpoint")
             .trigger(availableNow=True).start())
        q.awaitTermination()
        return self

    def results(self) -> DataFrame:
        """One row per scanned file: that of the last batch that held it."""
        return self._table("results").rows()

    def issues(self) -> DataFrame:
        """The issues of each file's last scan."""
        return self._table("issues").rows()

    def analyzed(self) -> DataFrame:
        """(package, analyzed): every package with a scanned file."""
        return self.results().select("package").distinct().withColumn("analyzed", F.lit(True))
