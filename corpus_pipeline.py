"""Corpus pipeline: quality rules, near-duplicates, benchmark leaks, mixing,
token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and reread as the next stage's ``docs``.  All but the last return
the columns of documents; the last one returns a row per document of the mix
(doc_id, start, n_tokens, ids_crc32), read back from the shard files.

Defined cases, by stage.  Null and empty texts fail the quality rules; given to
a later stage they form one near-duplicate group, hold no benchmark item, have
no words to mix and are encoded as the end id.  Null sources are a source, null
doc_ids come last where one of a group stays.  Repeated rows are judged alike
and near-duplicates keep one of them.  Very long texts are read whole.  An
empty table stays empty; a table of no benchmark items drops nothing.  Extra
columns, whatever their names, pass through all stages but the last.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pkgsieve.llm import decontaminate, mixing, quality, simhash, wavelet
from pkgsieve.llm.common import cut, prepare, table
from pkgsieve.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    prepare(spark)
    return quality.filter_docs(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    prepare(spark)
    return simhash.drop_near_duplicates(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    prepare(spark)
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as the mix takes them."""
    prepare(spark)
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as wavelet shards, one row per document read back from them."""
    prepare(spark)
    return wavelet.encode_corpus(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [("quality rules", quality_stage), ("near-duplicates", dedup_stage), ("benchmark leaks", decontaminate_stage),
          ("mixing", mixing_stage), ("token output", token_stage)]
ORACLE_SQL = None  # XXH64 fingerprints, edit distances and CRC-32 have no DuckDB form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
