"""Project and release metadata documents."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import NOT_FOUND_MESSAGE

# Fields of the documents that are kept, as the API names them.
INFO = "struct<name:string,version:string,summary:string>"
URLS = "array<struct<filename:string,url:string,digests:map<string,string>,md5_digest:string>>"
VULNERABILITIES = "array<struct<id:string>>"
DOCUMENT = (f"struct<info:{INFO},last_serial:bigint,releases:map<string,array<string>>,urls:{URLS},"
            f"vulnerabilities:{VULNERABILITIES},message:string>")


def parse_metadata(docs: DataFrame, body: str = "body") -> DataFrame:
    """JSON document -> its fields as columns; the not-found body
    gives no row."""
    d = docs.withColumn("doc", F.from_json(F.col(body), DOCUMENT))
    d = d.where(~F.coalesce(F.col("doc.message") == NOT_FOUND_MESSAGE, F.lit(False)))
    return d.select(*[c for c in docs.columns if c != body], "doc.*").drop("message")


def _removal() -> list[Column]:
    return [F.lit(False).alias("remove"), F.lit(None).cast("long").alias("remove_serial"),
            F.lit(None).cast("string").alias("remove_time"), F.lit(None).cast("long").alias("remove_timestamp")]


def init_project(meta: DataFrame, suspicion: Column, info: Column) -> DataFrame:
    """P1 + P2: the deprecated ``releases`` go, the state columns of a project
    come with their defaults."""
    none = F.array().cast("array<string>")
    return meta.drop("releases").select(
        "*", none.alias("maintainers"), none.alias("owners"), *_removal(), suspicion.alias("suspicion"),
        info.alias("suspicion_info"), F.lit(False).alias("analyzed"))


def init_release(meta: DataFrame, suspicion: Column, info: Column) -> DataFrame:
    """P2 for a release: its urls stay, its set of analysed files is empty."""
    return meta.select("*", *_removal(), suspicion.alias("suspicion"), info.alias("suspicion_info"),
                       F.lit(False).alias("analyzed"), F.array().cast("array<string>").alias("analyzed_files"))


def merge_projects(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """The newest document of a project sets ``info``, ``last_serial``,
    ``urls`` and ``vulnerabilities`` of its live row; ``analyzed`` resets if
    the version changed.  Removed rows are untouched; a project without a live
    row gets one.  Both sides: name, info, last_serial, urls, vulnerabilities;
    the target also remove and analyzed."""
    fields = ["info", "last_serial", "urls", "vulnerabilities"]
    new = incoming.groupBy("name").agg(F.max_by(F.struct(*fields), "last_serial").alias("new"))
    live = target.where(~F.col("remove")).join(new, "name", "full_outer")
    same = F.col("info.version").eqNullSafe(F.col("new.info.version"))
    analyzed = F.when(F.col("new").isNull(), F.col("analyzed")).otherwise(F.coalesce("analyzed", F.lit(False)) & same)
    live = live.select("name", *[F.when(F.col("new").isNull(), F.col(f)).otherwise(F.col(f"new.{f}")).alias(f) for f in fields],
                       F.lit(False).alias("remove"), analyzed.alias("analyzed"))
    return live.unionByName(target.where("remove").select(*live.columns))
