"""Registry index parsing (S3-S9, S14, S15): JSON and HTML bodies -> rows.

Bodies arrive as string columns (files read with ``spark.read.text`` /
``wholetext`` or a table of fetched responses).  JSON is parsed by ``from_json``
in the JVM, HTML by the event parser of ``html.py`` in Arrow batches.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .html import elements

# Content types the index router accepts, the not-found body.
CT_JSON = "application/vnd.pypi.simple.v1+json"
CT_HTML = ("application/vnd.pypi.simple.v1+html", "text/html")
NOT_FOUND_MESSAGE = "Not Found"

SIMPLE_PROJECT_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("_last-serial", T.LongType()),
    T.StructField("versions", T.ArrayType(T.StringType())),
    T.StructField("files", T.ArrayType(T.StructType([
        T.StructField("filename", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("hashes", T.MapType(T.StringType(), T.StringType())),
        T.StructField("requires-python", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("upload-time", T.StringType()),
        T.StructField("yanked", T.BooleanType()),
    ]))),
    T.StructField("message", T.StringType()),
])

POPULAR_SCHEMA = T.StructType([
    T.StructField("last_update", T.StringType()),
    T.StructField("rows", T.ArrayType(T.StructType([
        T.StructField("project", T.StringType()),
        T.StructField("download_count", T.LongType()),
    ]))),
])


def parse_json_body(df: DataFrame, body: str = "body", schema: T.StructType = SIMPLE_PROJECT_SCHEMA) -> DataFrame:
    """JSON body -> struct column ``doc``; the not-found body gives
    no row."""
    d = df.withColumn("doc", F.from_json(F.col(body), schema))
    return d.where(~F.coalesce(F.col("doc.message") == NOT_FOUND_MESSAGE, F.lit(False)))


def _page(html: str | Column) -> Column:
    return F.col(html) if isinstance(html, str) else html


def anchor_texts(html: str | Column) -> Column:
    """Text of every ``<a>`` element, in document order."""
    return elements(_page(html), "a")["text"]


def li_texts(html: str | Column) -> Column:
    """Text of every ``<li>`` element."""
    return elements(_page(html), "li")["text"]


def anchors_with_href(html: str | Column) -> Column:
    """(href, text) of every anchor that has an ``href`` attribute."""
    return F.filter(elements(_page(html), "a"), lambda x: x["href"].isNotNull())


def route_content(ct: str | Column) -> Column:
    """JSON branch, HTML branch or reject.  Exact string equality, so a
    content type with parameters (``text/html; charset=...``) is rejected."""
    c = F.col(ct) if isinstance(ct, str) else ct
    return F.when(c == CT_JSON, F.lit("json")).when(c.isin(*CT_HTML), F.lit("html")).otherwise(F.lit("reject"))
