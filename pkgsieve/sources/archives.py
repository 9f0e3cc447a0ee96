"""Package archives -> member files.

``spark.read.format("binaryFile")`` lists and reads archives in parallel; a
``mapInPandas`` step opens each ``.tar.gz`` / ``.whl`` in memory and emits one
row per member (package path, member path, bytes).  Members never touch
local disk.  An archive that cannot be read yields one quarantine row
(``error`` set) and no members, as the monitor drops the whole archive.

``members_of`` works on any ``(path, content)`` table, so archives read
from storage and archives built in Spark go through the same extraction.
"""
from __future__ import annotations

import io
import lzma
import tarfile
import zipfile
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import dispatch_kind

BATCH_BYTES, BATCH_ROWS = 1 << 22, 5_000  # of member bytes and rows handed on at once, one archive at least

MEMBER_SCHEMA = T.StructType([
    T.StructField("archive", T.StringType()),
    T.StructField("member", T.StringType()),
    T.StructField("content", T.BinaryType()),
    T.StructField("error", T.StringType()),
])


def _members(path: str, data: bytes) -> list[tuple]:
    """Every member of an archive, or the one error row if any of them cannot
    be read: an archive counts whole or not at all."""
    try:
        if path.endswith(".tar.gz"):
            with tarfile.open(fileobj=io.BytesIO(data), mode="r:gz") as tf:
                return [(path, m.name, tf.extractfile(m).read(), None) for m in tf.getmembers() if m.isfile()]
        if path.endswith(".whl"):
            with zipfile.ZipFile(io.BytesIO(data)) as zf:
                return [(path, n, zf.read(n), None) for n in zf.namelist() if not n.endswith("/")]
        return [(path, path.rsplit("/", 1)[-1], data, None)] if path.endswith(".py") else []
    except (tarfile.TarError, zipfile.BadZipFile, zlib.error, lzma.LZMAError, OSError, EOFError, ValueError,
            RuntimeError, NotImplementedError) as e:  # the last two: encrypted or unsupported members
        return [(path, None, None, f"{type(e).__name__}: {e}")]


def _explode(batches):
    columns = [f.name for f in MEMBER_SCHEMA.fields]
    out, held = [], 0
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            rows = _members(path, bytes(content))
            out += rows
            held += sum(len(r[2] or b"") for r in rows)
            if held >= BATCH_BYTES or len(out) >= BATCH_ROWS:  # small archives share a batch
                yield pd.DataFrame(out, columns=columns)
                out, held = [], 0
    yield pd.DataFrame(out, columns=columns)


def members_of(files: DataFrame) -> DataFrame:
    """``(path, content)`` archives -> one row per member (bad archives
    -> one quarantine row with ``error``)."""
    return files.select("path", "content").mapInPandas(_explode, MEMBER_SCHEMA)


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """S12 + S13: every member of every archive / source file under ``path``."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .where(dispatch_kind(F.col("path")).isNotNull()))
    return members_of(files)


def _pack(batches):
    """(archive name, member path, text, corrupt) -> (path, archive bytes)."""
    for pdf in batches:
        out = []
        for name, member, text, bad in zip(pdf["archive"], pdf["member"], pdf["content"], pdf["corrupt"]):
            data = (text or "").encode("utf-8")
            buf = io.BytesIO()
            if name.endswith(".tar.gz"):
                with tarfile.open(fileobj=buf, mode="w:gz") as tf:
                    ti = tarfile.TarInfo(member)
                    ti.size = len(data)
                    tf.addfile(ti, io.BytesIO(data))
            else:
                with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
                    zf.writestr(member, data)
            raw = buf.getvalue()
            out.append((name, raw[:20] if bad else raw))
        yield pd.DataFrame(out, columns=["path", "content"])


def pack_archives(files: DataFrame) -> DataFrame:
    """Build one archive per source file in memory (``archive, member,
    content, corrupt`` -> ``path, content``); ``corrupt`` truncates it."""
    return files.select("archive", "member", "content", "corrupt").mapInPandas(
        _pack, "path string, content binary")


def archive_corpus(members: DataFrame) -> DataFrame:
    """Member ``.py`` files as a scanner corpus (``file_id`` from a hash of
    archive + member path).  The content stays bytes: the parser decodes it as
    the file's coding line says."""
    py = members.where(F.col("error").isNull() & F.col("member").endswith(".py"))
    return py.select(
        F.xxhash64("archive", "member").alias("file_id"),
        F.col("archive").alias("package"),
        F.col("member").alias("path"),
        "content",
    )
