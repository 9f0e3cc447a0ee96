"""Files in the shared folder, written and read inside tasks.

A file gets a name of its own per attempt and counts only once a written table
names it, so a repeated task or a lost executor leaves no half file in a
result."""
from __future__ import annotations

import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from .common import prepare


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder name below the shared folder, as a URI."""
    return f"{prepare(spark).rstrip('/')}/{kind}/{uuid.uuid4().hex}"


def _locate(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def create(folder: str, name: str):
    """(uri, output stream) of a new file ``name`` (made unique) in ``folder``."""
    fs, path = _locate(folder)
    fs.create_dir(path, recursive=True)
    unique = f"{uuid.uuid4().hex[:12]}-{name}"
    return f"{folder}/{unique}", fs.open_output_stream(f"{path}/{unique}", compression=None)


def open_input(uri: str):
    """A seekable input file."""
    fs, path = _locate(uri)
    return fs.open_input_file(path)


def spread(files: DataFrame) -> DataFrame:
    """A table of files dealt out for reading: a task each, or several to a
    task when there are many more files than shuffle partitions."""
    most = 16 * int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(max(1, min(files.count(), most)))
