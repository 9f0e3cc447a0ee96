"""Registered query catalogue.

Each plan module registers ``name -> (spark_fn(spark, sf_dir), oracle_sql)``;
``oracle_sql`` is DuckDB SQL over the driver's parquet views (None when the
operator is not SQL-expressible and is checked on rows only).
"""
from .registry import QUERIES, ORACLES, register  # noqa: F401
from . import signals, scalars, changelog, sources, queues, files, metadata, taint, streams  # noqa: F401,E402
