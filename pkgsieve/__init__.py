"""pkgsieve: package-registry risk analytics expressed as Spark jobs.

Sub-packages:
  functions/  Column-expression helpers (pure JVM-side expressions)
  sources/    readers that turn raw feeds, JSON / HTML indexes, archives
              and rule YAML into DataFrames
  operators/  the relational operators (signals, change-feed folds, sinks,
              queues, file selection, metrics)
  taint/      taint-to-sink data flow as joins over per-file fact tables
  plans/      the registered query catalogue (DataFrame + DuckDB oracle SQL)
  streaming/  Structured Streaming variants of the monitor
"""

__version__ = "0.1.0"
