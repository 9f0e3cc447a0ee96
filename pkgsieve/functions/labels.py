"""Label / path / date helpers (F8, F9, F14, P8) as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rank thresholds, MIME types and the snapshot date format.
RANK_HIGH = 7
RANK_MEDIUM = 4
RANK_LOW = 0
MIME_BY_EXT = {".tar.gz": "application/gzip", ".whl": "application/x-wheel+zip"}
SNAPSHOT_TS_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rank_label(score: str | Column) -> Column:
    """F8: numeric severity / confidence -> high / medium / low (null below 0)."""
    s = _c(score)
    return (F.when(s >= RANK_HIGH, F.lit("high"))
             .when(s >= RANK_MEDIUM, F.lit("medium"))
             .when(s >= RANK_LOW, F.lit("low")))


def basename(path: str | Column) -> Column:
    return F.regexp_extract(_c(path), r"([^/]*)$", 1)


def extension(path: str | Column) -> Column:
    """extension with ``.tar.gz`` kept whole; otherwise the last-dot
    extension of the base name, ignoring leading dots (``os.path.splitext``)."""
    b = basename(path)
    return F.when(b.endswith(".tar.gz"), F.lit(".tar.gz")).otherwise(
        F.regexp_extract(b, r"^\.*[^.].*(\.[^.]*)$", 1))


def dispatch_kind(path: str | Column, is_dir: str | Column | None = None) -> Column:
    """What the scanner does with a path: dir, tar.gz, whl, py or null."""
    ext = extension(path)
    k = F.when(ext == ".tar.gz", F.lit("tar.gz")).when(ext == ".whl", F.lit("whl")).when(ext == ".py", F.lit("py"))
    if is_dir is not None:
        k = F.when(_c(is_dir), F.lit("dir")).otherwise(k)
    return k


def mime_type(path: str | Column) -> Column:
    """MIME type of an archive by suffix (null for anything else)."""
    p = _c(path)
    out = None
    for ext, mime in MIME_BY_EXT.items():
        out = (F.when(p.endswith(ext), F.lit(mime)) if out is None else out.when(p.endswith(ext), F.lit(mime)))
    return out


def parse_snapshot_ts(s: str | Column) -> Column:
    """``%Y-%m-%d %H:%M:%S`` string -> timestamp, null when malformed."""
    return F.try_to_timestamp(_c(s), F.lit(SNAPSHOT_TS_FORMAT))


def snapshot_stale(last_update_ts: str | Column, now: str | Column) -> Column:
    """Same year and month as ``now`` -> fresh; otherwise stale iff
    today's day-of-month > 1; a missing timestamp is stale."""
    t, n = _c(last_update_ts), _c(now)
    same = (F.year(t) == F.year(n)) & (F.month(t) == F.month(n))
    return F.when(t.isNull(), F.lit(True)).when(same, F.lit(False)).otherwise(F.dayofmonth(n) > 1)
