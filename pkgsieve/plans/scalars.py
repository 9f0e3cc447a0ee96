"""Scalar-function queries: F6, F8, F9/S13, F13, F14/T3, P8."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables as T
from ..functions import actions as A
from ..functions import labels as L
from .registry import register


@register("version_parse", T.with_ctes("""
select project, filename,
  rtrim(ltrim(ltrim(filename, project), '-'), '.tar.gz') as version,
  substr(filename, s, greatest(e - s + 1, 0)) as version_strict
from (select *, case when starts_with(filename, project || '-') then length(project) + 2 else 1 end as s,
        case when ends_with(filename, '.tar.gz') then length(filename) - 7 else length(filename) end as e
      from release_files where ends_with(filename, '.tar.gz')) r
""", "release_files"))
def version_parse(spark, sf):
    """F6 on every ``.tar.gz`` release file (compat and strict)."""
    rf = T.derived(spark, sf, "release_files").where(F.col("filename").endswith(".tar.gz"))
    return rf.select("project", "filename",
                     A.version_from_filename("project", "filename").alias("version"),
                     A.version_from_filename("project", "filename", strict=True).alias("version_strict"))


@register("severity_label", """
select event_id, score, case when score >= 7 then 'high' when score >= 4 then 'medium'
  when score >= 0 then 'low' end as label
from (select event_id, cast(floor(value) as bigint) % 12 - 1 as score from events) e
""")
def severity_label(spark, sf):
    """F8 over a score column derived from ``events.value``."""
    ev = T.read(spark, sf, "events").select("event_id", (F.floor("value").cast("long") % 12 - 1).alias("score"))
    return ev.select("event_id", "score", L.rank_label("score").alias("label"))


@register("metadata_url", T.with_ctes("""
select distinct project, version, 'https://pypi.org/pypi/' || project || '/json' as project_url,
  'https://pypi.org/pypi/' || project || '/' || version || '/json' as release_url
from changelog
""", "changelog"))
def metadata_url(spark, sf):
    """metadata URLs for every (project, version) in the feed."""
    cl = T.derived(spark, sf, "changelog").select("project", "version").distinct()
    return cl.select("project", "version", A.project_json_url("project").alias("project_url"),
                     A.release_json_url("project", "version").alias("release_url"))


_SNAP = "try_strptime(last_update, '%Y-%m-%d %H:%M:%S')"


@register("snapshot_stale", T.with_ctes(f"""
select last_update, case when t is null then true
  when year(t) = year(n) and month(t) = month(n) then false else day(n) > 1 end as stale
from (select last_update, {_SNAP} as t,
        (select max({_SNAP}) from popular_snapshots) + interval 14 day as n from popular_snapshots) s
""", "popular_snapshots"))
def snapshot_stale(spark, sf):
    """P8 with "now" = newest snapshot + 14 days (data-derived)."""
    snaps = T.derived(spark, sf, "popular_snapshots").withColumn("t", L.parse_snapshot_ts("last_update"))
    now = snaps.agg((F.max("t") + F.expr("interval 14 days")).alias("n"))
    return snaps.crossJoin(F.broadcast(now)).select(  # now is one row
        "last_update", L.snapshot_stale("t", "n").alias("stale"))


@register("latest_popular", T.with_ctes(f"""
select max_by(last_update, {_SNAP}) as last_update, count(*) as n_snapshots from popular_snapshots
""", "popular_snapshots"))
def latest_popular(spark, sf):
    """Newest popular snapshot by parsed date (max_by, no sort)."""
    snaps = T.derived(spark, sf, "popular_snapshots")
    return snaps.agg(F.max_by("last_update", L.parse_snapshot_ts("last_update")).alias("last_update"),
                     F.count("*").alias("n_snapshots"))


@register("scan_dispatch", T.with_ctes(r"""
select path, ext, case ext when '.tar.gz' then 'tar.gz' when '.whl' then 'whl' when '.py' then 'py' end as kind,
  case when ends_with(path, '.tar.gz') then 'application/gzip'
       when ends_with(path, '.whl') then 'application/x-wheel+zip' end as mime
from (select path, case when ends_with(b, '.tar.gz') then '.tar.gz'
        else regexp_extract(b, '^\.*[^.].*(\.[^.]*)$', 1) end as ext
      from (select path, regexp_extract(path, '([^/]*)$', 1) as b from
        (select filename as path from release_files
         union all select file_dir || '/' || file_name from source_files) u) x) y
""", "release_files", "source_files"))
def scan_dispatch(spark, sf):
    """S13 + F9: dispatch kind and MIME type for every archive and source path."""
    paths = (T.derived(spark, sf, "release_files").select(F.col("filename").alias("path"))
             .unionByName(T.derived(spark, sf, "source_files")
                          .select(F.concat_ws("/", "file_dir", "file_name").alias("path"))))
    return paths.select("path", L.extension("path").alias("ext"), L.dispatch_kind("path").alias("kind"),
                        L.mime_type("path").alias("mime"))
