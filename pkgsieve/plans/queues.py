"""Queue and sink queries: J13, T1, T2, W8, P4-P7, S16-S18, A7."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import tables as T
from ..operators import queues as Qu
from ..operators import sinks as Si
from ..operators.keyed import KeyedTable
from ..session import ensure_checkpoint_dir
from .registry import register

# Scan settings of the queue queries (the monitor's CLI defaults are -1/tgz;
# 5 turns scanning on so the queue is not empty).
ANALYZE_THRESHOLD = 5
FILE_TYPE = "tgz"
TOP_K = 100

_CTES = ("release_files",)
_HWM = "(select (min(last_serial) + max(last_serial)) // 2 from release_files)"
_SUSP = "cast(substr(project, 5) as int) % 11"
_TASKS = f"""
, tasks as (
  select project, version, last_serial, idx, filename, {_SUSP} as suspicion,
    row_number() over (partition by project, version, last_serial order by idx, filename) as seq
  from release_files)"""


def _rf(spark, sf):
    return T.derived(spark, sf, "release_files")


def _hwm(rf):
    return F.broadcast(rf.agg(((F.min("last_serial") + F.max("last_serial")) / 2).cast("long").alias("hwm")))


def releases(spark, sf):
    """Release metadata rows with their nested ``urls`` as the release JSON
    has them: one row per (project, version, last_serial) -- one fetch of the
    release -- so a row holds that fetch's files only (one order's line items
    here, at most 7), never a whole release history."""
    rf = _rf(spark, sf)
    return rf.groupBy("project", "version", "last_serial").agg(
        F.collect_list(F.struct("idx", "filename")).alias("urls"))


def project_suspicion_fixture(spark, sf):
    """Suspicion per feed project (fixture: project number % 11)."""
    return _rf(spark, sf).select("project").distinct().select(
        "project", (F.substring("project", 5, 100).cast("int") % 11).alias("suspicion"))


def tasks(spark, sf):
    return Qu.download_tasks(releases(spark, sf), project_suspicion_fixture(spark, sf))


_TASK_COLS = ["project", "version", "last_serial", "idx", "filename", "suspicion", "seq"]


@register("download_tasks", T.with_ctes(_TASKS + """
select project, version, last_serial, idx, filename, suspicion, seq from tasks
""", *_CTES))
def download_tasks(spark, sf):
    """J13 + W8: one task per release file with the project suspicion."""
    return tasks(spark, sf).select(*_TASK_COLS)


@register("download_top", T.with_ctes(_TASKS + f"""
select project, version, last_serial, idx, filename, suspicion, seq from tasks
order by suspicion desc, project, version, last_serial, seq limit {TOP_K}
""", *_CTES))
def download_top(spark, sf):
    """The first TOP_K downloads in priority order (top-k report)."""
    t = tasks(spark, sf)
    return t.orderBy(*Qu.priority_order(t)).limit(TOP_K).select(*_TASK_COLS)


@register("download_order", T.with_ctes(_TASKS + """
select project, version, last_serial, idx, filename, suspicion, seq,
  row_number() over (order by suspicion desc, project, version, last_serial, seq) - 1 as position from tasks
""", *_CTES))
def download_order(spark, sf):
    """The whole download queue, every task with its place."""
    t = tasks(spark, sf)
    return Qu.positions(t, Qu.priority_order(t)).select(*_TASK_COLS, "position")


@register("analysis_order", T.with_ctes(_TASKS + f"""
select project, version, last_serial, idx, filename, suspicion, seq,
  row_number() over (order by suspicion desc, project, version, filename, last_serial, seq) - 1 as position from tasks
where suspicion >= {ANALYZE_THRESHOLD} and ends_with(filename, '.tar.gz')
""", *_CTES))
def analysis_order(spark, sf):
    """The whole analysis queue; the file path goes before the task number."""
    q = Qu.analysis_filter(tasks(spark, sf), ANALYZE_THRESHOLD, FILE_TYPE)
    return Qu.positions(q, Qu.priority_order(q, "filename")).select(*_TASK_COLS, "position")


@register("analysis_queue", T.with_ctes(_TASKS + f"""
select project, version, last_serial, idx, filename, suspicion, seq from tasks
where suspicion >= {ANALYZE_THRESHOLD} and ends_with(filename, '.tar.gz')
""", *_CTES))
def analysis_queue(spark, sf):
    """P4 + P5: the tasks that are analysed (their order: ``analysis_order``)."""
    return Qu.analysis_filter(tasks(spark, sf), ANALYZE_THRESHOLD, FILE_TYPE).select(*_TASK_COLS)


@register("pending_downloads", T.with_ctes(_TASKS + f"""
select project, version, last_serial, idx, filename, suspicion, seq from tasks
where filename not in (select filename from release_files where last_serial <= {_HWM})
""", *_CTES))
def pending_downloads(spark, sf):
    """Tasks whose archive is not stored yet (stored = files of the
    earlier run, up to the mark)."""
    rf = _rf(spark, sf)
    h = _hwm(rf)
    stored = rf.join(h, rf.last_serial <= h.hwm).select("filename")
    return Qu.skip_existing(tasks(spark, sf), stored).select(*_TASK_COLS)


@register("pending_analysis", T.with_ctes(_TASKS + f"""
select project, version, last_serial, idx, filename, suspicion, seq from tasks
where suspicion >= {ANALYZE_THRESHOLD} and ends_with(filename, '.tar.gz')
  and filename not in (select filename from release_files where last_serial <= {_HWM} and idx % 3 = 0)
""", *_CTES))
def pending_analysis(spark, sf):
    """Queued archives without a stored result (results: earlier-run
    files with idx % 3 = 0, a fixture subset)."""
    rf = _rf(spark, sf)
    h = _hwm(rf)
    done = rf.join(h, (rf.last_serial <= h.hwm) & (rf.idx % 3 == 0)).select("filename")
    q = Qu.analysis_filter(tasks(spark, sf), ANALYZE_THRESHOLD, FILE_TYPE)
    return Qu.skip_existing(q, done, cover=False).select(*_TASK_COLS)


# Results are keyed by a report name that recurs in both runs with another
# payload (serial and position) each time, so first and last writer differ.
_FILE_COLS = ["filename", "project", "version", "last_serial", "idx"]
_REPORT = "concat(project, '-', version, '-', cast(last_serial % 997 as varchar(9)), '.json')"


def _reports(spark, sf):
    return _rf(spark, sf).withColumn("filename", F.expr(_REPORT)).select(*_FILE_COLS)


def _results_table(spark, rf, buckets=16):
    """An empty keyed table of reports in the shared folder."""
    return KeyedTable(spark, f"{ensure_checkpoint_dir(spark)}/keyed/{uuid.uuid4().hex}", rf.schema, ["filename"], buckets)


@register("insert_ignore", T.with_ctes(f"""
select {_REPORT} as filename, project, version, last_serial, idx from release_files
qualify row_number() over (partition by {_REPORT} order by last_serial, idx) = 1
""", *_CTES))
def insert_ignore(spark, sf):
    """Results table after an earlier run (up to the mark) and this run;
    first write wins per file name."""
    rf = _reports(spark, sf)
    h = _hwm(rf)
    earlier = rf.join(h, rf.last_serial <= h.hwm).select(*_FILE_COLS)
    later = rf.join(h, rf.last_serial > h.hwm).select(*_FILE_COLS)
    table = _results_table(spark, rf)
    table.insert_ignore(0, earlier, ["last_serial", "idx"])
    table.insert_ignore(1, later, ["last_serial", "idx"])
    return table.rows()


@register("upsert_results", T.with_ctes(f"""
select {_REPORT} as filename, project, version, last_serial, idx from release_files
qualify row_number() over (partition by {_REPORT} order by last_serial desc, idx desc) = 1
""", *_CTES))
def upsert_results(spark, sf):
    """Results keyed by file name; the newer run overwrites."""
    rf = _reports(spark, sf)
    h = _hwm(rf)
    earlier = rf.join(h, rf.last_serial <= h.hwm).select(*_FILE_COLS)
    later = rf.join(h, rf.last_serial > h.hwm).select(*_FILE_COLS)
    table = _results_table(spark, rf)
    table.upsert(0, earlier, ["last_serial", "idx"])
    table.upsert(1, later, ["last_serial", "idx"])
    return table.rows()


@register("lookup_pruned", T.with_ctes(f"""
, latest as (select {_REPORT} as filename, project, version, last_serial, idx from release_files
  qualify row_number() over (partition by {_REPORT} order by last_serial desc, idx desc) = 1),
asked as (select distinct {_REPORT} as filename from release_files where last_serial % 499 = 0
  union select distinct 'no-' || project from release_files)
select a.filename, l.project, l.version, l.last_serial, l.idx from asked a left join latest l using (filename)
""", *_CTES))
def lookup_pruned(spark, sf):
    """Point lookups of some file names in the keyed results table: only
    the buckets of these names are read."""
    rf = _reports(spark, sf)
    table = _results_table(spark, rf, buckets=64)
    table.upsert(0, rf, ["last_serial", "idx"])
    missing = rf.select(F.concat(F.lit("no-"), "project").alias("filename"))
    asked = rf.where(F.col("last_serial") % 499 == 0).select("filename").unionByName(missing).distinct()
    return asked.join(table.rows(asked), "filename", "left").select(*_FILE_COLS)


@register("upsert_private", T.with_ctes("""
select name, versions from (
  select name, versions, row_number() over (partition by name order by src desc, ord desc) as rn from (
    select name, '1.0' as versions, 0 as src, 0 as ord from private
    union all
    select project, '2.' || cast(c_custkey % 7 as varchar), 1, c_custkey from candidates where c_custkey % 19 = 0)
  u) r where rn = 1
""", "candidates", "private"))
def upsert_private(spark, sf):
    """Private package list keyed by name; a new list overwrites."""
    target = T.derived(spark, sf, "private").select("name", F.lit("1.0").alias("versions"), F.lit(None).cast("long").alias("c_custkey"))
    c = T.derived(spark, sf, "candidates").where(F.col("c_custkey") % 19 == 0)
    new = c.select(F.col("project").alias("name"),
                   F.concat(F.lit("2."), (F.col("c_custkey") % 7).cast("string")).alias("versions"), "c_custkey")
    table = KeyedTable(spark, f"{ensure_checkpoint_dir(spark)}/keyed/{uuid.uuid4().hex}", target.schema, ["name"], 16)
    table.upsert(0, target, ["c_custkey"])
    table.upsert(1, new, ["c_custkey"])
    return table.rows().select("name", "versions")


@register("release_analyzed", T.with_ctes(f"""
select distinct r.project, r.version, a.filename is not null as analyzed, a.filename
from (select distinct project, version from release_files) r
left join (select distinct project, version, filename from release_files
           where last_serial <= {_HWM} and ends_with(filename, '.tar.gz')) a
  on r.project = a.project and r.version = a.version
""", *_CTES))
def release_analyzed(spark, sf):
    """Add each analysed archive to its release's ``analyzed_files`` set
    and mark the release analysed.  The set is kept as rows (release, file):
    a release's set can be as large as its file list, so it is never
    gathered into one array."""
    rf = _rf(spark, sf)
    h = _hwm(rf)
    rel = rf.select("project", "version").distinct()
    adds = rf.join(h, (rf.last_serial <= h.hwm) & rf.filename.endswith(".tar.gz")).select(
        "project", "version", "filename")
    key = ["project", "version", "filename"]
    table = KeyedTable(spark, f"{ensure_checkpoint_dir(spark)}/keyed/{uuid.uuid4().hex}", adds.schema, key, 16)
    # two runs, the second of which analyses some archives again
    table.add(0, adds.where(F.xxhash64("filename") % 3 != 0))
    table.add(1, adds.where(F.xxhash64("filename") % 2 == 0).unionByName(adds.where(F.xxhash64("filename") % 3 == 0)))
    return Si.set_add_rows(rel, table.rows(), ["project", "version"], "filename", flag="analyzed")
