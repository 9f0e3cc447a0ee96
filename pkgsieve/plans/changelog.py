"""Change-feed queries: S1, S2, J14, W1-W5, A9, A10, S19, F4-F7."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables as T
from ..operators import changelog as C
from ..operators.common import checkpoint_cut
from . import feedsql as Q
from .registry import register

# Serial-block width of the blocked prefix scans; bounds the rows per task.
FEED_BLOCK_CONF = "spark.pkgsieve.feedBlock"
FEED_BLOCK_DEFAULT = 1 << 16


def feed_block(spark) -> int:
    return int(spark.conf.get(FEED_BLOCK_CONF, str(FEED_BLOCK_DEFAULT)))


def parsed(spark, sf):
    return C.parse_feed(T.derived(spark, sf, "changelog"))


def enriched(spark, sf):
    return C.enrich(parsed(spark, sf), T.derived(spark, sf, "project_meta"), T.derived(spark, sf, "release_meta"))


def events(spark, sf):
    """Parsed + enriched + W1-flagged feed, checkpointed: every state table
    reads it several times, so its lineage is cut once (reliable checkpoint
    in ``spark.checkpoint.dir``; a production job writes it as a table)."""
    return checkpoint_cut(C.with_refresh(enriched(spark, sf), feed_block(spark)), table=False)


def incarnations(spark, sf, ev=None):
    inc = C.project_incarnations(ev if ev is not None else events(spark, sf), feed_block(spark))
    return checkpoint_cut(inc, table=False)


@register("action_parse", Q.feed_ctes() + """
select serial, action, kind, filename, owner, maintainer from parsed
""")
def action_parse(spark, sf):
    return parsed(spark, sf).select("serial", "action", "kind", "filename", "owner", "maintainer")


@register("changelog_enriched", Q.feed_ctes() + """
select serial, project, version, kind, project_found, release_found, skipped from enriched
""")
def changelog_enriched(spark, sf):
    return enriched(spark, sf).select("serial", "project", "version", "kind", "project_found", "release_found",
                                      "skipped")


@register("refresh_triggers", Q.feed_ctes() + """
select serial, project, version, kind, skipped, triggers from triggered
where kind in ('new release', 'yank release', 'unyank release', 'file')
""")
def refresh_triggers(spark, sf):
    ev = C.refresh_triggers(enriched(spark, sf), feed_block(spark))
    return (ev.where(F.col("kind").isin(*C.REFRESH_KINDS, "file"))
              .select("serial", "project", "version", "kind", "skipped", "triggers"))


@register("project_incarnations", Q.feed_ctes(Q.INCARNATIONS) + """
select project, inc as incarnation, open_serial, opened_by, open_ts, close_serial, close_ts,
  close_serial is null as live from inc
""")
def project_incarnations(spark, sf):
    return incarnations(spark, sf)


_RELEASES = Q.fold_sql("rel", """(
  select project, version, serial, ts_s, kind, 'O' as etype from refreshed where refresh and not skipped
  union all
  select project, version, serial, ts_s, kind, 'C' from refreshed where kind = 'remove release'
  union all
  select r.project, v.version, r.serial, r.ts_s, r.kind, 'C' from refreshed r
  join (select distinct project, version from refreshed where refresh and not skipped) v on r.project = v.project
  where r.kind = 'remove project')""", "project, version")


@register("release_state", Q.feed_ctes(_RELEASES) + """
select project, version, inc as release_incarnation, open_serial, opened_by, close_serial, closed_by,
  close_serial is null as live from rel
""")
def release_state(spark, sf):
    return C.release_state(events(spark, sf), feed_block(spark))


_ROLES = """
ops as (
  select project, serial, unnest(case
    when kind in ('add_owner', 'accepted_owner') then [{'role': 'owners', 'usr': owner, 'sign': 1}]
    when kind = 'remove_owner' then [{'role': 'owners', 'usr': owner, 'sign': -1}]
    when kind = 'change_owner' then [{'role': 'owners', 'usr': owner, 'sign': -1}, {'role': 'maintainers', 'usr': owner, 'sign': 1}]
    when kind in ('add_maintainer', 'accepted_maintainer') then [{'role': 'maintainers', 'usr': maintainer, 'sign': 1}]
    when kind = 'remove_maintainer' then [{'role': 'maintainers', 'usr': maintainer, 'sign': -1}]
    when kind = 'change_maintainer' then [{'role': 'maintainers', 'usr': maintainer, 'sign': -1}, {'role': 'owners', 'usr': maintainer, 'sign': 1}]
    end) as o
  from refreshed),
marks as (
  select project, serial, null as o, cast(null as bigint) as marker from ops
  union all select project, open_serial, null, inc from inc
  union all select project, close_serial, null, -1 from inc where close_serial is not null),
tagged as (
  select project, serial, o, last_value(marker ignore nulls) over (partition by project order by serial
    rows between unbounded preceding and 1 preceding) as live_inc
  from (select project, serial, o, null as marker from ops
        union all select project, serial, null, marker from marks where marker is not null)),
rev as (select project, live_inc as incarnation, serial, o.role as role, o.usr as usr, o.sign as sign
  from tagged where o is not null and live_inc > 0),
lp as (select project, incarnation, role, usr, max(case when sign < 0 then serial end) as last_pull
  from rev group by all)"""


@register("project_roles", Q.feed_ctes(Q.INCARNATIONS, _ROLES) + """
select distinct r.project, r.incarnation, r.role, r.usr as user
from rev r join lp using (project, incarnation, role, usr)
where r.sign > 0 and (lp.last_pull is null or r.serial > lp.last_pull)
""")
def project_roles(spark, sf):
    ev = events(spark, sf)
    return C.project_roles(ev, incarnations(spark, sf, ev), feed_block(spark))


@register("project_last_serial", T.with_ctes("""
select project, max(serial) as last_serial from changelog group by project
""", "changelog"))
def project_last_serial(spark, sf):
    """Last serial per project."""
    return T.derived(spark, sf, "changelog").groupBy("project").agg(F.max("serial").alias("last_serial"))


# Local high-water mark: the mid serial of the feed stands for the mark stored
# by the previous run; the remote mark is the feed maximum.
_HWM_SQL = "(select (min(serial) + max(serial)) // 2 from changelog)"


def _hwm(cl):
    return cl.agg(((F.min("serial") + F.max("serial")) / 2).cast("long").alias("hwm"))


@register("incremental_scan", T.with_ctes(f"""
select serial, project, version, action from changelog
where serial > {_HWM_SQL} and {_HWM_SQL} < (select max(serial) from changelog)
""", "changelog"))
def incremental_scan(spark, sf):
    """Feed rows after the local mark, only when local < remote."""
    cl = T.derived(spark, sf, "changelog")
    marks = _hwm(cl).crossJoin(cl.agg(F.max("serial").alias("remote")))  # one row x one row
    return (cl.join(F.broadcast(marks), (cl.serial > marks.hwm) & (marks.hwm < marks.remote))
              .select("serial", "project", "version", "action"))


@register("latest_serial", T.with_ctes(f"""
select max(serial) as latest_serial, {_HWM_SQL} as local_serial,
  {_HWM_SQL} < max(serial) as needs_update from changelog
""", "changelog"))
def latest_serial(spark, sf):
    """Remote mark vs local mark."""
    cl = T.derived(spark, sf, "changelog")
    return cl.agg(F.max("serial").alias("latest_serial"),
                  ((F.min("serial") + F.max("serial")) / 2).cast("long").alias("local_serial")) \
             .withColumn("needs_update", F.col("local_serial") < F.col("latest_serial"))


_MERGE_SQL = T.with_ctes(f"""
, tgt as (
  select project as name, max_by(version, serial) as info_version, max(serial) as last_serial, true as analyzed,
    coalesce(max_by(action = 'remove project', case when action in ('create', 'remove project') then serial end), false) as remove
  from changelog where serial <= {_HWM_SQL} group by project),
newest as (select project as name, max_by(version, serial) as n_version, max(serial) as n_serial
  from changelog where serial > {_HWM_SQL} group by project),
live as (select * from tgt where not remove)
select coalesce(l.name, n.name) as name, coalesce(n.n_version, l.info_version) as info_version,
  coalesce(n.n_serial, l.last_serial) as last_serial,
  case when n.name is null then l.analyzed when l.name is null then false
       else l.analyzed and l.info_version is not distinct from n.n_version end as analyzed,
  false as remove
from live l full outer join newest n on l.name = n.name
union all select name, info_version, last_serial, analyzed, remove from tgt where remove
""", "changelog")


@register("project_merge", _MERGE_SQL)
def project_merge(spark, sf):
    """Merge the newest metadata after the mark into the state at the mark."""
    cl = T.derived(spark, sf, "changelog")
    h = F.broadcast(_hwm(cl))  # one row
    before = cl.join(h, cl.serial <= h.hwm)
    after = cl.join(h, cl.serial > h.hwm)
    is_oc = F.col("action").isin("create", "remove project")
    target = before.groupBy(F.col("project").alias("name")).agg(
        F.max_by("version", "serial").alias("info_version"),
        F.max("serial").alias("last_serial"),
        F.lit(True).alias("analyzed"),
        F.coalesce(F.max_by(F.col("action") == "remove project", F.when(is_oc, F.col("serial"))),
                   F.lit(False)).alias("remove"),
    )
    incoming = after.select(F.col("project").alias("name"), F.col("version").alias("info_version"),
                            F.col("serial").alias("last_serial"), "serial")
    return C.project_merge(target, incoming)


@register("feed_name_reuse", Q.feed_ctes(Q.INCARNATIONS) + """
select r.serial, r.project from refreshed r
where r.kind = 'create' and r.project_found
  and exists (select 1 from inc i where i.project = r.project and i.close_serial < r.serial)
""")
def feed_name_reuse(spark, sf):
    """J5 / S21 on the feed: creates of a name whose earlier incarnation was
    removed: a project's first removal, joined on the project, is before."""
    ev = events(spark, sf)
    gone = incarnations(spark, sf, ev).groupBy("project").agg(F.min("close_serial").alias("first_gone"))
    creates = ev.where((F.col("kind") == "create") & F.col("project_found")).select("serial", "project")
    return creates.join(gone, "project").where(F.col("first_gone") < F.col("serial")).select("serial", "project")
