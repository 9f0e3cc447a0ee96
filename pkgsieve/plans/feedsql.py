"""DuckDB oracle fragments for the change-feed queries.

These are the oracle side only (the Spark side is the DataFrame code in
``operators/changelog.py``); both derive from the same constants.
"""
from __future__ import annotations

from .. import tables as T
from ..functions import actions as A


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _re(p: str) -> str:
    # DuckDB (RE2) has no (?U); the fixture text is ASCII
    return _q(p.replace("(?U)", ""))


KIND_CASE = (
    "case when action = 'create' then 'create' when action = 'remove project' then 'remove project' "
    + " ".join(f"when starts_with(action, {_q(p)}) then {_q(k)}" for p, k in A.ROLE_KINDS)
    + " when action = 'new release' then 'new release'"
    + " when starts_with(action, 'yank release') then 'yank release'"
    + " when starts_with(action, 'unyank release') then 'unyank release'"
    + f" when regexp_matches(action, {_re(A.FILE_ACTION_RE)}) then 'file'"
    + " when action = 'remove release' then 'remove release' else 'other' end"
)

PARSED = f"""
parsed as (
  select serial, project, version, cast(floor(epoch(ts)) as bigint) as ts_s, action, {KIND_CASE} as kind,
    nullif(regexp_extract(action, {_re(A.FILE_ACTION_RE)}, 1), '') as filename,
    nullif(regexp_extract(action, {_re(A.OWNER_ACTION_RE)}, 1), '') as owner,
    nullif(regexp_extract(action, {_re(A.MAINTAINER_ACTION_RE)}, 1), '') as maintainer
  from changelog)"""

ENRICHED = """
enriched as (
  select p.*, pm.name is not null as project_found, rm.name is not null as release_found,
    (p.kind = 'create' and pm.name is null)
    or (p.kind in ('new release', 'yank release', 'unyank release', 'file') and (pm.name is null or rm.name is null)) as skipped
  from parsed p
  left join (select distinct name from project_meta) pm on p.project = pm.name
  left join (select distinct name, version from release_meta) rm on p.project = rm.name and p.version is not distinct from rm.version)"""

TRIGGERS = """
w1 as (
  select *, last_value(case when not skipped then {'p': project, 'v': version} end ignore nulls)
    over (order by serial rows between unbounded preceding and 1 preceding) as prev
  from enriched),
triggered as (
  select * exclude (prev),
    kind in ('new release', 'yank release', 'unyank release')
    or (kind = 'file' and (prev is null or not (prev.p is not distinct from project and prev.v is not distinct from version))) as triggers
  from w1),
refreshed as (select *, triggers and kind in ('new release', 'yank release', 'unyank release', 'file') as refresh from triggered)"""


def fold_sql(name: str, src: str, keys: str) -> str:
    """Open/close fold oracle over ``src`` (columns keys, serial, ts_s, kind, etype)."""
    return f"""
{name}_t as (
  select *, lag(etype) over (partition by {keys} order by serial) as prev_type from {src} where etype is not null),
{name}_e as (
  select *, etype = 'O' and (prev_type is null or prev_type = 'C') as eff_open,
    etype = 'C' and prev_type = 'O' as eff_close from {name}_t),
{name}_i as (
  select *, cast(sum(case when eff_open then 1 else 0 end) over (partition by {keys} order by serial
    rows between unbounded preceding and current row) as bigint) as inc from {name}_e),
{name} as (
  select o.*, c.close_serial, c.close_ts, c.closed_by from
   (select {keys}, inc, serial as open_serial, ts_s as open_ts, kind as opened_by from {name}_i where eff_open) o
   left join (select {keys}, inc, serial as close_serial, ts_s as close_ts, kind as closed_by from {name}_i where eff_close) c
   using ({keys}, inc))"""


def feed_ctes(*extra: str) -> str:
    """``with`` clause: derived inputs + parsed/enriched/refreshed feed + extras."""
    base = T.with_ctes("", "changelog", "project_meta", "release_meta").rstrip("\n")
    parts = [PARSED, ENRICHED, TRIGGERS, *extra]
    return base + ",\n" + ",\n".join(p.strip("\n") for p in parts) + "\n"


INCARNATIONS = fold_sql("inc", """(select project, serial, ts_s, kind,
    case when kind = 'create' and project_found then 'O' when refresh and project_found then 'O'
         when kind = 'remove project' then 'C' end as etype from refreshed)""", "project")
