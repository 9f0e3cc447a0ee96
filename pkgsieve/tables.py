"""Base tables and the derived inputs the operators run on.

The driver's parquet tables are read lazily (column pruning and filter
pushdown reach the scan).  Registry-shaped inputs (change feed, popular list,
candidate names, release files, source files, index pages) are *derived*
from those tables with plain SQL, so that every query's work grows with the
scale factor.  Each derived text is written once with ``{table}``
placeholders: Spark binds DataFrames to them (``spark.sql(text, t=df)``) and
the DuckDB oracle binds plain view names, so both engines read the same
definition.
"""
from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------------------
# Derived inputs.  Fixed texts: they were run in both Spark SQL and DuckDB and
# return the same rows; keep them identical in both engines.
# ---------------------------------------------------------------------------

CHANGELOG = """
select serial, project, version, ts, case
 when event_type='signup' and k < 50 then 'create'
 when event_type='signup' then concat(case when k % 2 = 0 then 'accepted Owner u' else 'accepted Maintainer u' end, cast(k % 5 as varchar(9)))
 when event_type='purchase' and k % 2 = 0 then 'new release'
 when event_type='purchase' then concat('add source file ', project, '-', version, '.tar.gz')
 when event_type='view' and k % 3 = 0 then concat(case when k % 4 = 1 then 'remove file ' else 'add py3 file ' end, project, '-', version, '-py3-none-any.whl')
 when event_type='view' and k % 3 = 1 then concat('add Owner u', cast(k % 5 as varchar(9)))
 when event_type='view' then concat('add Maintainer u', cast(k % 5 as varchar(9)))
 when event_type='click' and k % 4 = 0 then concat('change Owner u', cast(k % 5 as varchar(9)), ' to Maintainer')
 when event_type='click' and k % 4 = 1 then concat(case when k % 8 = 1 then 'remove Owner u' else 'remove Maintainer u' end, cast(k % 5 as varchar(9)))
 when event_type='click' and k % 4 = 2 then concat(case when k % 8 = 2 then 'invite Owner u' else 'invite Maintainer u' end, cast(k % 5 as varchar(9)))
 when event_type='click' then case when k % 8 = 3 then 'yank release' else 'unyank release' end
 when k < 10 then 'remove project'
 when k < 40 then 'remove release'
 when k < 60 then concat('change Maintainer u', cast(k % 5 as varchar(9)), ' to Owner')
 else 'docs update' end as action
from (select event_id as serial, concat('pkg-', cast(user_id % 40 as varchar(9))) as project,
 concat('1.', cast(cast(regexp_extract(props, '([0-9]+)', 1) as int) % 4 as varchar(9))) as version,
 cast(regexp_extract(props, '([0-9]+)', 1) as int) as k, event_type, ts from {events}) e
"""

POPULAR = """
select replace(p_name, ' ', '-') as project, count(*) as download_count from {part} group by 1
"""

# A popular list of feed names, so that documents of the feed have signals.
FEED_POPULAR = """
select concat('pkg-', cast(o_custkey % 40 as varchar(9))) as project, count(*) as download_count from {orders}
where o_custkey % 40 in (3, 12, 27) group by 1
"""

CANDIDATES = """
select c_custkey, case c_custkey % 6
 when 0 then project when 1 then substr(project, 2) when 2 then concat(project, right(project, 1))
 when 3 then concat(right(project, 1), substr(project, 2, length(project) - 2), left(project, 1))
 when 4 then concat(left(project, 1), 'q', substr(project, 3))
 else concat('new-', project, cast(c_custkey as varchar(12))) end as project
from {customer} join (select project, row_number() over (order by project) - 1 as rn
 from (select distinct replace(p_name, ' ', '-') as project from {part}) d) p on rn = c_custkey % 64
"""

RELEASE_FILES = """
select concat('pkg-', cast(o_custkey % 40 as varchar(9))) as project,
 concat('1.', cast(o_orderkey % 4 as varchar(9))) as version, o_orderkey as last_serial, l_linenumber as idx,
 concat('pkg-', cast(o_custkey % 40 as varchar(9)), '-1.', cast(o_orderkey % 4 as varchar(9)), '-',
  cast(o_orderkey as varchar(12)), '-', cast(l_linenumber as varchar(9)),
  case when l_linenumber % 2 = 0 then '.whl' else '.tar.gz' end) as filename
from {orders} join {lineitem} on l_orderkey = o_orderkey
"""

SOURCE_FILES = """
select doc_id, concat('/pkg', cast(doc_id % 50 as varchar(9)), case when doc_id % 3 = 0 then '/core'
  when doc_id % 3 = 1 then '/core/sub' else '' end) as file_dir,
 case when doc_id % 4 = 0 then '__init__.py' when doc_id % 4 = 1 then 'setup.py'
  when doc_id % 4 = 2 then concat('mod', cast(doc_id as varchar(12)), '.py') else 'readme.md' end as file_name,
 text from {documents}
"""

POPULAR_SNAPSHOTS = """
select distinct concat(cast(extract(year from o_orderdate) as varchar(4)), '-',
 lpad(cast(extract(month from o_orderdate) as varchar(2)), 2, '0'), '-01 08:13:20') as last_update from {orders}
"""

MONTHLY_POPULAR = """
select concat(cast(extract(year from o_orderdate) as varchar(4)), '-',
 lpad(cast(extract(month from o_orderdate) as varchar(2)), 2, '0'), '-01 08:13:20') as last_update,
 replace(p_name, ' ', '-') as project, count(*) as download_count
from {orders} join {lineitem} on l_orderkey = o_orderkey join {part} on p_partkey = l_partkey group by 1, 2
"""

SIMPLE_HTML = """
select o_orderkey, concat('pkg-', cast(o_custkey % 40 as varchar(9))) as project,
 case o_orderkey % 3 when 0 then 'text/html' when 1 then 'application/vnd.pypi.simple.v1+html'
  else 'text/html; charset=UTF-8' end as content_type,
 concat('<html><body><a href="../../packages/pkg-', cast(o_custkey % 40 as varchar(9)), '-1.', cast(o_orderkey % 7 as varchar(9)),
  '.tar.gz">pkg-', cast(o_custkey % 40 as varchar(9)), '-1.', cast(o_orderkey % 7 as varchar(9)),
  '.tar.gz</a><a href="x">pkg-', cast(o_custkey % 40 as varchar(9)), '-1.', cast(o_orderkey % 7 as varchar(9)),
  '-py3-none-any.whl</a></body></html>') as body from {orders}
"""

SIMPLE_JSON = """
select o_orderkey, 'application/vnd.pypi.simple.v1+json' as content_type,
 case when o_orderkey % 10 = 9 then '{{"message":"Not Found"}}'
  else concat('{{"name":"pkg-', cast(o_custkey % 40 as varchar(9)), '","_last-serial":', cast(o_orderkey as varchar(12)),
   ',"versions":["1.0","1.', cast(o_orderkey % 7 as varchar(9)), '"]}}') end as body from {orders}
"""

# Metadata documents of projects and releases as the JSON API gives them: info,
# last serial, deprecated releases, two files with digests, vulnerabilities.
METADATA_DOCS = """
select o_orderkey, case when o_orderkey % 10 = 9 then '{{"message":"Not Found"}}' else concat(
 '{{"info":{{"name":"pkg-', cast(o_custkey % 40 as varchar(9)), '","version":"1.', cast(o_orderkey % 4 as varchar(9)),
 '","summary":"s ', cast(o_orderkey % 3 as varchar(9)), ' e"}},"last_serial":', cast(o_orderkey as varchar(12)),
 ',"releases":{{"1.0":[]}},"urls":[{{"filename":"pkg-', cast(o_custkey % 40 as varchar(9)), '-', cast(o_orderkey as varchar(12)),
 '.tar.gz","url":"https://files.example/t/', cast(o_orderkey as varchar(12)), '","digests":{{"md5":"a',
 cast(o_orderkey as varchar(12)), '","sha256":"b', cast(o_orderkey as varchar(12)), '"}},"md5_digest":"a', cast(o_orderkey as varchar(12)),
 '"}},{{"filename":"pkg-', cast(o_custkey % 40 as varchar(9)), '-', cast(o_orderkey as varchar(12)),
 '-py3-none-any.whl","url":"https://files.example/w/', cast(o_orderkey as varchar(12)), '","digests":{{"md5":"c',
 cast(o_orderkey as varchar(12)), '","sha256":"d', cast(o_orderkey as varchar(12)), '"}},"md5_digest":"c', cast(o_orderkey as varchar(12)),
 '"}}],"vulnerabilities":[', case when o_orderkey % 5 = 0 then concat('{{"id":"V-', cast(o_orderkey as varchar(12)), '"}}') else '' end,
 ']}}') end as body from {orders}
"""

SIMPLE_FILES = """
select o_orderkey, concat('{{"name":"pkg-', cast(o_custkey % 40 as varchar(9)), '","_last-serial":', cast(o_orderkey as varchar(12)),
 ',"versions":["1.0"],"files":[{{"filename":"a-', cast(o_orderkey as varchar(12)), '.tar.gz","url":"https://files.example/a",',
 '"hashes":{{"sha256":"e', cast(o_orderkey as varchar(12)), '"}},"requires-python":">=3.', cast(o_orderkey % 9 as varchar(9)),
 '","size":', cast(o_orderkey * 7 as varchar(12)), ',"yanked":', case when o_orderkey % 6 = 0 then 'true' else 'false' end,
 '}},{{"filename":"b.whl","url":"https://files.example/b","hashes":{{}},"size":1,"yanked":false}}]}}') as body from {orders}
"""

# Pages of the known-bad list: a list item per name.
BAD_PAGES = """
select o_orderkey, concat('<html><ul class="bad"><li>pkg-', cast(o_custkey % 40 as varchar(9)), '</li><li>gone-',
 cast(o_orderkey % 9 as varchar(9)), '</li></ul></html>') as html from {orders} where o_custkey % 5 = 0
"""

# Fixture subsets of the candidate names (FIXTURES §2): import-name aliases,
# removed incarnations, private packages, known-bad names.
ALIASES = """
select concat('lib-', project) as name, '1.0' as version, project as import_name
from {candidates} c where c_custkey % 11 = 0
"""

REMOVED_PROJECTS = """
select project as name, c_custkey as remove_serial from {candidates} c where c_custkey % 13 = 0
"""

PRIVATE = """
select project as name, '1.0' as version from {candidates} c where c_custkey % 17 = 0
"""

# Metadata snapshots the JSON API would return for feed projects / releases:
# a project is missing iff its number % 7 = 3; a release is missing iff its
# version is 1.2 and the project number % 5 = 1.
PROJECT_META = """
select project as name, max(version) as info_version, max(serial) as last_serial
from {changelog} c where cast(substr(project, 5) as int) % 7 <> 3 group by project
"""

RELEASE_META = """
select distinct project as name, version from {changelog} c
where not (version = '1.2' and cast(substr(project, 5) as int) % 5 = 1)
"""

DERIVED = {
    "changelog": (CHANGELOG, ("events",)),
    "popular": (POPULAR, ("part",)),
    "feed_popular": (FEED_POPULAR, ("orders",)),
    "candidates": (CANDIDATES, ("customer", "part")),
    "release_files": (RELEASE_FILES, ("orders", "lineitem")),
    "source_files": (SOURCE_FILES, ("documents",)),
    "popular_snapshots": (POPULAR_SNAPSHOTS, ("orders",)),
    "monthly_popular": (MONTHLY_POPULAR, ("orders", "lineitem", "part")),
    "simple_html": (SIMPLE_HTML, ("orders",)),
    "metadata_docs": (METADATA_DOCS, ("orders",)),
    "simple_files": (SIMPLE_FILES, ("orders",)),
    "bad_pages": (BAD_PAGES, ("orders",)),
    "simple_json": (SIMPLE_JSON, ("orders",)),
    "aliases": (ALIASES, ("candidates",)),
    "removed_projects": (REMOVED_PROJECTS, ("candidates",)),
    "private": (PRIVATE, ("candidates",)),
    "project_meta": (PROJECT_META, ("changelog",)),
    "release_meta": (RELEASE_META, ("changelog",)),
}


def derived(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """A derived input as a Spark DataFrame (lazy; nothing is collected).
    ``given`` supplies already-built inputs by name (e.g. a materialised
    ``candidates`` shared by several derived tables)."""
    if name in given:
        return given[name]
    text, deps = DERIVED[name]
    frames = {d: (derived(spark, sf_dir, d, **given) if d in DERIVED else read(spark, sf_dir, d)) for d in deps}
    return spark.sql(text, **frames)


@lru_cache(maxsize=None)
def duck(name: str) -> str:
    """The same derived input as a DuckDB sub-query text over plain views."""
    text, deps = DERIVED[name]
    return text.format(**{d: (f"({duck(d)})" if d in DERIVED else d) for d in deps})


def with_ctes(sql: str, *names: str) -> str:
    """Prefix a DuckDB query with the derived inputs it reads as CTEs."""
    return "with " + ",\n".join(f"{n} as ({duck(n)})" for n in names) + "\n" + sql
