"""Metadata queries: S3-S5, S15, S19, S21, P1, P2, F12 on nested documents."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables as T
from ..functions.actions import epoch_to_ts
from ..operators import signals as S
from ..sources import index as I
from ..sources import metadata as M
from . import changelog as CL
from . import feedsql as Q
from .registry import register

_META = T.with_ctes("""
, meta as (select o_orderkey, json_extract_string(body, '$.info.name') as name,
  json_extract_string(body, '$.info.version') as version, json_extract_string(body, '$.info.summary') as summary,
  cast(json_extract(body, '$.last_serial') as bigint) as last_serial,
  cast(json_array_length(body, '$.urls') as bigint) as n_urls,
  cast(json_array_length(body, '$.vulnerabilities') as bigint) as n_vulnerabilities,
  json_extract_string(body, '$.vulnerabilities[0].id') as first_vulnerability,
  json_extract_string(body, '$.urls[0].filename') as first_file,
  json_extract_string(body, '$.urls[1].digests.sha256') as second_sha256, body
  from metadata_docs where json_extract_string(body, '$.message') is distinct from 'Not Found')
""", "metadata_docs")


def meta(spark, sf):
    return M.parse_metadata(T.derived(spark, sf, "metadata_docs"))


def _flat():
    return [F.col("info.name").alias("name"), F.col("info.version").alias("version"), F.col("info.summary").alias("summary"),
            "last_serial", F.size("urls").cast("long").alias("n_urls"),
            F.size("vulnerabilities").cast("long").alias("n_vulnerabilities"),
            F.get("vulnerabilities", F.lit(0))["id"].alias("first_vulnerability"),
            F.get("urls", F.lit(0))["filename"].alias("first_file"),
            F.get("urls", F.lit(1))["digests"]["sha256"].alias("second_sha256")]


_FLAT = "name, version, summary, last_serial, n_urls, n_vulnerabilities, first_vulnerability, first_file, second_sha256"


@register("project_metadata", _META + f"select o_orderkey, {_FLAT} from meta")
def project_metadata(spark, sf):
    """Nested metadata documents -> columns."""
    return meta(spark, sf).select("o_orderkey", *_flat())


@register("release_urls", _META + """
select o_orderkey, cast(u.pos - 1 as integer) as pos, json_extract_string(u.x, '$.filename') as filename,
  json_extract_string(u.x, '$.url') as url, json_extract_string(u.x, '$.digests.md5') as md5,
  json_extract_string(u.x, '$.digests.sha256') as sha256, json_extract_string(u.x, '$.md5_digest') as md5_digest
from meta, unnest(cast(json_extract(body, '$.urls') as json[])) with ordinality as u(x, pos)
""")
def release_urls(spark, sf):
    """The files of a release document."""
    u = meta(spark, sf).select("o_orderkey", F.posexplode("urls").alias("pos", "u"))
    return u.select("o_orderkey", "pos", "u.filename", "u.url", F.col("u.digests")["md5"].alias("md5"),
                    F.col("u.digests")["sha256"].alias("sha256"), "u.md5_digest")


@register("simple_files", T.with_ctes("""
select o_orderkey, json_extract_string(body, '$.name') as name, cast(f.pos - 1 as integer) as pos,
  json_extract_string(f.x, '$.filename') as filename, json_extract_string(f.x, '$.url') as url,
  json_extract_string(f.x, '$.hashes.sha256') as sha256, json_extract_string(f.x, '$."requires-python"') as requires_python,
  cast(json_extract(f.x, '$.size') as bigint) as size, cast(json_extract(f.x, '$.yanked') as boolean) as yanked
from simple_files, unnest(cast(json_extract(body, '$.files') as json[])) with ordinality as f(x, pos)
""", "simple_files"))
def simple_files(spark, sf):
    """The file rows of the JSON simple index."""
    d = I.parse_json_body(T.derived(spark, sf, "simple_files"))
    f = d.select("o_orderkey", F.col("doc.name").alias("name"), F.posexplode("doc.files").alias("pos", "f"))
    return f.select("o_orderkey", "name", "pos", "f.filename", "f.url", F.col("f.hashes")["sha256"].alias("sha256"),
                    F.col("f.`requires-python`").alias("requires_python"), "f.size", "f.yanked")


_REMOVAL = "false as remove, cast(null as bigint) as remove_serial, cast(null as varchar) as remove_time, cast(null as bigint) as remove_timestamp"


def _signals(spark, sf, d):
    """``d`` with (score, signals): its name's signals against the popular list, worked out once per name."""
    names = d.select(F.col("info.name").alias("project")).distinct().withColumn("nid", F.col("project"))
    scored = S.project_suspicion(names, T.derived(spark, sf, "feed_popular"), id_col="nid")
    scored = scored.select(F.col("nid").alias("scored_name"), F.col("suspicion").alias("score"), F.col("suspicion_info").alias("signals"))
    return d.join(scored, F.col("info.name") == F.col("scored_name")).drop("scored_name")


def _state():
    info = F.array_join(F.array_sort("suspicion_info"), "|")
    return [F.col("suspicion").cast("int").alias("suspicion"), F.size("suspicion_info").alias("n_info"), info.alias("info_text")]


_SCORED = T.with_ctes("""
, meta as (select o_orderkey, json_extract_string(body, '$.info.name') as name,
  json_extract_string(body, '$.info.version') as version, json_extract_string(body, '$.info.summary') as summary,
  cast(json_extract(body, '$.last_serial') as bigint) as last_serial,
  cast(json_array_length(body, '$.urls') as bigint) as n_urls,
  cast(json_array_length(body, '$.vulnerabilities') as bigint) as n_vulnerabilities,
  json_extract_string(body, '$.vulnerabilities[0].id') as first_vulnerability,
  json_extract_string(body, '$.urls[0].filename') as first_file,
  json_extract_string(body, '$.urls[1].digests.sha256') as second_sha256, body
  from metadata_docs where json_extract_string(body, '$.message') is distinct from 'Not Found'),
names as (select distinct name from meta),
sig as (
  select n.name, 4 as score, 'Popular Project: popular project ' || n.name || ' downloaded ' || cast(p.download_count as varchar) || ' times' as msg
  from names n join feed_popular p on n.name = p.project
  union all select n.name, 7, 'Typosquatting: suspected to be typosquatting of project ' || p.project
  from names n join feed_popular p on levenshtein(n.name, p.project) = 1
  union all select n.name, 7, 'Typosquatting: suspected to be typosquatting of project ' || p.project
  from names n join feed_popular p on length(n.name) = length(p.project)
    and list_sort(string_split(n.name, '')) = list_sort(string_split(p.project, '')) and hamming(n.name, p.project) = 2),
score as (select n.name, coalesce(max(score), 0) as suspicion, cast(count(score) as integer) as n_info,
  coalesce(string_agg(msg, '|' order by msg), '') as info_text from names n left join sig using (name) group by n.name)
""", "metadata_docs", "feed_popular")


@register("project_document", _SCORED + f"""
select o_orderkey, {_FLAT}, 0 as n_maintainers, 0 as n_owners, {_REMOVAL}, suspicion, n_info, info_text, false as analyzed,
  'o_orderkey,info,last_serial,urls,vulnerabilities,signals,maintainers,owners,remove,remove_serial,remove_time,remove_timestamp,suspicion,suspicion_info,analyzed' as fields
from meta join score using (name)
""")
def project_document(spark, sf):
    """P1 + P2: first save of a project's document: ``releases`` dropped, every
    state column with its default, the name's suspicion and its messages."""
    d = _signals(spark, sf, meta(spark, sf))
    d = M.init_project(d, F.col("score"), F.col("signals")).drop("score")
    fields = ",".join(c for c in d.columns)
    return d.select("o_orderkey", *_flat(), F.size("maintainers").alias("n_maintainers"), F.size("owners").alias("n_owners"),
                    "remove", "remove_serial", "remove_time", "remove_timestamp", *_state(), "analyzed", F.lit(fields).alias("fields"))


@register("release_document", _SCORED + f"""
select o_orderkey, {_FLAT}, {_REMOVAL}, suspicion, n_info, info_text, false as analyzed, 0 as n_analyzed from meta join score using (name)
""")
def release_document(spark, sf):
    """First save of a release's document: its project's suspicion and
    messages are handed on to it."""
    d = _signals(spark, sf, meta(spark, sf))
    d = M.init_release(d, F.col("score"), F.col("signals"))
    return d.select("o_orderkey", *_flat(), "remove", "remove_serial", "remove_time", "remove_timestamp", *_state(),
                    "analyzed", F.size("analyzed_files").alias("n_analyzed"))


_MARK = "(select (min(last_serial) + max(last_serial)) // 2 from meta)"


@register("metadata_merge", _META + f"""
, old as (select *, name like '%3' as remove, true as analyzed from meta where last_serial <= {_MARK}
  qualify row_number() over (partition by name order by last_serial desc) = 1),
new as (select * from meta where last_serial > {_MARK} and name not like '%1'
  qualify row_number() over (partition by name order by last_serial desc) = 1),
live as (select * from old where not remove)
select coalesce(n.name, l.name) as name, coalesce(n.version, l.version) as version, coalesce(n.summary, l.summary) as summary,
  coalesce(n.last_serial, l.last_serial) as last_serial, coalesce(n.n_urls, l.n_urls) as n_urls,
  coalesce(n.n_vulnerabilities, l.n_vulnerabilities) as n_vulnerabilities,
  case when n.name is null then l.first_vulnerability else n.first_vulnerability end as first_vulnerability,
  coalesce(n.first_file, l.first_file) as first_file, coalesce(n.second_sha256, l.second_sha256) as second_sha256,
  false as remove, case when n.name is null then l.analyzed else coalesce(l.analyzed, false) and n.version is not distinct from l.version end as analyzed
from live l full outer join new n on l.name = n.name
union all select {_FLAT}, remove, analyzed from old where remove
""")
def metadata_merge(spark, sf):
    """Documents after the mark merged into the project rows at the mark
    (names ending in 3 were removed, names ending in 1 get no new document)."""
    d = meta(spark, sf).withColumn("name", F.col("info.name"))
    mark = F.broadcast(d.agg(((F.min("last_serial") + F.max("last_serial")) / 2).cast("long").alias("mark")))  # one row
    fields = ["name", "info", "last_serial", "urls", "vulnerabilities"]
    old = d.join(mark, d.last_serial <= mark.mark).groupBy("name").agg(
        F.max_by(F.struct(*fields[1:]), "last_serial").alias("x")).select("name", "x.*")
    old = old.withColumn("remove", F.col("name").endswith("3")).withColumn("analyzed", F.lit(True))
    new = d.join(mark, d.last_serial > mark.mark).where(~F.col("name").endswith("1")).select(*fields)
    return M.merge_projects(old, new).select(*_flat(), "remove", "analyzed")


@register("lookup_keyed", T.with_ctes("""
select c.c_custkey, c.project, f.filename is not null as has_result, a.name is not null as has_alias,
  v.name is not null as has_alias_version
from candidates c
left join (select distinct replace(project, 'pkg', 'lib') || '.json' as filename from release_files) f
  on f.filename = concat('lib-', cast(c.c_custkey % 50 as varchar), '.json')
left join (select distinct name from aliases) a on a.name = concat('lib-', c.project)
left join (select distinct name, version from aliases) v
  on v.name = concat('lib-', c.project) and v.version = concat('1.', cast(c.c_custkey % 2 as varchar))
""", "candidates", "release_files", "aliases"))
def lookup_keyed(spark, sf):
    """Batched lookups of a result by file name, an alias by name and an
    alias by (name, version): each a left join on the distinct keys."""
    c = T.derived(spark, sf, "candidates")
    al = T.derived(spark, sf, "aliases")
    results = T.derived(spark, sf, "release_files").select(
        F.concat(F.replace("project", F.lit("pkg"), F.lit("lib")), F.lit(".json")).alias("filename")).distinct()
    d = c.select("c_custkey", "project", F.concat(F.lit("lib-"), (F.col("c_custkey") % 50).cast("string"), F.lit(".json"))
                 .alias("filename"), F.concat(F.lit("lib-"), "project").alias("name"),
                 F.concat(F.lit("1."), (F.col("c_custkey") % 2).cast("string")).alias("version"))
    d = d.join(results.withColumn("r", F.lit(True)), "filename", "left")
    d = d.join(al.select("name").distinct().withColumn("a", F.lit(True)), "name", "left")
    d = d.join(al.select("name", "version").distinct().withColumn("v", F.lit(True)), ["name", "version"], "left")
    return d.select("c_custkey", "project", F.col("r").isNotNull().alias("has_result"), F.col("a").isNotNull().alias("has_alias"),
                    F.col("v").isNotNull().alias("has_alias_version"))


@register("known_bad_join", T.with_ctes("""
, bad as (select distinct unnest(regexp_extract_all(html, '(?is)<li\\b[^>]*>(.*?)</li>', 1)) as project from bad_pages)
select s.o_orderkey, s.project, cast(a.pos - 1 as integer) as pos, a.t as file_name
from simple_html s join bad b on b.project = s.project,
  unnest(regexp_extract_all(s.body, '(?is)<a\\b[^>]*>(.*?)</a>', 1)) with ordinality as a(t, pos)
where s.content_type in ('application/vnd.pypi.simple.v1+html', 'text/html') and ends_with(a.t, '.tar.gz')
""", "bad_pages", "simple_html"))
def known_bad_join(spark, sf):
    """S14 + S15: the names of the known-bad list pages joined to the archive
    links of their release indexes."""
    bad = T.derived(spark, sf, "bad_pages").select(F.explode(I.li_texts("html")).alias("project")).distinct()
    h = T.derived(spark, sf, "simple_html").where(I.route_content("content_type") == "html").join(bad, "project", "left_semi")
    a = h.select("o_orderkey", "project", F.posexplode(I.anchor_texts("body")).alias("pos", "file_name"))
    return a.where(F.col("file_name").endswith(".tar.gz"))


@register("project_remove_time", Q.feed_ctes(Q.INCARNATIONS) + """
select project, inc as incarnation, close_serial, close_ts as remove_timestamp,
  strftime(make_timestamp(close_ts * 1000000), '%Y-%m-%d %H:%M:%S') as remove_time from inc where close_serial is not null
""")
def project_remove_time(spark, sf):
    """F12 + P2: removal time of closed incarnations, from epoch seconds."""
    inc = CL.incarnations(spark, sf).where(F.col("close_serial").isNotNull())
    return inc.select("project", "incarnation", "close_serial", F.col("close_ts").alias("remove_timestamp"),
                      F.date_format(epoch_to_ts("close_ts"), "yyyy-MM-dd HH:mm:ss").alias("remove_time"))
