"""Name-scoring queries: J1-J6 and the flagship A1 roll-up."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables as T
from ..operators import signals as S
from ..operators.common import checkpoint_cut
from .registry import register

_INPUTS = ("popular", "candidates", "aliases", "removed_projects", "private")


def _names(spark, sf):
    c = T.derived(spark, sf, "candidates")
    return c.select(F.col("c_custkey").alias("nid"), F.col("project").alias("name"))


def _pop(spark, sf):
    p = T.derived(spark, sf, "popular")
    return p.select(F.col("project").alias("pname"), F.col("download_count").cast("long").alias("download_count"))


def _pairs_out(df, score, msg_col):
    return df.select(
        F.col("nid").alias("c_custkey"),
        F.col("name").alias("project"),
        F.col("pname").alias("popular_project"),
        F.lit(score).alias("score"),
        msg_col.alias("message"),
    )


# --- flagship ---------------------------------------------------------------

_SUSPICION_SQL = T.with_ctes(
    """
, sig as (
  select c.c_custkey, 0 as grp, -p.download_count as neg_dc, p.project as pname, 0 as sub, 4 as score,
    'Popular Project: popular project ' || c.project || ' downloaded ' || cast(p.download_count as varchar) || ' times' as msg
  from candidates c join popular p on c.project = p.project
  union all
  select c.c_custkey, 0, -p.download_count, p.project, 1, 7,
    'Typosquatting: suspected to be typosquatting of project ' || p.project
  from candidates c join popular p on levenshtein(c.project, p.project) between 1 and 1
  union all
  select c.c_custkey, 0, -p.download_count, p.project, 2, 7,
    'Typosquatting: suspected to be typosquatting of project ' || p.project
  from candidates c join popular p on length(c.project) = length(p.project)
    and list_sort(string_split(c.project, '')) = list_sort(string_split(p.project, ''))
    and hamming(c.project, p.project) = 2
  union all
  select c.c_custkey, 1, 0, '', 0, 10,
    'Import-Name Hijacking: project name is same as the import name of popular project ' || a.owner
  from candidates c join (select import_name, min(name) as owner from aliases where import_name <> name group by 1) a
    on c.project = a.import_name
  union all
  select c.c_custkey, 2, 0, '', 0, 10,
    'Project Use-After-Free: creating project with name ' || c.project || ', a project with the same name was removed before'
  from candidates c where c.project in (select name from removed_projects)
  union all
  select c.c_custkey, 3, 0, '', 0, 10, 'Dependency Confusion: a project with the same name exists in private sources'
  from candidates c where c.project in (select name from private)
)
select c.c_custkey, c.project, coalesce(max(s.score), 0) as suspicion, count(s.score) as n_signals,
  coalesce(string_agg(s.msg, chr(10) order by s.grp, s.neg_dc, s.pname, s.sub), '') as suspicion_info
from candidates c left join sig s on s.c_custkey = c.c_custkey
group by c.c_custkey, c.project
""",
    *_INPUTS,
)


def project_suspicion(spark, sf):
    # the candidate names feed four inputs: derive them once, as a written table
    c = checkpoint_cut(T.derived(spark, sf, "candidates"))
    out = S.project_suspicion(
        c,
        T.derived(spark, sf, "popular"),
        aliases=T.derived(spark, sf, "aliases", candidates=c),
        removed=T.derived(spark, sf, "removed_projects", candidates=c),
        private=T.derived(spark, sf, "private", candidates=c),
    )
    return out.withColumn("suspicion_info", F.array_join("suspicion_info", "\n"))


register("project_suspicion", _SUSPICION_SQL)(project_suspicion)


# --- single signals ---------------------------------------------------------

@register("signal_popular", T.with_ctes("""
select c.c_custkey, c.project, p.project as popular_project, 4 as score,
  'Popular Project: popular project ' || c.project || ' downloaded ' || cast(p.download_count as varchar) || ' times' as message
from candidates c join popular p on c.project = p.project
""", "popular", "candidates"))
def signal_popular(spark, sf):
    return S.popular_exact(_names(spark, sf), _pop(spark, sf)).select(
        F.col("nid").alias("c_custkey"), F.col("name").alias("project"),
        F.col("sig.pname").alias("popular_project"), F.col("score"), F.col("sig.msg").alias("message"))


@register("signal_levenshtein", T.with_ctes("""
select c.c_custkey, c.project, p.project as popular_project, 7 as score,
  'Typosquatting: suspected to be typosquatting of project ' || p.project as message
from candidates c join popular p on levenshtein(c.project, p.project) between 1 and 1
""", "popular", "candidates"))
def signal_levenshtein(spark, sf):
    pairs = S.levenshtein_pairs(_names(spark, sf), _pop(spark, sf), 1)
    return _pairs_out(pairs, S.SCORE_TYPOSQUAT, S._template(S.MSG_TYPOSQUAT, q=F.col("pname")))


@register("signal_swap", T.with_ctes("""
select c.c_custkey, c.project, p.project as popular_project, 7 as score,
  'Typosquatting: suspected to be typosquatting of project ' || p.project as message
from candidates c join popular p on length(c.project) = length(p.project)
  and list_sort(string_split(c.project, '')) = list_sort(string_split(p.project, ''))
  and hamming(c.project, p.project) = 2
""", "popular", "candidates"))
def signal_swap(spark, sf):
    pairs = S.swap_pairs(_names(spark, sf), _pop(spark, sf))
    return _pairs_out(pairs, S.SCORE_TYPOSQUAT, S._template(S.MSG_TYPOSQUAT, q=F.col("pname")))


@register("signal_import_hijack", T.with_ctes("""
select c.c_custkey, c.project, a.owner as owner_project, 10 as score,
  'Import-Name Hijacking: project name is same as the import name of popular project ' || a.owner as message
from candidates c join (select import_name, min(name) as owner from aliases where import_name <> name group by 1) a
  on c.project = a.import_name
""", "candidates", "aliases"))
def signal_import_hijack(spark, sf):
    df = S.import_hijack(_names(spark, sf), T.derived(spark, sf, "aliases"))
    return df.select(F.col("nid").alias("c_custkey"), F.col("name").alias("project"),
                     F.regexp_extract("sig.msg", r"popular project (\S+)$", 1).alias("owner_project"),
                     "score", F.col("sig.msg").alias("message"))


@register("signal_name_reuse", T.with_ctes("""
select c.c_custkey, c.project, 10 as score,
  'Project Use-After-Free: creating project with name ' || c.project || ', a project with the same name was removed before' as message
from candidates c where c.project in (select name from removed_projects)
""", "candidates", "removed_projects"))
def signal_name_reuse(spark, sf):
    df = S.name_reuse(_names(spark, sf), T.derived(spark, sf, "removed_projects"))
    return df.select(F.col("nid").alias("c_custkey"), F.col("name").alias("project"), "score",
                     F.col("sig.msg").alias("message"))


@register("signal_dep_confusion", T.with_ctes("""
select c.c_custkey, c.project, 10 as score,
  'Dependency Confusion: a project with the same name exists in private sources' as message
from candidates c where c.project in (select name from private)
""", "candidates", "private"))
def signal_dep_confusion(spark, sf):
    df = S.dependency_confusion(_names(spark, sf), T.derived(spark, sf, "private"))
    return df.select(F.col("nid").alias("c_custkey"), F.col("name").alias("project"), "score",
                     F.col("sig.msg").alias("message"))


# --- larger fuzzy input: words of whole documents ---------------------------

# A word is popular if at least one word in POPULAR_SHARE is this one, so there
# are never more than POPULAR_SHARE popular words, whatever the corpus.
POPULAR_SHARE = 1000


@register("word_typosquat", f"""
with cnt as (select lower(m) as word, count(*) as n from documents, unnest(regexp_extract_all(text, '\\p{{L}}+', 0)) as u(m)
        group by 1),
top as (select word as pname from cnt where n * {POPULAR_SHARE} >= (select sum(n) from cnt))
select w.word as name, t.pname as popular_name from cnt w join top t on abs(length(w.word) - length(t.pname)) <= 1 and w.word <> t.pname
 and len(list_filter(range(1, greatest(length(w.word), length(t.pname)) + 1), lambda i: case
  when length(w.word) > length(t.pname) then substr(w.word, 1, (i - 1)::int) || substr(w.word, (i + 1)::int) = t.pname
  when length(w.word) < length(t.pname) then substr(t.pname, 1, (i - 1)::int) || substr(t.pname, (i + 1)::int) = w.word
  else substr(w.word, 1, (i - 1)::int) = substr(t.pname, 1, (i - 1)::int) and substr(w.word, (i + 1)::int) = substr(t.pname, (i + 1)::int)
  end)) > 0
""")  # DuckDB's own distance counts bytes
def word_typosquat(spark, sf):
    """J2 at scale: every distinct word (run of letters of any script) of all documents
    against the popular words, blocked by deletion keys -- no cross join."""
    toks = T.read(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), 0)).alias("m"))
    # read three times (all names, their sum, popular words): written once
    counts = checkpoint_cut(toks.groupBy(F.lower("m").alias("word")).agg(F.count("*").alias("download_count")))
    whole = counts.agg(F.sum("download_count").alias("whole"))
    popular = counts.join(F.broadcast(whole)).where(F.col("download_count") * POPULAR_SHARE >= F.col("whole")).select(  # one row
        F.col("word").alias("pname"), "download_count")
    names = counts.select(F.col("word").alias("nid"), F.col("word").alias("name"))
    pairs = S.levenshtein_pairs(names, popular, 1)
    return pairs.select(F.col("name"), F.col("pname").alias("popular_name"))


@register("lookup_semi", T.with_ctes("""
select c.c_custkey, c.project,
  c.project in (select name from removed_projects) as removed,
  c.project in (select name from private) as private,
  c.project in (select import_name from aliases) as import_name
from candidates c
""", "candidates", "removed_projects", "private", "aliases"))
def lookup_semi(spark, sf):
    """Batched keyed lookups of a name batch -- removed incarnation,
    private package, import name of another project -- as one left join on
    a per-name reduced fact table (never one lookup per row)."""
    c = T.derived(spark, sf, "candidates")
    facts = (T.derived(spark, sf, "removed_projects").select("name", F.lit(1).alias("f"))
             .unionByName(T.derived(spark, sf, "private").select("name", F.lit(2).alias("f")))
             .unionByName(T.derived(spark, sf, "aliases").select(F.col("import_name").alias("name"), F.lit(4).alias("f"))))
    flags = facts.groupBy("name").agg(F.bit_or("f").alias("bits"))
    j = c.join(flags, c.project == flags.name, "left").withColumn("bits", F.coalesce("bits", F.lit(0)))
    return j.select("c_custkey", "project", ((F.col("bits") % 2) == 1).alias("removed"),
                    (F.floor(F.col("bits") / 2) % 2 == 1).alias("private"),
                    (F.floor(F.col("bits") / 4) % 2 == 1).alias("import_name"))


_INIT_SQL = T.with_ctes("""
, docs as (
  select o_orderkey, json_extract_string(body, '$.name') as name,
    cast(json_extract(body, '$."_last-serial"') as bigint) as last_serial
  from simple_json where json_extract_string(body, '$.message') is distinct from 'Not Found'),
sig as (
  select d.o_orderkey, 4 as score from docs d join popular p on d.name = p.project
  union all select d.o_orderkey, 7 from docs d join popular p on levenshtein(d.name, p.project) between 1 and 1
  union all select d.o_orderkey, 7 from docs d join popular p on length(d.name) = length(p.project)
    and list_sort(string_split(d.name, '')) = list_sort(string_split(p.project, '')) and hamming(d.name, p.project) = 2)
select d.o_orderkey, d.name, d.last_serial, 0 as n_owners, 0 as n_maintainers, false as remove,
  cast(null as bigint) as remove_serial, coalesce(max(s.score), 0) as suspicion, count(s.score) as n_info,
  false as analyzed
from docs d left join sig s on s.o_orderkey = d.o_orderkey
group by d.o_orderkey, d.name, d.last_serial
""", "simple_json", "popular")


@register("project_init", _INIT_SQL)
def project_init(spark, sf):
    """P1 + P2: metadata document -> project row: the deprecated release list
    is dropped and the state columns are added with their defaults plus the
    name's suspicion (popular-list signals)."""
    from ..sources import index as I

    d = I.parse_json_body(T.derived(spark, sf, "simple_json"))
    docs = d.select("o_orderkey", F.col("doc.name").alias("name"), F.col("doc.`_last-serial`").alias("last_serial"),
                    "doc").withColumn("doc", F.col("doc").dropFields("versions", "files"))  # P1
    scored = S.project_suspicion(docs, T.derived(spark, sf, "popular"), id_col="o_orderkey", name_col="name")
    out = docs.join(scored.select("o_orderkey", "suspicion", "n_signals"), "o_orderkey")
    return out.select(  # P2: state columns with defaults
        "o_orderkey", "name", "last_serial",
        F.size(F.array().cast("array<string>")).alias("n_owners"),
        F.size(F.array().cast("array<string>")).alias("n_maintainers"),
        F.lit(False).alias("remove"), F.lit(None).cast("long").alias("remove_serial"),
        "suspicion", F.col("n_signals").alias("n_info"), F.lit(False).alias("analyzed"))
