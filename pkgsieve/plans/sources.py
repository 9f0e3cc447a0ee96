"""Source queries: S3-S9, S14, S15 over the driver's tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables as T
from ..functions import actions as A
from ..sources import index as I
from ..sources.html import elements
from .registry import register

# Mirror base for known-bad archive links (a parameter; downloads not built).
MIRROR_BASE = "https://mirror.example/pypi/web/"

_DUCK_TEXT = ("replace(replace(replace(replace(replace(regexp_replace(@X@, '<[^>]*>', '', 'g'), "
              "'&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')")


def _duck_text(expr: str) -> str:
    return _DUCK_TEXT.replace("@X@", expr)


@register("json_metadata", T.with_ctes("""
select o_orderkey, json_extract_string(body, '$.name') as name,
  cast(json_extract(body, '$."_last-serial"') as bigint) as last_serial,
  cast(json_array_length(body, '$.versions') as bigint) as n_versions
from simple_json where json_extract_string(body, '$.message') is distinct from 'Not Found'
""", "simple_json"))
def json_metadata(spark, sf):
    """Metadata JSON -> one row per found document."""
    d = I.parse_json_body(T.derived(spark, sf, "simple_json"))
    return d.select("o_orderkey", F.col("doc.name").alias("name"), F.col("doc.`_last-serial`").alias("last_serial"),
                    F.size("doc.versions").cast("long").alias("n_versions"))


@register("simple_json", T.with_ctes("""
select o_orderkey, json_extract_string(body, '$.name') as name, v.version, v.pos
from simple_json, unnest(cast(json_extract(body, '$.versions') as varchar[])) with ordinality as v(version, pos)
where json_extract_string(body, '$.message') is distinct from 'Not Found'
""".replace("v.pos", "cast(v.pos - 1 as integer) as pos"), "simple_json"))
def simple_json(spark, sf):
    """Simple index JSON -> (name, version) rows."""
    d = I.parse_json_body(T.derived(spark, sf, "simple_json"))
    return d.select("o_orderkey", F.col("doc.name").alias("name"),
                    F.posexplode("doc.versions").alias("pos", "version"))


@register("html_anchor_text", f"""
select page_id, cast(pos - 1 as integer) as pos, {_duck_text('t')} as text
from pages, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*>(.*?)</a>', 1)) with ordinality as a(t, pos)
""")
def html_anchor_text(spark, sf):
    """Text of every anchor of every page."""
    p = T.read(spark, sf, "pages")
    return p.select("page_id", F.posexplode(I.anchor_texts("html")).alias("pos", "text"))


# Pages that a regular expression misreads, in front of the given ones: each
# with the (href, text) of its anchors and the texts of its list items.
HARD_PAGES = [
    ('<a title="a > b" href="x">one</a><!-- <a href="no">gone</a> --><a>two</a>', [("x", "one"), (None, "two")], []),
    ("<p><a href=y>caf&eacute; &#x41;&#66; &amp;lt; &lt;</p>after<A HREF='z'>b<b>o</b>ld<br/></A>",
     [("y", "café AB &lt; <"), ("z", "bold")], []),
    ("<ul><li>pkg-1<li>pkg-<i>2</i><ul><li>in</ul> out</ul><a href=a>x<script>if (a < b) '</a>'</script>y</a>",
     [("a", "xy")], ["pkg-1", "pkg-2in out", "in"]),
    ("</a><abbr>not</abbr><a/><a href=\"q&amp;r\">1 &copy; 2</a></li><li>last</li>", [(None, ""), ("q&r", "1 © 2")], ["last"]),
]


def _sql_text(value):
    return "cast(null as varchar)" if value is None else "'" + value.replace("'", "''") + "'"


def _hard_values(kind):
    rows = [(t, k, *(x if kind == "a" else (None, x))) for t, (_, anchors, items) in enumerate(HARD_PAGES)
            for k, x in enumerate(anchors if kind == "a" else items)]
    return ", ".join(f"({t}, {k}, {_sql_text(h)}, {_sql_text(x)})" for t, k, h, x in rows)


def _hard_sql(kind):
    counts = ", ".join(f"({t}, {len(p[1] if kind == 'a' else p[2])})" for t, p in enumerate(HARD_PAGES))
    return f"""
select page_id, '{kind}' as tag, k as pos, href, text from pages join (values {_hard_values(kind)}) v(t, k, href, text) on page_id % {len(HARD_PAGES)} = t
union all
select page_id, '{kind}', cast(pos - 1 + n as integer), {"nullif(regexp_extract(a.o, 'href=\"([^\"]*)\"', 1), '')" if kind == "a" else "cast(null as varchar)"},
 {_duck_text("regexp_extract(a.o, '(?is)^<" + kind + "\\b[^>]*>(.*)</" + kind + ">$', 1)")}
from pages join (values {counts}) c(t, n) on page_id % {len(HARD_PAGES)} = c.t,
 unnest(regexp_extract_all(html, '(?is)<{kind}\\b[^>]*>.*?</{kind}>')) with ordinality as a(o, pos)
"""


@register("html_elements", _hard_sql("a") + " union all " + _hard_sql("li"))
def html_elements(spark, sf):
    """S6 + S14: anchors and list items of every page, each behind a page of
    comments, quoted ``>``, unclosed and nested tags and character references."""
    p = T.read(spark, sf, "pages").select("page_id", F.concat(F.element_at(
        F.array(*[F.lit(h) for h, _, _ in HARD_PAGES]), (F.col("page_id") % len(HARD_PAGES) + 1).cast("int")), F.col("html")).alias("html"))
    parts = [p.select("page_id", F.lit(tag).alias("tag"), F.posexplode(elements(F.col("html"), tag)).alias("pos", "e"))
             for tag in ("a", "li")]
    return parts[0].unionByName(parts[1]).select("page_id", "tag", "pos", "e.href", "e.text")


@register("html_li_text", f"""
select page_id, cast(pos - 1 as integer) as pos, {_duck_text('t')} as text
from pages, unnest(regexp_extract_all(html, '(?is)<li\\b[^>]*>(.*?)</li>', 1)) with ordinality as a(t, pos)
""")
def html_li_text(spark, sf):
    """Text of every list item (the known-bad list format)."""
    p = T.read(spark, sf, "pages")
    return p.select("page_id", F.posexplode(I.li_texts("html")).alias("pos", "text"))


@register("content_router", T.with_ctes("""
select 'json' as source, o_orderkey, content_type,
  case when content_type = 'application/vnd.pypi.simple.v1+json' then 'json'
       when content_type in ('application/vnd.pypi.simple.v1+html', 'text/html') then 'html' else 'reject' end as branch
from simple_json
union all
select 'html', o_orderkey, content_type,
  case when content_type = 'application/vnd.pypi.simple.v1+json' then 'json'
       when content_type in ('application/vnd.pypi.simple.v1+html', 'text/html') then 'html' else 'reject' end
from simple_html
""", "simple_json", "simple_html"))
def content_router(spark, sf):
    """Route index responses by exact content type (rejects kept)."""
    j = T.derived(spark, sf, "simple_json").select(F.lit("json").alias("source"), "o_orderkey", "content_type")
    h = T.derived(spark, sf, "simple_html").select(F.lit("html").alias("source"), "o_orderkey", "content_type")
    u = j.unionByName(h)
    return u.withColumn("branch", I.route_content("content_type"))


@register("html_release_versions", T.with_ctes(f"""
select o_orderkey, project, {_duck_text('t')} as filename,
  rtrim(ltrim(ltrim({_duck_text('t')}, project), '-'), '.tar.gz') as version
from simple_html, unnest(regexp_extract_all(body, '(?is)<a\\b[^>]*>(.*?)</a>', 1)) as a(t)
where content_type in ('application/vnd.pypi.simple.v1+html', 'text/html')
  and ends_with({_duck_text('t')}, '.tar.gz')
""", "simple_html"))
def html_release_versions(spark, sf):
    """Versions from the ``.tar.gz`` anchors of HTML release indexes
    (duplicates kept; F6 compat parse)."""
    h = T.derived(spark, sf, "simple_html").where(I.route_content("content_type") == "html")
    a = h.select("o_orderkey", "project", F.explode(I.anchor_texts("body")).alias("filename"))
    a = a.where(F.col("filename").endswith(".tar.gz"))
    return a.withColumn("version", A.version_from_filename("project", "filename"))


POPULAR_DOC = 500


@register("popular_rows", T.with_ctes("""
select last_update, project, download_count from monthly_popular
""", "monthly_popular"))
def popular_rows(spark, sf):
    """Popular snapshot JSON documents -> (last_update, project,
    download_count).  A month's list is published in documents of about
    ``POPULAR_DOC`` projects, so that one is small whatever the month; each is
    parsed with the declared schema."""
    monthly = T.derived(spark, sf, "monthly_popular")
    pages = monthly.groupBy("last_update").agg(F.ceil(F.count(F.lit(1)) / POPULAR_DOC).alias("pages"))
    page = F.pmod(F.xxhash64("project"), F.col("pages")).alias("page")
    docs = (monthly.join(pages, "last_update").groupBy("last_update", page)
            .agg(F.collect_list(F.struct("project", "download_count")).alias("rows"))  # one published document
            .select(F.to_json(F.struct("last_update", "rows")).alias("json")))
    parsed = docs.select(F.from_json("json", I.POPULAR_SCHEMA).alias("d"))
    return parsed.select("d.last_update", F.explode("d.rows").alias("r")).select(
        "last_update", "r.project", "r.download_count")


@register("known_bad_links", T.with_ctes(f"""
select project, file_name, '{MIRROR_BASE}' || ltrim(h, './') as url from (
  select project, h, {_duck_text('t')} as file_name from (
    select project,
      unnest(regexp_extract_all(body, '(?is)<a\\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1)) as h,
      unnest(regexp_extract_all(body, '(?is)<a\\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2)) as t
    from (select distinct project, body from simple_html
          where cast(substr(project, 5) as int) % 5 = 0
            and content_type in ('application/vnd.pypi.simple.v1+html', 'text/html')) b) x) y
where ends_with(file_name, '.tar.gz')
""", "simple_html"))
def known_bad_links(spark, sf):
    """``.tar.gz`` anchors (file name, mirror URL) from the release
    indexes of known-bad projects; the href prefix is stripped with
    character-set semantics."""
    h = T.derived(spark, sf, "simple_html")
    bad = (h.where((F.substring("project", 5, 100).cast("int") % 5 == 0)
                   & (I.route_content("content_type") == "html"))
            .select("project", "body").distinct())
    a = bad.select("project", F.explode(I.anchors_with_href("body")).alias("a"))
    a = a.where(F.col("a.text").endswith(".tar.gz"))
    return a.select("project", F.col("a.text").alias("file_name"),
                    F.concat(F.lit(MIRROR_BASE), F.ltrim(F.col("a.href"), F.lit("./"))).alias("url"))
