"""File-level queries: P3, A4, W7, A8."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables as T
from ..operators import files as Fi
from ..sources.rules import load_file_rules
from ..taint.scanner import TEMPLATES
from .registry import register

# A rule set exercising every location x kind (the shipped default only
# matches file names).
EXTENDED_FILE_RULES = [
    ("file_name", "match", "setup.py"),
    ("file_name", "match", "__init__.py"),
    ("file_dir", "match", "/pkg3/core"),
    ("file_dir", "regex", "sub$"),
    ("file_path", "match", "/pkg12/mod62.py"),
    ("file_path", "regex", "^/pkg4[0-9]/core/mod"),
]


def _sql_pred(rules) -> str:
    cols = {"file_dir": "file_dir", "file_name": "file_name", "file_path": "(file_dir || '/' || file_name)"}
    terms = []
    for loc, kind, pat in rules:
        p = pat.replace("'", "''")
        terms.append(f"{cols[loc]} = '{p}'" if kind == "match" else f"regexp_matches({cols[loc]}, '{p}')")
    return "ends_with(file_name, '.py') and (" + " or ".join(terms or ["false"]) + ")"


def _selected(spark, sf, rules):
    s = T.derived(spark, sf, "source_files")
    return s.where(Fi.file_selected(F.col("file_dir"), F.col("file_name"), rules)).select(
        "doc_id", "file_dir", "file_name")


@register("file_selection", T.with_ctes(f"""
select doc_id, file_dir, file_name from source_files where {_sql_pred(load_file_rules())}
""", "source_files"))
def file_selection(spark, sf):
    """P3 with the shipped file rules."""
    return _selected(spark, sf, load_file_rules())


@register("file_selection_rules", T.with_ctes(f"""
select doc_id, file_dir, file_name from source_files where {_sql_pred(EXTENDED_FILE_RULES)}
""", "source_files"))
def file_selection_rules(spark, sf):
    """P3 with dir / name / path x match / regex rules."""
    return _selected(spark, sf, EXTENDED_FILE_RULES)


_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@register("effective_lines", T.with_ctes(f"""
select doc_id, cast(len(list_filter(regexp_split_to_array(text, chr(13) || chr(10) || '|' || chr(13) || '|' || chr(10)),
  lambda l: not regexp_matches(l, '^[' || {_BLANKS} || ']*(#|$)'))) as bigint) as lines
from source_files
""", "source_files"))
def effective_lines(spark, sf):
    """A4 over every document's whole text."""
    s = T.derived(spark, sf, "source_files")
    return s.select("doc_id", Fi.effective_lines(F.col("text")).alias("lines"))


_IMPORTS_SQL = """
, dirs as (select distinct 'pkg' || cast(doc_id % 50 as varchar) as package, file_dir as dir
           from source_files where file_name = '__init__.py'),
tops as (select package, dir, regexp_extract(dir, '([^/]*)$', 1) as import_name from dirs d
         where not exists (select 1 from dirs a where a.package = d.package and starts_with(d.dir, a.dir || '/')))
"""


def _import_names(spark, sf):
    s = T.derived(spark, sf, "source_files").withColumn(
        "package", F.concat(F.lit("pkg"), (F.col("doc_id") % 50).cast("string")))
    return Fi.import_names(s)


@register("import_names", T.with_ctes(_IMPORTS_SQL + "select package, dir, import_name from tops",
                                      "source_files"))
def import_names(spark, sf):
    """Topmost package directories per package."""
    return _import_names(spark, sf)


@register("alias_build", T.with_ctes(_IMPORTS_SQL + """
select distinct 'pkg-' || substr(package, 4) as name, '1.0' as version, import_name from tops
where import_name <> 'pkg-' || substr(package, 4)
""", "source_files"))
def alias_build(spark, sf):
    """Alias rows (import name differs from the project name)."""
    # the project of package ``pkgN`` is named ``pkg-N`` (its import name differs)
    n = _import_names(spark, sf).select(
        F.concat(F.lit("pkg-"), F.substring("package", 4, 100)).alias("project"), F.lit("1.0").alias("version"),
        "import_name")
    return Fi.alias_rows(n)


# --- S12: archives built from the corpus, then read back member by member ----

_ARCHIVE_NAME = ("concat('pkg', cast(doc_id % 50 as string), '-1.0-', cast(doc_id as string), "
                 "case when doc_id % 2 = 0 then '.tar.gz' else '-py3-none-any.whl' end)")


_N_TEMPLATES = len(TEMPLATES)


def _archive_lines_sql() -> str:
    from .taint import LINES

    vals = ", ".join(f"({t}, {n})" for t, n in enumerate(LINES))
    return f"(values {vals}) as v(t, lines)"


@register("archive_members", f"""
select d.doc_id, {_ARCHIVE_NAME} as archive,
  case when d.doc_id % 97 = 0 then null
       else concat('pkg', cast(d.doc_id % 50 as varchar), '/mod', cast(d.doc_id as varchar), '.py') end as member,
  case when d.doc_id % 97 = 0 then null else cast(v.lines as bigint) end as lines,
  d.doc_id % 97 = 0 as error
from documents d join {_archive_lines_sql()} on d.doc_id % {_N_TEMPLATES} = v.t
""")
def archive_members(spark, sf):
    """S12 + S13 over archives derived from the documents: each corpus file
    is packed (``.tar.gz`` for even ids, ``.whl`` for odd; every 97th archive
    truncated), then extracted member by member; unreadable archives give a
    quarantine row."""
    from ..session import ship_code
    from ..sources.archives import members_of, pack_archives
    from ..taint.scanner import code_corpus

    ship_code(spark)
    c = code_corpus(T.read(spark, sf, "documents")).withColumnRenamed("file_id", "doc_id")
    files = c.select(
        F.expr(_ARCHIVE_NAME).alias("archive"),
        F.concat(F.lit("pkg"), (F.col("doc_id") % 50).cast("string"), F.lit("/mod"), F.col("doc_id").cast("string"),
                 F.lit(".py")).alias("member"),
        "content", (F.col("doc_id") % 97 == 0).alias("corrupt"))
    m = members_of(pack_archives(files))
    return m.select(
        F.regexp_extract("archive", r"-([0-9]+)(?:\.tar\.gz|-py3-none-any\.whl)$", 1).cast("long").alias("doc_id"),
        "archive", "member",
        F.when(F.col("error").isNull(), Fi.effective_lines(F.col("content").cast("string"))).alias("lines"),
        F.col("error").isNotNull().alias("error"))
