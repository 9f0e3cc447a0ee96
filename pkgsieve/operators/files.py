"""File-level operators: selection (P3), effective lines (A4), import names
(W7), aliases (A8)."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A line counts unless it is blank or a comment after stripping the six ASCII
# blanks Python's bytes.strip() removes; lines split like bytes.splitlines().
LINE_BREAK_RE = r"\r\n|\r|\n"
NOT_CODE_RE = "^[ \\t\\n\\x0b\\x0c\\r]*(#|$)"


def file_selected(file_dir: Column, file_name: Column, rules: Iterable[tuple[str, str, str]]) -> Column:
    """Must end ``.py``; then any rule over {dir, name, path} x {equality,
    regex search}.  The rule list is tiny configuration, folded into one
    codegen'd predicate (no join)."""
    path = F.concat(file_dir, F.lit("/"), file_name)
    cols = {"file_dir": file_dir, "file_name": file_name, "file_path": path}
    hit = F.lit(False)
    for loc, kind, pat in rules:
        c = cols[loc]
        hit = hit | ((c == F.lit(pat)) if kind == "match" else c.rlike(pat))
    return file_name.endswith(".py") & hit


def effective_lines(text: Column) -> Column:
    """A4: number of non-blank, non-comment lines."""
    lines = F.split(text, LINE_BREAK_RE)
    return F.size(F.filter(lines, lambda l: ~l.rlike(NOT_CODE_RE))).cast("long")


def ancestors(dir_path: Column) -> Column:
    """Proper ancestor directories of an absolute or relative path
    (path-component prefixes)."""
    parts = F.split(dir_path, "/")
    n = F.size(parts)
    return F.when(n <= 1, F.array().cast("array<string>")).otherwise(
        F.filter(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/")),
                 lambda a: a != ""))


def import_names(files: DataFrame, package: str = "package", file_dir: str = "file_dir",
                 file_name: str = "file_name", compat_prefix: bool = False) -> DataFrame:
    """Per package, the topmost directories containing ``__init__.py``,
    by base name.  A directory is dropped when any ancestor also holds an
    ``__init__.py`` (anti-join on exploded ancestors).  ``compat_prefix``
    reproduces the raw string-prefix test (``foo`` hides ``foobar``)."""
    dirs = files.where(F.col(file_name) == "__init__.py").select(
        F.col(package).alias("package"), F.col(file_dir).alias("dir")).distinct()
    if compat_prefix:
        other = dirs.select(F.col("package").alias("p2"), F.col("dir").alias("d2"))
        nested = dirs.join(other, (dirs.package == other.p2) & (dirs.dir != other.d2)
                           & dirs.dir.startswith(other.d2), "left_semi")
        top = dirs.join(nested, ["package", "dir"], "left_anti")
    else:
        anc = dirs.select("package", "dir", F.explode(ancestors(F.col("dir"))).alias("anc"))
        nested = anc.join(dirs.select("package", F.col("dir").alias("anc")), ["package", "anc"], "left_semi")
        top = dirs.join(nested.select("package", "dir"), ["package", "dir"], "left_anti")
    return top.select("package", "dir", F.regexp_extract("dir", r"([^/]*)$", 1).alias("import_name"))


def alias_rows(import_names_df: DataFrame, project: str = "project", version: str = "version") -> DataFrame:
    """Import names that differ from the project name, distinct."""
    d = import_names_df.where(F.col("import_name") != F.col(project))
    return d.select(F.col(project).alias("name"), F.col(version).alias("version"), "import_name").distinct()
