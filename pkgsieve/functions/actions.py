"""Change-feed action parsing (F4-F7) and version / URL helpers.

All column expressions; the regexes run in the JVM.  ``(?U)`` makes Java's
``\\s``/``\\S`` Unicode-aware like Python's ``re`` on ``str``.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Action patterns and URL templates that must equal the
# reference's behaviour.
FILE_ACTION_RE = r"(?U)(?:remove|add\s+\S+)\s+file\s+(\S+)"
OWNER_ACTION_RE = r"(?U)(?:add|invite|accepted|remove|change)\s+Owner\s+(\S+)"
MAINTAINER_ACTION_RE = r"(?U)(?:add|invite|accepted|remove|change)\s+Maintainer\s+(\S+)"
PROJECT_JSON_URL = "https://pypi.org/pypi/{PROJECT}/json"
RELEASE_JSON_URL = "https://pypi.org/pypi/{PROJECT}/{VERSION}/json"
TAR_GZ_STRIP_CHARS = ".tar.gz"

# F7 outcome labels, in the order the classifier tests them.
KIND_CREATE = "create"
KIND_REMOVE_PROJECT = "remove project"
ROLE_KINDS = [
    ("add Owner", "add_owner"),
    ("invite Owner", "invite_owner"),
    ("accepted Owner", "accepted_owner"),
    ("remove Owner", "remove_owner"),
    ("change Owner", "change_owner"),
    ("add Maintainer", "add_maintainer"),
    ("invite Maintainer", "invite_maintainer"),
    ("accepted Maintainer", "accepted_maintainer"),
    ("remove Maintainer", "remove_maintainer"),
    ("change Maintainer", "change_maintainer"),
]
KIND_NEW_RELEASE = "new release"
KIND_YANK = "yank release"
KIND_UNYANK = "unyank release"
KIND_FILE = "file"
KIND_REMOVE_RELEASE = "remove release"
KIND_OTHER = "other"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _extract(action: str | Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(_c(action), pattern, 1), F.lit(""))


def filename_from_action(action: str | Column) -> Column:
    """file name of an add/remove-file action, else null."""
    return _extract(action, FILE_ACTION_RE)


def owner_from_action(action: str | Column) -> Column:
    """user named in an Owner action, else null."""
    return _extract(action, OWNER_ACTION_RE)


def maintainer_from_action(action: str | Column) -> Column:
    """user named in a Maintainer action, else null."""
    return _extract(action, MAINTAINER_ACTION_RE)


def is_file_action(action: str | Column) -> Column:
    return _c(action).rlike(FILE_ACTION_RE)


def action_kind(action: str | Column) -> Column:
    """classify a feed action; first matching test wins (equality, prefix,
    regex search, in the monitor's order)."""
    a = _c(action)
    k = F.when(a == KIND_CREATE, F.lit(KIND_CREATE)).when(a == KIND_REMOVE_PROJECT, F.lit(KIND_REMOVE_PROJECT))
    for prefix, label in ROLE_KINDS:
        k = k.when(a.startswith(prefix), F.lit(label))
    k = (k.when(a == KIND_NEW_RELEASE, F.lit(KIND_NEW_RELEASE))
          .when(a.startswith(KIND_YANK), F.lit(KIND_YANK))
          .when(a.startswith(KIND_UNYANK), F.lit(KIND_UNYANK))
          .when(is_file_action(a), F.lit(KIND_FILE))
          .when(a == KIND_REMOVE_RELEASE, F.lit(KIND_REMOVE_RELEASE)))
    return k.otherwise(F.lit(KIND_OTHER))


def version_from_filename(project: str | Column, filename: str | Column, strict: bool = False) -> Column:
    """release version from a ``.tar.gz`` file name.

    Compat (default): strip *leading characters in the project-name set*,
    then leading ``-``, then *trailing characters in the set* ``.targz``
    (so ``pkg-12-1.3.tar.gz`` gives ``.3``).  ``strict=True`` removes the
    literal ``project-`` prefix and ``.tar.gz`` suffix instead.
    """
    p, f = _c(project), _c(filename)
    if strict:
        pre = F.concat(p, F.lit("-"))
        start = F.when(f.startswith(pre), F.length(pre) + 1).otherwise(F.lit(1))
        end = F.when(f.endswith(".tar.gz"), F.length(f) - 7).otherwise(F.length(f))
        return f.substr(start, end - start + 1)
    s = F.ltrim(f, p)
    s = F.ltrim(s, F.lit("-"))
    return F.rtrim(s, F.lit(TAR_GZ_STRIP_CHARS))


def epoch_to_ts(seconds: str | Column) -> Column:
    """epoch seconds -> timestamp (session zone is UTC)."""
    return F.timestamp_seconds(_c(seconds))


def project_json_url(project: str | Column) -> Column:
    """project metadata URL."""
    head, tail = PROJECT_JSON_URL.split("{PROJECT}")
    return F.concat(F.lit(head), _c(project), F.lit(tail))


def release_json_url(project: str | Column, version: str | Column) -> Column:
    """release metadata URL."""
    head, rest = RELEASE_JSON_URL.split("{PROJECT}")
    mid, tail = rest.split("{VERSION}")
    return F.concat(F.lit(head), _c(project), F.lit(mid), _c(version), F.lit(tail))
