"""Rule catalogue and file rules (S10, S11) -> small DataFrames.

Rules are configuration: a handful of YAML files parsed on the driver and
turned into tiny tables that the taint joins broadcast.  Users extend the
scanner by adding YAML rows, not code.
"""
from __future__ import annotations

import os
import re
from dataclasses import dataclass

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.common import local_rows

RULES_DIR = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "rules")
FILE_RULES = os.path.join(RULES_DIR, "file_rules.yml")
DEFAULT_FILE_RULES = {"file_name": [{"match": "setup.py"}, {"match": "__init__.py"}]}
LOCATIONS = ("file_dir", "file_name", "file_path")

SPEC_SCHEMA = T.StructType([
    T.StructField("rule_id", T.StringType()), T.StructField("rule_type", T.StringType()),
    T.StructField("role", T.StringType()), T.StructField("accordance", T.StringType()),
    T.StructField("target", T.StringType()), T.StructField("position", T.StringType()),
    T.StructField("keyword", T.StringType()),
])
PAIR_SCHEMA = T.StructType([
    T.StructField("rule_id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("template", T.StringType()),
    T.StructField("t_accordance", T.StringType()), T.StructField("t_key", T.StringType()),
    T.StructField("t_severity", T.IntegerType()), T.StructField("t_confidence", T.IntegerType()),
    T.StructField("s_accordance", T.StringType()), T.StructField("s_key", T.StringType()),
    T.StructField("s_severity", T.IntegerType()), T.StructField("s_confidence", T.IntegerType()),
])


@dataclass
class Catalogue:
    specs: list[tuple]   # classification rules (taint / sink specs)
    pairs: list[tuple]   # detection rules: taint spec x sink spec


def load_rule_docs(path: str = RULES_DIR) -> dict[str, dict]:
    """A directory (every file, sorted by name) or a single YAML file.
    Documents without ``id`` are skipped; a repeated id: the last one wins."""
    files = ([os.path.join(path, f) for f in sorted(os.listdir(path)) if os.path.isfile(os.path.join(path, f))]
             if os.path.isdir(path) else [path])
    rules: dict[str, dict] = {}
    for f in files:
        if os.path.basename(f) == "file_rules.yml":
            continue
        with open(f) as fh:
            doc = yaml.safe_load(fh)
        if isinstance(doc, dict) and "id" in doc:
            rules[str(doc["id"])] = doc
    return rules


def _pos(p) -> str | None:
    return None if p is None else str(p)


def catalogue(rules: dict[str, dict]) -> Catalogue:
    specs, pairs = [], []
    for rid, r in rules.items():
        if rid.startswith("00"):
            for role in ("taints", "sinks"):
                for s in r.get(role) or []:
                    acc = s["accordance"]
                    specs.append((rid, r.get("type", ""), role[:-1], acc, s.get(acc), _pos(s.get("position")),
                                  s.get("keyword")))
        else:
            for t in r.get("taints") or []:
                for s in r.get("sinks") or []:
                    ta, sa = t["accordance"], s["accordance"]
                    pairs.append((rid, r.get("name"), r.get("template"), ta, str(t[ta]), int(t["severity"]),
                                  int(t["confidence"]), sa, str(s[sa]), int(s["severity"]), int(s["confidence"])))
    return Catalogue(specs, pairs)


def graded(rules: dict[str, dict], severity: dict[str, int]) -> dict[str, dict]:
    """``rules`` with another severity for the detection rules named."""
    def grade(rid, specs):
        return [{**s, "severity": severity[rid]} for s in specs or []]

    return {rid: {**r, "taints": grade(rid, r.get("taints")), "sinks": grade(rid, r.get("sinks"))} if rid in severity else r
            for rid, r in rules.items()}


def rule_tables(spark: SparkSession, path: str = RULES_DIR, rules: dict[str, dict] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rule_specs, rule_pairs) DataFrames of the rules given, else of those
    at ``path``; both are tiny."""
    cat = catalogue(load_rule_docs(path) if rules is None else rules)
    return local_rows(spark, cat.specs, SPEC_SCHEMA), local_rows(spark, cat.pairs, PAIR_SCHEMA)


def load_file_rules(path: str | None = FILE_RULES) -> list[tuple[str, str, str]]:
    """(location, kind, pattern) rows; invalid regexes are skipped.
    ``path=None`` gives the default (file name is setup.py or __init__.py)."""
    doc = DEFAULT_FILE_RULES
    if path is not None:
        with open(path) as fh:
            doc = yaml.safe_load(fh) or {}
    out = []
    for loc in LOCATIONS:
        for r in doc.get(loc) or []:
            if "match" in r:
                out.append((loc, "match", str(r["match"])))
            if "regex" in r:
                try:
                    re.compile(r["regex"])
                except re.error:
                    continue
                out.append((loc, "regex", str(r["regex"])))
    return out
