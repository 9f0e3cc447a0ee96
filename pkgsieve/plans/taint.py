"""Scanner queries over the derived Python corpus (one file per document).

Oracles are the hand-derived expectations per template (FIXTURES §3) as a
``VALUES`` table joined on the template number -- the analysis itself is an
iterative fix-point that SQL cannot express -- except the package roll-ups,
which are real SQL aggregations over those expectations.
"""
from __future__ import annotations

import ast

from pyspark.sql import functions as F

from .. import tables as T
from ..operators.common import checkpoint_cut
from ..sources.rules import graded, load_rule_docs
from ..taint.scanner import CHAIN, TEMPLATES, behaviour_order, code_corpus, file_metrics, package_metrics, scan_corpus
from .registry import register


def scanned(spark, sf):
    """A scan of the derived corpus as it is now."""
    return scan_corpus(code_corpus(T.read(spark, sf, "documents")))


def _values(rows, cols) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(values {body}) as v({', '.join(cols)})"


def _doc_join(rows, cols, select) -> str:
    return f"select {select} from documents d join {_values(rows, cols)} on d.doc_id % {len(TEMPLATES)} = v.t"


# Hand-derived expectations per template (FIXTURES §3).
_M = 'call of "{}" detected for executing commands'
_D = ' decoded by "base64.b64decode"'
_N = ' received from network by "urllib.request.urlretrieve"'
_LAST = CHAIN + 3  # the last line of the chain templates
ISSUES = [
    (1, "1000", 1, "*", 7, 7, _M.format("exec")),
    (2, "1000", 3, "*", 7, 7, _M.format("exec")),
    (2, "1001", 3, "base64.b64decode", 10, 10, _M.format("exec") + ' decoded by "base64.b64decode"'),
    (3, "1000", 4, "*", 7, 7, _M.format("eval")),
    (3, "1002", 4, "requests.get", 10, 10, _M.format("eval") + ' received from network by "requests.get"'),
    (4, "1000", 3, "*", 7, 7, _M.format("os.system")),
    (5, "1000", 2, "*", 7, 7, _M.format("os.system")),
    (6, "1000", 4, "*", 7, 7, _M.format("exec")),
    (7, "1000", 5, "*", 7, 7, _M.format("os.system")),
    (7, "1002", 5, "urllib.request.urlretrieve", 10, 10,
     _M.format("os.system") + ' received from network by "urllib.request.urlretrieve"'),
    (8, "2001", 3, "base64.b64encode", 7, 7, 'call of "requests.post" detected for sending data encoded by "base64.b64encode"'),
    (9, "1000", 4, "*", 7, 7, _M.format("eval")),
    (9, "1001", 4, "base64.b64decode", 10, 10, _M.format("eval") + ' decoded by "base64.b64decode"'),
    (9, "1000", 5, "*", 7, 7, _M.format("eval")),
    (10, "1000", 3, "*", 7, 7, _M.format("exec")),
    (11, "1000", 3, "*", 7, 7, _M.format("exec")),
    (11, "1001", 3, "base64.b64decode", 10, 10, _M.format("exec") + _D),
    (12, "1000", 3, "*", 7, 7, _M.format("exec")),
    (12, "1001", 3, "base64.b64decode", 10, 10, _M.format("exec") + _D),
    (13, "1000", 4, "*", 7, 7, _M.format("os.system")),
    (13, "1002", 4, "urllib.request.urlretrieve", 10, 10, _M.format("os.system") + _N),
    (14, "1000", 3, "*", 7, 7, _M.format("os.system")),
    (15, "1000", 4, "*", 7, 7, _M.format("os.system")),
    (15, "1000", 5, "*", 7, 7, _M.format("os.system")),
    (15, "1002", 5, "urllib.request.urlretrieve", 10, 10, _M.format("os.system") + _N),
    (17, "1000", 5, "*", 7, 7, _M.format("exec")),
    (18, "1000", _LAST, "*", 7, 7, _M.format("exec")),
    (18, "1001", _LAST, "base64.b64decode", 10, 10, _M.format("exec") + _D),
    (19, "1000", _LAST, "*", 7, 7, _M.format("os.system")),
]
CALLS = [(0, 2, "print"), (0, 2, "os.getcwd"), (1, 1, "exec"), (2, 2, "base64.b64decode"), (2, 3, "exec"),
         (3, 2, "requests.get"), (3, 4, "eval"), (4, 3, "os.system"), (5, 2, "__import__"), (5, 2, "os.system"),
         (6, 2, "base64.b64decode"), (6, 4, "exec"), (7, 4, "urllib.request.urlretrieve"), (7, 5, "os.system"),
         (8, 2, "base64.b64encode"), (8, 3, "requests.post"), (9, 3, "base64.b64decode"), (9, 4, "eval"),
         (9, 5, "eval"), (9, 6, "g"), (10, 3, "exec"), (11, 2, "base64.b64decode"), (11, 3, "exec"),
         (12, 2, "base64.b64decode"), (12, 3, "exec"), (13, 2, "urllib.request.urlretrieve"), (13, 4, "os.system"),
         (14, 3, "importlib.import_module"), (14, 3, "os.system"), (14, 4, "importlib.import_module"),
         (14, 4, "os.path.exists"), (15, 4, "urllib.request.urlretrieve"), (15, 4, "os.system"), (15, 5, "os.system"),
         (16, 2, "base64.b64decode"), (16, 2, "os.getcwd"), (16, 3, "os.getcwd"), (17, 2, "base64.b64decode"),
         (17, 5, "exec"), (18, 2, "base64.b64decode"), (18, _LAST, "exec"), (19, _LAST, "os.system")]
SOURCES = [(0, "0006", "os.getcwd", 2, "ret"), (2, "0003", "base64.b64decode", 2, "ret"),
           (3, "0004", "requests.get", 2, "ret"), (6, "0003", "base64.b64decode", 2, "ret"),
           (7, "0004", "urllib.request.urlretrieve", 4, "ret"), (7, "0004", "urllib.request.urlretrieve", 4, "1"),
           (8, "0002", "base64.b64encode", 2, "ret"), (9, "0003", "base64.b64decode", 3, "ret"),
           (10, "0006", "os.environ", 2, "ret"), (11, "0003", "base64.b64decode", 2, "ret"),
           (12, "0003", "base64.b64decode", 2, "ret"), (13, "0004", "urllib.request.urlretrieve", 2, "ret"),
           (13, "0004", "urllib.request.urlretrieve", 2, "1"), (15, "0004", "urllib.request.urlretrieve", 4, "ret"),
           (15, "0004", "urllib.request.urlretrieve", 4, "1"), (16, "0003", "base64.b64decode", 2, "ret"),
           (16, "0006", "os.getcwd", 2, "ret"), (16, "0006", "os.getcwd", 3, "ret"),
           (17, "0003", "base64.b64decode", 2, "ret"), (18, "0003", "base64.b64decode", 2, "ret")]
SINKS = [(1, "0001", "exec", 1), (2, "0001", "exec", 3), (3, "0001", "eval", 4), (3, "0005", "requests.get", 2),
         (4, "0001", "os.system", 3), (5, "0001", "os.system", 2), (6, "0001", "exec", 4),
         (7, "0005", "urllib.request.urlretrieve", 4), (7, "0001", "os.system", 5), (8, "0005", "requests.post", 3),
         (9, "0001", "eval", 4), (9, "0001", "eval", 5), (10, "0001", "exec", 3), (11, "0001", "exec", 3),
         (12, "0001", "exec", 3), (13, "0005", "urllib.request.urlretrieve", 2), (13, "0001", "os.system", 4),
         (14, "0001", "os.system", 3), (15, "0005", "urllib.request.urlretrieve", 4), (15, "0001", "os.system", 4),
         (15, "0001", "os.system", 5), (17, "0001", "exec", 5), (18, "0001", "exec", _LAST), (19, "0001", "os.system", _LAST)]
BEHAVIOURS = [(0, "sensitive-info-acquisition", 0), (2, "decoder", 0), (3, "network-receiver", 0),
              (6, "decoder", 0), (7, "network-receiver", 0), (8, "encoder", 0), (9, "decoder", 0), (11, "decoder", 0),
              (12, "decoder", 0), (13, "network-receiver", 0), (15, "network-receiver", 0), (16, "decoder", 0),
              (16, "sensitive-info-acquisition", 1), (17, "decoder", 0), (18, "decoder", 0)]
IMPORTS = [(0, "module", "os", "os"), (2, "module", "base64", "base64"), (3, "module", "requests", "requests"),
           (4, "alias", "s", "os.system"), (4, "module", "os.system", "os.system"), (6, "module", "base64", "base64"),
           (7, "module", "os", "os"), (7, "alias", "request", "urllib.request"),
           (7, "module", "urllib.request", "urllib.request"), (8, "module", "base64", "base64"),
           (8, "module", "requests", "requests"), (9, "module", "base64", "base64"),
           (10, "module", "os", "os"), (11, "module", "base64", "base64"), (12, "module", "base64", "base64"),
           (12, "module", "os", "os"), (13, "alias", "request", "urllib.request"),
           (13, "module", "urllib.request", "urllib.request"), (13, "module", "os", "os"),
           (14, "module", "importlib", "importlib"), (15, "alias", "request", "urllib.request"),
           (15, "module", "urllib.request", "urllib.request"), (15, "module", "os", "os"),
           (16, "module", "base64", "base64"), (16, "module", "os", "os"), (17, "module", "base64", "base64"),
           (18, "module", "base64", "base64"), (19, "alias", "system", "os.system"), (19, "module", "os.system", "os.system")]
SINK_ARGS = [(1, "0001", "exec", 1, 0, None, "Constant"), (2, "0001", "exec", 3, 0, None, "Name"),
             (3, "0001", "eval", 4, 0, None, "Name"), (3, "0005", "requests.get", 2, 0, "url", "Constant"),
             (4, "0001", "os.system", 3, 0, "command", "Constant"), (5, "0001", "os.system", 2, 0, "command", "Constant"),
             (6, "0001", "exec", 4, 0, None, "Name"), (7, "0005", "urllib.request.urlretrieve", 4, 0, "url", "Constant"),
             (7, "0001", "os.system", 5, 0, "command", "Name"), (8, "0005", "requests.post", 3, 0, "url", "Constant"),
             (8, "0005", "requests.post", 3, 1, "data", "Name"), (9, "0001", "eval", 4, 0, None, "Name"),
             (9, "0001", "eval", 5, 0, None, "Name"), (10, "0001", "exec", 3, 0, None, "Name"),
             (11, "0001", "exec", 3, 0, None, "Name"), (12, "0001", "exec", 3, 0, None, "Attribute"),
             (13, "0005", "urllib.request.urlretrieve", 2, 0, "url", "Constant"),
             (13, "0001", "os.system", 4, 0, "command", "Constant"), (14, "0001", "os.system", 3, 0, "command", "Constant"),
             (15, "0005", "urllib.request.urlretrieve", 4, 0, "url", "Constant"),
             (15, "0001", "os.system", 4, 0, "command", "BinOp"), (15, "0001", "os.system", 5, 0, "command", "BinOp"),
             (17, "0001", "exec", 5, 0, None, "Name"), (18, "0001", "exec", _LAST, 0, None, "Name"),
             (19, "0001", "os.system", _LAST, 0, "command", "Constant")]
ARG_TAINTS = [(7, "0004", "urllib.request.urlretrieve", 4, "Name", "f"),
              (13, "0004", "urllib.request.urlretrieve", 2, "Constant", "p.sh"),
              (15, "0004", "urllib.request.urlretrieve", 4, "Name", "f")]
LINES = [2, 1, 3, 4, 3, 2, 4, 5, 3, 6, 3, 3, 3, 4, 4, 5, 3, 5, _LAST, _LAST]
COUNTS = [0, 1, 2, 2, 1, 1, 1, 2, 1, 3, 1, 2, 2, 2, 1, 3, 0, 1, 2, 1]
METRICS = [(t, 1, LINES[t], COUNTS[t], 0, 0, COUNTS[t]) for t in range(len(TEMPLATES))]


# Another catalogue: severities on both sides of each bound of the histogram.
GRADES = {"1000": 3, "1001": 4, "1002": 7, "2001": 6}


def _graded_counts():
    kinds = {"low": range(0, 4), "medium": range(4, 7), "high": range(7, 11)}
    found = [(t, [GRADES[i] for u, i, *_ in ISSUES if u == t]) for t in range(len(TEMPLATES))]
    return [(t, len(g), *[sum(x in k for x in g) for k in kinds.values()]) for t, g in found]


@register("severity_histogram", _doc_join(_graded_counts(), ["t", "cnt", "low", "medium", "high"], "d.doc_id, " + ", ".join(
    f"cast(v.{c} as bigint) as {c}" for c in ("cnt", "low", "medium", "high"))))
def severity_histogram(spark, sf):
    """A5: issues per file by severity, under a catalogue with all three grades."""
    corpus = code_corpus(T.read(spark, sf, "documents"))
    m = file_metrics(scan_corpus(corpus, rules=graded(load_rule_docs(), GRADES)))
    return m.select(F.col("file_id").alias("doc_id"), "cnt", "low", "medium", "high")


def _ast_counts():
    """Expected fact counts per template from the standard parser."""
    out = []
    for t, src in enumerate(TEMPLATES):
        nodes = list(ast.walk(ast.parse(src)))
        out.append((t, len(nodes) - 1, sum(isinstance(n, ast.Call) for n in nodes),
                    sum(isinstance(n, ast.Name) for n in nodes), sum(isinstance(n, ast.Attribute) for n in nodes),
                    sum(isinstance(n, ast.Constant) for n in nodes)))
    return out


@register("issues", _doc_join(ISSUES, ["t", "rule_id", "sink_line", "taint_key", "severity", "confidence", "msg"],
                              "d.doc_id, v.rule_id, v.sink_line, v.taint_key, v.severity, v.confidence, v.msg"))
def issues(spark, sf):
    """Detected issues (rule, sink line, taint, scores, message)."""
    return issue_columns(scanned(spark, sf).scan.issues)


def issue_columns(i):
    tk = (F.when(F.col("taint.accordance") == "type", F.col("taint.type"))
           .when(F.col("taint.accordance") == "function", F.col("taint.function"))
           .otherwise(F.col("taint.attribute")))
    return i.select(F.col("file_id").alias("doc_id"), F.col("id").alias("rule_id"),
                    F.col("sink.lineno").alias("sink_line"), tk.alias("taint_key"), "severity", "confidence", "msg")


@register("resolved_calls", _doc_join(CALLS, ["t", "line", "func"], "d.doc_id, v.line, v.func"))
def resolved_calls(spark, sf):
    """X7 + X8: resolved callee of every call."""
    c = scanned(spark, sf).call_names
    return c.select(F.col("file_id").alias("doc_id"), F.col("lineno").alias("line"), "func")


@register("taint_sources", _doc_join(SOURCES, ["t", "rule_id", "func", "line", "position"],
                                     "d.doc_id, v.rule_id, v.func, v.line, v.position"))
def taint_sources(spark, sf):
    """J7 + J8 + X9 + X10: rule-marked taint sources."""
    s = scanned(spark, sf).scan.taint_sources
    return s.select(F.col("file_id").alias("doc_id"), F.col("t.id").alias("rule_id"),
                    F.coalesce("t.function", "t.attribute").alias("func"), F.col("t.lineno").alias("line"),
                    F.col("t.position").alias("position"))


@register("sink_calls", _doc_join(SINKS, ["t", "rule_id", "func", "line"], "distinct d.doc_id, v.rule_id, v.func, v.line"))
def sink_calls(spark, sf):
    """Calls matching sink rules."""
    s = scanned(spark, sf).scan.sinks
    return s.select(F.col("file_id").alias("doc_id"), F.col("s.id").alias("rule_id"), F.col("s.function").alias("func"),
                    F.col("s.lineno").alias("line")).distinct()


@register("sink_args", _doc_join(SINK_ARGS, ["t", "rule_id", "func", "line", "position", "keyword", "arg_type"],
                                 "d.doc_id, v.rule_id, v.func, v.line, v.position, v.keyword, v.arg_type"))
def sink_args(spark, sf):
    """The argument each sink spec inspects (positional if present, else keyword)."""
    a = scanned(spark, sf).scan.sink_args
    return a.select(F.col("file_id").alias("doc_id"), F.col("s.id").alias("rule_id"), F.col("s.function").alias("func"),
                    F.col("s.lineno").alias("line"), F.col("s.position").alias("position"),
                    F.col("s.keyword").alias("keyword"), "arg_type")


@register("arg_taints", _doc_join(ARG_TAINTS, ["t", "rule_id", "func", "line", "arg_type", "target"],
                                  "d.doc_id, v.rule_id, v.func, v.line, v.arg_type, v.target"))
def arg_taints(spark, sf):
    """Argument-position taints and the variable / constant they land on."""
    a = scanned(spark, sf).scan.arg_taints
    return a.select(F.col("file_id").alias("doc_id"), F.col("t.id").alias("rule_id"), F.col("t.function").alias("func"),
                    F.col("t.lineno").alias("line"), "arg_type", "target")


@register("behaviour_order", _doc_join(BEHAVIOURS, ["t", "behaviour", "ord"], "d.doc_id, v.behaviour, v.ord"))
def behaviour_order_q(spark, sf):
    """First-occurrence order of sensitive behaviours per file."""
    b = behaviour_order(scanned(spark, sf))
    return b.select(F.col("file_id").alias("doc_id"), "behaviour", F.col("ord").cast("int").alias("ord"))


@register("import_bindings", _doc_join(IMPORTS, ["t", "kind", "bound", "target"], "d.doc_id, v.kind, v.bound, v.target"))
def import_bindings(spark, sf):
    """Import aliases and imported-module entries per file."""
    i = scanned(spark, sf).facts.imports
    return i.select(F.col("file_id").alias("doc_id"),
                    F.when(F.col("alias").isNull(), F.lit("module")).otherwise(F.lit("alias")).alias("kind"),
                    F.coalesce("alias", "target").alias("bound"), "target")


@register("code_facts", _doc_join(_ast_counts(), ["t", "n_nodes", "n_calls", "n_names", "n_attrs", "n_consts"],
                                  "d.doc_id, " + ", ".join(f"cast(v.{c} as bigint) as {c}" for c in
                                                           ["n_nodes", "n_calls", "n_names", "n_attrs", "n_consts"])))
def code_facts(spark, sf):
    """Fact counts per file."""
    n = scanned(spark, sf).facts.nodes.where(F.col("seq") > 0)
    t = F.col("ntype")
    return n.groupBy(F.col("file_id").alias("doc_id")).agg(
        F.count("*").alias("n_nodes"), F.count(F.when(t == "Call", 1)).alias("n_calls"),
        F.count(F.when(t == "Name", 1)).alias("n_names"), F.count(F.when(t == "Attribute", 1)).alias("n_attrs"),
        F.count(F.when(t == "Constant", 1)).alias("n_consts"))


_METRIC_COLS = ["t", "files", "lines", "cnt", "low", "medium", "high"]


@register("file_metrics", _doc_join(METRICS, _METRIC_COLS,
                                    "d.doc_id, " + ", ".join(f"cast(v.{c} as bigint) as {c}" for c in _METRIC_COLS[1:])))
def file_metrics_q(spark, sf):
    """A2 + A5: per-file metrics (files, effective lines, issues by severity)."""
    m = file_metrics(scanned(spark, sf))
    return m.select(F.col("file_id").alias("doc_id"), "files", "lines", "cnt", "low", "medium", "high")


_PKG = "'pkg' || cast(d.doc_id % 50 as varchar)"


@register("package_metrics", f"""
select package, {", ".join(f"cast(sum({c}) as bigint) as {c}" for c in _METRIC_COLS[1:])}
from ({_doc_join(METRICS, _METRIC_COLS, _PKG + " as package, v.*")}) m
group by rollup(package)
""")
def package_metrics_q(spark, sf):
    """A3: per-package roll-up and the overall total (package null)."""
    return package_metrics(file_metrics(scanned(spark, sf)))


@register("alerts", f"""
select package, cast(sum(cnt) as bigint) as cnt
from ({_doc_join(METRICS, _METRIC_COLS, _PKG + " as package, v.*")}) m
group by package having sum(cnt) > 0
""")
def alerts(spark, sf):
    """Packages with at least one issue."""
    m = file_metrics(scanned(spark, sf))
    return m.groupBy("package").agg(F.sum("cnt").cast("long").alias("cnt")).where(F.col("cnt") > 0)


# X12-X17 per template: the nodes that a taint reaches and that are ever asked
# for it -- (line, node type, taint id, line of the taint, position)
REACH = [
    (0, 2, "Call", "0006", 2, "ret"),
    (2, 2, "Call", "0003", 2, "ret"), (2, 2, "Assign", "0003", 2, "ret"), (2, 3, "Name", "0003", 2, "ret"),
    (3, 2, "Call", "0004", 2, "ret"), (3, 2, "Assign", "0004", 2, "ret"), (3, 3, "Name", "0004", 2, "ret"),
    (3, 3, "Assign", "0004", 2, "ret"), (3, 4, "Name", "0004", 2, "ret"),
    (6, 2, "Call", "0003", 2, "ret"), (6, 2, "Assign", "0003", 2, "ret"),
    (7, 4, "Call", "0004", 4, "ret"), (7, 4, "Name", "0004", 4, "1"), (7, 5, "Name", "0004", 4, "1"),
    (8, 2, "Call", "0002", 2, "ret"), (8, 2, "Assign", "0002", 2, "ret"), (8, 3, "Name", "0002", 2, "ret"),
    (9, 3, "Name", "0000", -1, None), (9, 3, "Assign", "0000", -1, None), (9, 4, "Name", "0000", -1, None),
    (9, 5, "Name", "0000", -1, None), (9, 3, "Call", "0003", 3, "ret"), (9, 3, "Assign", "0003", 3, "ret"),
    (9, 4, "Name", "0003", 3, "ret"),
    (10, 2, "Attribute", "0006", 2, "ret"), (10, 2, "Assign", "0006", 2, "ret"), (10, 3, "Name", "0006", 2, "ret"),
    (11, 2, "Call", "0003", 2, "ret"), (11, None, "withitem", "0003", 2, "ret"), (11, 3, "Name", "0003", 2, "ret"),
    (12, 2, "Call", "0003", 2, "ret"), (12, 2, "Assign", "0003", 2, "ret"), (12, 3, "Attribute", "0003", 2, "ret"),
    (13, 2, "Call", "0004", 2, "ret"), (13, 2, "Constant", "0004", 2, "1"), (13, 4, "Constant", "0004", 2, "1"),
    (15, 4, "Call", "0004", 4, "ret"), (15, 4, "Name", "0004", 4, "1"), (15, 4, "Name", "0004", 4, "1"),
    (15, 5, "Name", "0004", 4, "1"), (15, 5, "BinOp", "0004", 4, "1"),
    (16, 2, "Call", "0003", 2, "ret"), (16, 2, "Call", "0006", 2, "ret"), (16, 3, "Call", "0006", 3, "ret"),
    (17, 2, "Call", "0003", 2, "ret"), (17, 2, "Assign", "0003", 2, "ret"),
    (18, 2, "Call", "0003", 2, "ret"), (18, 2, "Assign", "0003", 2, "ret"), (18, _LAST, "Name", "0003", 2, "ret"),
    *[(18, line, kind, "0003", 2, "ret") for line in range(3, _LAST) for kind in ("Name", "Assign")],
]


@register("taint_reach", _doc_join(REACH, ["t", "line", "ntype", "taint_id", "taint_line", "position"],
                                   "d.doc_id, v.line, v.ntype, v.taint_id, v.taint_line, v.position"))
def taint_reach(spark, sf):
    """X12-X17 + A12: the reads, assignments, with items and call arguments
    that each taint reaches."""
    res = scanned(spark, sf)
    n = res.scan.node_taints.join(res.facts.nodes.select("file_id", "seq", "ntype", F.col("lineno").alias("line")),
                                  ["file_id", "seq"])
    n = checkpoint_cut(n, bucket="file_id")  # joined where the tables of the scan lie
    return n.select(F.col("file_id").alias("doc_id"), "line", "ntype", F.col("t.id").alias("taint_id"),
                    F.col("t.lineno").alias("taint_line"), F.col("t.position").alias("position"))


# X4 records per template: (scope, name, constant value, dotted variable)
BINDINGS = [(2, "", "a", None, None), (3, "", "r", None, None), (3, "", "b", None, "r.text"),
            (4, "", "t", None, "os.system"), (5, "", "m", "os", None), (6, "", "a", None, None),
            (6, "", "a", "x", None), (7, "", "f", "p.sh", None), (8, "", "d", None, None),
            (9, ".g", "d", None, None), (10, "", "x", None, "os.environ"), (14, "", "m", "os", None),
            (15, "", "f", "p", None), (17, "", "a", None, None),
            *[(18, "", f"v{i}", None, None) for i in range(CHAIN + 1)],
            *[(19, "", f"e{i}", None, "os.system") for i in range(CHAIN + 1)]]


@register("name_bindings", _doc_join(BINDINGS, ["t", "scope", "name", "value", "variable"],
                                     "d.doc_id, v.scope, v.name, v.value, v.variable"))
def name_bindings(spark, sf):
    """Variable records with their constant value / dotted name."""
    r = scanned(spark, sf).records
    return r.select(F.col("file_id").alias("doc_id"), F.col("rec_ns").alias("scope"), "name", "value", "variable")


# J12 per template: every name read -> (name, line, definition visible,
# its scope, import alias bound before the read)
DEF_USE = [(0, "print", 2, False, None, None), (0, "os", 2, False, None, None), (1, "exec", 1, False, None, None),
           (2, "base64", 2, False, None, None), (2, "exec", 3, False, None, None), (2, "a", 3, True, "", None),
           (3, "requests", 2, False, None, None), (3, "r", 3, True, "", None), (3, "eval", 4, False, None, None),
           (3, "b", 4, True, "", None), (4, "s", 2, False, None, "os.system"), (4, "t", 3, True, "", None),
           (5, "__import__", 2, False, None, None), (5, "m", 2, True, "", None),
           (6, "base64", 2, False, None, None), (6, "exec", 4, False, None, None), (6, "a", 4, True, "", None),
           (7, "request", 4, False, None, "urllib.request"), (7, "f", 4, True, "", None),
           (7, "os", 5, False, None, None), (7, "f", 5, True, "", None),
           (8, "base64", 2, False, None, None), (8, "requests", 3, False, None, None), (8, "d", 3, True, "", None),
           (9, "base64", 3, False, None, None), (9, "c", 3, True, ".g", None), (9, "eval", 4, False, None, None),
           (9, "d", 4, True, ".g", None), (9, "eval", 5, False, None, None), (9, "k", 5, True, ".g", None),
           (9, "g", 6, False, None, None), (10, "os", 2, False, None, None), (10, "exec", 3, False, None, None),
           (10, "x", 3, True, "", None), (11, "base64", 2, False, None, None), (11, "exec", 3, False, None, None),
           (11, "h", 3, True, "", None), (12, "base64", 2, False, None, None), (12, "os", 2, False, None, None),
           (12, "exec", 3, False, None, None), (12, "os", 3, False, None, None),
           (13, "request", 2, False, None, "urllib.request"), (13, "os", 4, False, None, None),
           (14, "importlib", 3, False, None, None), (14, "m", 3, True, "", None), (14, "importlib", 4, False, None, None),
           (15, "request", 4, False, None, "urllib.request"), (15, "f", 4, True, "", None), (15, "os", 4, False, None, None),
           (15, "f", 4, True, "", None), (15, "os", 5, False, None, None), (15, "f", 5, True, "", None),
           (16, "base64", 2, False, None, None), (16, "os", 2, False, None, None), (16, "os", 3, False, None, None),
           (17, "base64", 2, False, None, None), (17, "exec", 5, False, None, None), (17, "a", 5, False, None, None),
           (18, "base64", 2, False, None, None), (18, "exec", _LAST, False, None, None), (18, f"v{CHAIN}", _LAST, True, "", None),
           *[(18, f"v{i - 1}", i + 2, True, "", None) for i in range(1, CHAIN + 1)],
           (19, "system", 2, False, None, "os.system"), (19, f"e{CHAIN}", _LAST, True, "", None),
           *[(19, f"e{i - 1}", i + 2, True, "", None) for i in range(1, CHAIN + 1)]]


@register("def_use", _doc_join(DEF_USE, ["t", "name", "line", "found", "scope", "alias_target"],
                               "d.doc_id, v.name, v.line, v.found, v.scope, v.alias_target"))
def def_use(spark, sf):
    """Each name read, whether a definition is visible (innermost scope,
    latest before the read), its scope and the import alias in force."""
    res = scanned(spark, sf)
    n = res.name_info.join(res.facts.nodes.select("file_id", "seq", F.col("lineno").alias("line")),
                           ["file_id", "seq"])
    n = checkpoint_cut(n, bucket="file_id")  # joined where the tables of the scan lie
    return n.select(F.col("file_id").alias("doc_id"), "name", "line", F.col("rec_seq").isNotNull().alias("found"),
                    F.col("rec_ns").alias("scope"), "alias_target")


_FILE = "'/pkg' || cast(d.doc_id % 50 as varchar) || '/mod' || cast(d.doc_id as varchar) || '.py'"
_NUMBERS = ["files", "lines", "cnt", "low", "medium", "high"]
_SUMS = ", ".join(f"'{c}': cast(sum({c}) as bigint)" for c in _NUMBERS)
_ONES = ", ".join(f"'{c}': cast({c} as bigint)" for c in _NUMBERS)
_PER_FILE = _doc_join(METRICS, _METRIC_COLS, f"{_PKG} as package, {_FILE} as file_path, v.*")
_PER_ISSUE = _doc_join(ISSUES, ["t", "rule_id", "sink_line", "taint_key", "severity", "confidence", "msg"],
                       f"{_PKG} as package, {_FILE} as file_path, v.*")


@register("scan_report", f"""
select package, 'package' as kind, cast(to_json({{'package': package, {_SUMS}}}) as varchar) as json from ({_PER_FILE}) f group by package
union all
select package, 'file', cast(to_json({{'file_path': file_path, {_ONES}}}) as varchar) from ({_PER_FILE}) f
union all
select package, 'issue', cast(to_json({{'file_path': file_path, 'id': rule_id, 'lineno': sink_line, 'severity': severity,
  'confidence': confidence, 'msg': msg}}) as varchar) from ({_PER_ISSUE}) i
""")
def scan_report(spark, sf):
    """The report as JSON lines -- a line per package with its totals, per
    scanned file with its metrics, and per issue.  A package may hold any
    number of files, so its report is lines, not one document."""
    res = scanned(spark, sf)
    files = file_metrics(res)
    total = files.groupBy("package").agg(*[F.sum(c).alias(c) for c in _NUMBERS])
    issue = res.scan.issues.join(res.files.select("file_id", "package"), "file_id")
    line = lambda df, kind, *cols: df.select("package", F.lit(kind).alias("kind"), F.to_json(F.struct(*cols)).alias("json"))
    return line(total, "package", "package", *_NUMBERS).unionByName(
        line(files, "file", "file_path", *_NUMBERS)).unionByName(
        line(issue, "issue", "file_path", "id", F.col("sink.lineno").alias("lineno"), "severity", "confidence", "msg"))
