"""Scanner behaviour on small hand-written programs (expected issues derived
by reading the rule semantics)."""
from pyspark.sql import functions as F

from pkgsieve.taint.scanner import TEMPLATES, file_metrics, scan_corpus

EXTRA = {
    100: 'import os\nx = os.environ\nexec(x)',                       # attribute taint rule (os.environ)
    101: 'import base64\na = base64.b64decode("x")\ndel a\nexec(a)',   # del removes the record
    102: 'import base64\nwith open("f") as h:\n    h2 = base64.b64decode(h)\nexec(h2)',
    103: 'def f(:\n    pass',                                         # does not parse -> quarantined
    104: 'import base64\nx = base64.b64decode("q")\nx = f(x)\nexec(x)',  # x = f(x): the right side sees the reset x
    105: 'class A:\n    import os\n    def m(self, c):\n        os.system(c)',
    # X11: a constant tainted as an argument taints later equal constants
    106: 'from urllib import request\nrequest.urlretrieve("u", "p.sh")\nimport os\nos.system("p.sh")',
    # A call base is dropped from the callee name, so this is "exec"
    107: 'def f():\n    pass\nf().exec("x")',
    # An argument taint does not leave a node on its own line ...
    108: 'from urllib import request\nimport os\nf = "p"\nrequest.urlretrieve("u", f); os.system(f + "x")',
    # ... but does on a later line
    109: 'from urllib import request\nimport os\nf = "p"\nrequest.urlretrieve("u", f)\nos.system(f + "x")',
}


def _corpus(spark, files):
    rows = [(fid, f"pkg{fid % 3}", f"/p/{fid}.py", src) for fid, src in files.items()]
    return spark.createDataFrame(rows, "file_id long, package string, path string, content string")


def _issues(res):
    return {(r.file_id, r.id, r.lineno, r.k) for r in res.scan.issues.select(
        "file_id", "id", "sink.lineno", F.coalesce("taint.function", "taint.attribute", "taint.type").alias("k"))
        .collect()}


def test_templates_and_extras(spark):
    files = {t: src for t, src in enumerate(TEMPLATES)}
    files.update(EXTRA)
    res = scan_corpus(_corpus(spark, files))
    got = _issues(res)
    exp_templates = {(1, "1000", 1, "*"), (2, "1000", 3, "*"), (2, "1001", 3, "base64.b64decode"),
                     (3, "1000", 4, "*"), (3, "1002", 4, "requests.get"), (4, "1000", 3, "*"), (5, "1000", 2, "*"),
                     (6, "1000", 4, "*"), (7, "1000", 5, "*"), (7, "1002", 5, "urllib.request.urlretrieve"),
                     (8, "2001", 3, "base64.b64encode"), (9, "1000", 4, "*"), (9, "1001", 4, "base64.b64decode"),
                     (9, "1000", 5, "*")}
    assert {g for g in got if g[0] < 10} == exp_templates
    # os.environ is a sensitive-info taint; no shipped detection pairs it with exec except type "*"
    assert (100, "1000", 3, "*") in got
    # after `del a`, `a` is unknown: only the wildcard issue remains
    assert {g for g in got if g[0] == 101} == {(101, "1000", 4, "*")}
    assert (102, "1001", 4, "base64.b64decode") in got
    # x = f(x): targets are reset before the right side is read, so the decoder taint is gone
    assert {g for g in got if g[0] == 104} == {(104, "1000", 4, "*")}
    assert (105, "1000", 4, "*") in got
    assert {g for g in got if g[0] == 106} == {(106, "1000", 4, "*"), (106, "1002", 4, "urllib.request.urlretrieve")}
    assert {g for g in got if g[0] == 107} == {(107, "1000", 3, "*")}
    assert {g for g in got if g[0] == 108} == {(108, "1000", 4, "*")}
    assert {g for g in got if g[0] == 109} == {(109, "1000", 5, "*"), (109, "1002", 5, "urllib.request.urlretrieve")}
    errors = {r.file_id for r in res.facts.errors.collect()}
    assert errors == {103}
    m = {r.file_id: (r.lines, r.cnt) for r in file_metrics(res).collect()}
    assert 103 not in m and m[9] == (6, 3) and m[0] == (2, 0)


def _chain(n):
    steps = "\n".join(f"v{i} = v{i - 1}" for i in range(1, n + 1))
    return f'import base64\nv0 = base64.b64decode("q")\n{steps}\nexec(v{n})'


CHAINS = {
    200: _chain(250),                                                   # a decoded value copied 250 times
    201: "from os import system\ne0 = system\n" + "\n".join(f"e{i} = e{i - 1}" for i in range(1, 251)) + '\ne250("x")',
    202: "import os\na0 = os\n" + "\n".join(f"a{i} = a{i - 1}" for i in range(1, 40)) + '\nb = a39.path\nc = b\nc.join("x")',
    # y brings the taint to the list later than x does, but to `a` before exec reads it
    203: 'import base64\nx = base64.b64decode("q")\ny = x\na = [y, exec(a), x]',
    # a name deleted in an inner scope is gone from the scope where it is found
    204: 'import base64\na = base64.b64decode("q")\ndef f():\n    del a\nexec(a)',
    205: 'import base64\ndef f(a):\n    del a\n    del a\na = base64.b64decode("q")\nexec(a)',
    206: 'import base64\na = base64.b64decode("q")\ndef f(a):\n    del a\nexec(a)',
    207: 'import base64\na = base64.b64decode("q")\nx = ' + " + ".join(["a"] * 2000) + "\nexec(x)",
    208: 'import base64, os\nos.k = base64.b64decode("q")\nexec(os.k)',      # a dotted target
    209: 'import base64\nwith base64.b64decode("q") as h:\n    exec(h)',    # a with target
    210: 'import importlib\nm = importlib.import_module("path", "os.")\nimportlib.import_module(".system", "os")("x")',
    211: '__import__("importlib").import_module("os").system("x")',       # an import through an import
    212: 'x = x.y\nx("q")',                                             # a name read by the statement that binds it
}


def test_long_chains_and_arrival_times(spark):
    for parts in ("1", "40"):
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            res = scan_corpus(_corpus(spark, CHAINS))
            got = _issues(res)
            calls = {(r.file_id, r.lineno, r.func) for r in res.call_names.collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)
        decoded = {(f, line) for f, rule, line, _ in got if rule == "1001"}
        assert decoded == {(200, 253), (203, 4), (206, 5), (207, 4), (208, 3), (209, 3), (205, 6)}
        assert (201, "1000", 253, "*") in got  # a name copied 250 times
        assert (202, 44, "os.path.join") in calls
        assert (210, 3, "") in calls and (211, 1, "os.system") in calls
        assert (212, 2, "x.y") in calls
        assert not res.facts.errors.count()
