"""Literal assertions carried over from the reference tests (FIXTURES §1)."""

from pkgsieve.functions import actions as A
from pkgsieve.functions import labels as L
from pkgsieve.functions.names import is_swap, within_distance

# Name pairs whose distances and swaps the reference states.
LEV = [("alic3", True), ("allice", True), ("alie", True), ("aice", True), ("aalice", True),
       ("aallice", False), ("alice", False)]
SWAP = [("alice", "ailce", True), ("alice", "alice", False), ("alice", "alcie", True), ("alice", "alice1", False),
        ("alice", "cliae", True), ("alice", "aicle", False), ("aaabbb", "ababba", True), ("aaabbb", "baabab", True),
        ("aaabbb", "aabbba", True)]


def test_levenshtein_literals(spark):
    df = spark.createDataFrame([("alice", b, e) for b, e in LEV], "a string, b string, e boolean")
    got = df.select(within_distance("a", "b", 1).alias("g"), "e").collect()
    assert all(r.g == r.e for r in got)


def test_swap_literals(spark):
    df = spark.createDataFrame(SWAP, "a string, b string, e boolean")
    got = df.select(is_swap("a", "b").alias("g"), "e").collect()
    assert all(r.g == r.e for r in got)


def test_action_literals(spark):
    rows = [
        ("add py2.py3 file some_lib-1.2.3-py2.py3-none-any.whl", "some_lib-1.2.3-py2.py3-none-any.whl", None),
        ("add source file some-lib-1.2.3.tar.gz", "some-lib-1.2.3.tar.gz", None),
        ("add py3 file tiny-0.1-py3-none-any.whl", "tiny-0.1-py3-none-any.whl", None),
        ("nothing known", None, None),
        ("remove file tiny-0.1-py3-none-any.whl", "tiny-0.1-py3-none-any.whl", None),
        ("remove file a-b-c-4.5.6.tar.gz", "a-b-c-4.5.6.tar.gz", None),
        ("add Owner user1", None, "user1"),
        ("invite Owner user2", None, "user2"),
        ("accepted Owner user3", None, "user3"),
        ("remove Owner user4", None, "user4"),
        ("change Owner user5 to Maintainer", None, "user5"),
    ]
    df = spark.createDataFrame(rows, "a string, f string, o string")
    got = df.select(A.filename_from_action("a").alias("gf"), A.owner_from_action("a").alias("go"), "f", "o").collect()
    assert all(r.gf == r.f and r.go == r.o for r in got)


def test_action_kind_order(spark):
    df = spark.createDataFrame([("create",), ("remove project",), ("add Owner x",), ("invite Maintainer y",),
                                ("new release",), ("yank release",), ("unyank release",), ("remove file a.whl",),
                                ("remove release",), ("docs update",)], "a string")
    kinds = [r.k for r in df.select(A.action_kind("a").alias("k")).collect()]
    assert kinds == ["create", "remove project", "add_owner", "invite_maintainer", "new release", "yank release",
                     "unyank release", "file", "remove release", "other"]


def test_version_parse(spark):
    df = spark.createDataFrame([("beautifulsoup4", "beautifulsoup4-4.12.2.tar.gz"), ("pkg-12", "pkg-12-1.3.tar.gz"),
                                ("p", "p-1.0a.tar.gz")], "p string, f string")
    got = df.select(A.version_from_filename("p", "f").alias("v"),
                    A.version_from_filename("p", "f", strict=True).alias("s")).collect()
    assert [r.v for r in got] == ["4.12.2", ".3", "1.0"]      # character-set semantics (compat)
    assert [r.s for r in got] == ["4.12.2", "1.3", "1.0a"]   # literal prefix / suffix


def test_labels(spark):
    df = spark.createDataFrame([(10,), (7,), (6,), (4,), (0,), (-1,)], "s int")
    assert [r.l for r in df.select(L.rank_label("s").alias("l")).collect()] == \
        ["high", "high", "medium", "medium", "low", None]
    p = spark.createDataFrame([("a/b.tar.gz",), ("x.whl",), ("m.py",), (".bashrc",), ("a.b.c",)], "p string")
    got = p.select(L.extension("p").alias("e"), L.mime_type("p").alias("m")).collect()
    assert [r.e for r in got] == [".tar.gz", ".whl", ".py", "", ".c"]
    assert [r.m for r in got] == ["application/gzip", "application/x-wheel+zip", None, None, None]
