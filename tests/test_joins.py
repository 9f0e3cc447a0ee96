"""Blocked fuzzy joins equal brute force on a small fixture; blocked prefix
scans equal the plain window."""
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from pkgsieve.functions.names import probe_keys, segment_keys
from pkgsieve.operators import signals as S
from pkgsieve.operators.folds import prefix_last, prefix_sum


def _py_lev(a, b):
    d = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        prev, d[0] = d[0], i
        for j, cb in enumerate(b, 1):
            prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (ca != cb))
    return d[-1]


def _py_swap(a, b):
    if len(a) != len(b):
        return False
    diff = [i for i in range(len(a)) if a[i] != b[i]]
    return len(diff) == 2 and a[diff[0]] == b[diff[1]] and a[diff[1]] == b[diff[0]]


def test_blocked_vs_brute_force(spark):
    random.seed(7)
    pop = sorted({"".join(random.choice("abcd") for _ in range(random.randint(3, 6))) for _ in range(60)})
    names = [(i, "".join(random.choice("abcd") for _ in range(random.randint(2, 7)))) for i in range(400)]
    n = spark.createDataFrame(names, "nid long, name string")
    p = spark.createDataFrame([(x, 1) for x in pop], "pname string, download_count long")
    for d in (1, 2, 3):
        got = {(r.nid, r.pname) for r in S.levenshtein_pairs(n, p, d).collect()}
        exp = {(i, q) for i, a in names for q in pop if 0 < _py_lev(a, q) <= d}
        assert got == exp, d
    got = {(r.nid, r.pname) for r in S.swap_pairs(n, p).collect()}
    assert got == {(i, q) for i, a in names for q in pop if _py_swap(a, q)}


def test_segments_equal_brute_force_for_up_to_four_edits(spark):
    rnd = random.Random(9)
    base = ["".join(rnd.choice("abcdeé字") for _ in range(rnd.randint(0, 14))) for _ in range(40)]

    def edit(s, n):
        for _ in range(n):
            i = rnd.randrange(len(s) + 1)
            s = rnd.choice([s[:i] + rnd.choice("abcx") + s[i:], s[:i] + s[i + 1:], s[:i] + rnd.choice("abcx") + s[i + 1:]])
        return s

    names = list(enumerate([edit(rnd.choice(base), rnd.randrange(6)) for _ in range(300)] + base[:20] + ["", "a"]))
    n = spark.createDataFrame(names, "nid long, name string")
    p = spark.createDataFrame([(x, 1) for x in sorted(set(base))], "pname string, download_count long")
    dist = {(i, q): _py_lev(a, q) for i, a in names for q in set(base)}
    for d in (1, 2, 3, 4):
        got = {(r.nid, r.pname) for r in S.levenshtein_pairs(n, p, d).collect()}
        assert got == {k for k, v in dist.items() if 0 < v <= d}, d


def test_probe_keys_do_not_grow_with_the_name(spark):
    df = spark.createDataFrame([("abcdefghij" * k,) for k in (2, 4, 40)], "name string")
    for d, most in ((2, 19), (3, 44), (4, 85)):
        assert {r[0] for r in df.select(F.size(probe_keys("name", d))).collect()} <= set(range(1, most + 1))
        assert {r[0] for r in df.select(F.size(segment_keys("name", d))).collect()} == {d + 1}


def test_prefix_scans_equal_window(spark):
    random.seed(1)
    rows = [(i, random.choice("abc"), random.choice([None, None, "x", "y"]), random.randint(0, 3))
            for i in range(0, 2000, 3)]
    df = spark.createDataFrame(rows, "s long, k string, v string, n int")
    for keys in ([], ["k"]):
        got = prefix_sum(prefix_last(df, keys, "s", F.col("v"), "o", block=40), keys, "s", F.col("n"), "t", block=40)
        w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("s")
        exp = df.select("s", F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("o"),
                        F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("t"))
        assert {(r.s, r.o, r.t) for r in got.collect()} == {(r.s, r.o, r.t) for r in exp.collect()}
