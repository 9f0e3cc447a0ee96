"""NN-descent links and components against comparing all pairs."""
import numpy as np
import pytest

from tests.llm.helpers import CLASH

SCHEMA = "vec_id long, embedding array<float>, label int"
COLS = ["vec_id", "n_links", "component_id", "kept"]


def frame(spark, rows, clash=False):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    return df.selectExpr("*", *[f"'own {c}' as `{c}`" for c in (*CLASH, "vid", "h1", "vec", "unit", "near") if c != "label"]) if clash else df


def plain(rows, threshold=0.9):
    """All pairs of rows, in double precision."""
    size = max((len(v) for _, v in rows if v), key=[len(v) for _, v in rows if v].count, default=0)
    ok = [v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    x = [np.array(v, dtype=np.float64) if k else None for (_, v), k in zip(rows, ok)]
    x = [v / np.linalg.norm(v / np.abs(v).max()) / np.abs(v).max() if v is not None else None for v in x]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    good = [i for i in range(len(rows)) if ok[i]]
    m = np.array([x[i] for i in good]).reshape(len(good), -1)
    for a, b in zip(*np.nonzero(np.triu(m @ m.T >= threshold, 1))):
        i, j = good[a], good[b]
        links[i] += 1
        links[j] += 1
        root[find(i)] = find(j)
    out = []
    for i, (vec_id, _) in enumerate(rows):
        same = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        component = min(same, default=None)
        out.append((vec_id, links[i], component, vec_id is not None and vec_id == component))
    return sorted(out, key=repr)


def near(rnd, center, n, spread):
    v = center + rnd.normal(size=(n, len(center))) * spread
    return [[float(np.float32(x)) for x in r] for r in v]


def got(graph):
    return sorted((tuple(r[c] for c in COLS) for r in graph.table.collect()), key=repr)


def test_groups_pairs_copies_and_edges(spark):
    from pkgsieve.llm import nndescent

    rnd = np.random.default_rng(8)
    center = lambda: rnd.normal(size=32)
    rows = near(rnd, np.zeros(32), 150, 1.0) + near(rnd, center(), 90, 0.15)  # far ones, a tight group
    rows += near(rnd, center(), 130, 0.28)  # a wide group, many pairs about the threshold
    for _ in range(20):
        rows += near(rnd, center(), 2, 0.1)
    copy = rows[160]
    rows += [copy] * 40 + [[0.0] * 32, None, [float("nan")] * 32, [float("inf")] + [1.0] * 31, [None] + [1.0] * 31, [1.0, 2.0], []]
    rows += [[2.0 * x for x in rows[0]], [1e30 * x for x in rows[1]], [1e-30 * x for x in rows[2]]]
    rows = [(i if i % 50 != 7 else None, v) for i, v in enumerate(rows)]
    rows.append((3, rows[3][1]))
    g = nndescent.neighbour_graph(frame(spark, rows, clash=True), target=1.0)
    want, have = plain(rows), got(g)
    assert g.recall == 1.0
    assert have == want


def test_lists_grow_and_find_what_few_draws_miss(spark, monkeypatch):
    """One draw in tiny blocks leaves links out; rounds and the audit find them."""
    from pkgsieve.llm import nndescent

    monkeypatch.setattr(nndescent, "BLOCK", 16)
    monkeypatch.setattr(nndescent, "DRAWS", 1)
    rnd = np.random.default_rng(2)
    rows = near(rnd, np.zeros(24), 300, 1.0)
    for n in (2, 3, 9, 25, 60):
        rows += near(rnd, rnd.normal(size=24), n, 0.12)
    rows = list(enumerate(rows))
    g = nndescent.neighbour_graph(frame(spark, rows), target=0.999)
    want, have = plain(rows), got(g)
    assert g.recall >= 0.999 and sum(r[1] for r in have) >= 0.99 * sum(r[1] for r in want)
    assert {(r["a"], r["b"]) for r in g.links.collect()}  # all verified: none below the threshold
    assert all(a[1] <= b[1] for a, b in zip(have, want))


@pytest.mark.parametrize("threshold", [0.5, 0.99])
def test_dense_counts_are_exact(spark, threshold):
    from pyspark.sql import functions as F

    from pkgsieve.llm import nndescent

    rnd = np.random.default_rng(1)
    rows = list(enumerate(near(rnd, rnd.normal(size=16), 700, 0.3)))
    members = frame(spark, rows).select(F.lit(5).cast("long").alias("label"), F.col("vec_id").alias("vid"),
                                        F.lit(1).cast("long").alias("weight"), F.col("embedding").alias("vec"))
    n = {r["vid"]: r["n"] for r in nndescent.dense_counts(members, 16, threshold).collect()}
    assert [n[i] for i in range(700)] == [r[1] for r in sorted(plain(rows, threshold))]


def test_empty_and_single(spark):
    from pkgsieve.llm import nndescent

    assert got(nndescent.neighbour_graph(frame(spark, []))) == []
    one = [(4, [1.0, 0.0]), (5, None), (None, None)]
    assert got(nndescent.neighbour_graph(frame(spark, one))) == plain(one)
