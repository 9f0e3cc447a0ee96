"""Orchard search against comparing all entries; codes against a plain version."""
import hashlib
import math
import random

import numpy as np
import pytest

from tests.llm.helpers import CLASH

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows, clash=False):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", *[f"'own {c}' as `{c}`" for c in (*CLASH, "v", "code", "error", "n") if c != "label"]) if clash else df


def nearest(entries, x):
    return min((sum((a - b) ** 2 for a, b in zip(e, x)), i) for i, e in enumerate(entries))


@pytest.mark.parametrize("seed", range(6))
def test_search_equals_all_comparisons_and_makes_fewer(seed):
    from pkgsieve.llm.orchard import Orchard

    rnd = np.random.default_rng(seed)
    spread = [3, 10, 300][seed % 3]  # small spreads make many ties and equal entries
    entries = rnd.integers(-spread, spread + 1, (64 if seed else 1, 4))
    points = rnd.integers(-spread, spread + 1, (500, 4))
    index, dist, compared = Orchard(entries).nearest(points)
    assert [(int(d), int(i)) for d, i in zip(dist, index)] == [nearest(entries.tolist(), p) for p in points.tolist()]
    assert compared <= len(points) * len(entries)
    if spread == 300:
        assert compared < 0.8 * len(points) * len(entries)


def plain(rows, parts=16, size=64, rounds=2):
    """The codes by Python loops over all entries."""
    good = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not good:
        return []
    w = len(good[0][1]) // parts
    cut = lambda v, p: v[p * w:(p + 1) * w]
    books = [[cut(v, p) for _, v, _ in good[:size]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            at = [nearest(books[p], cut(v, p))[1] for _, v, _ in good]
            for e in range(len(books[p])):
                mine = [cut(v, p) for k, (_, v, _) in zip(at, good) if k == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    out = []
    for i, v, lab in good:
        best = [nearest(books[p], cut(v, p)) for p in range(parts)]
        out.append((i, "".join("%02x" % e for _, e in best), sum(d for d, _ in best), lab))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, c, d, sum(r[2] for r in out if r[3] == lab), sha) for i, c, d, lab in out]


def test_edges_equal_plain_version(spark):
    from pkgsieve.llm import orchard

    rnd = random.Random(5)
    row = lambda: [rnd.choice([-2.5, -0.3, 0.0, 0.001, 0.4, 1.7]) + rnd.random() / 9 for _ in range(32)]
    f32 = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, f32(row()), i % 3) for i in range(150)]
    rows += [(500 + i, rows[7][1], None) for i in range(90)]  # a large group of copies, null labels
    rows += [(200, None, 1), (201, [None] + f32(row())[1:], 1), (202, [float("nan")] * 32, 1),
             (203, [float("inf")] + [0.0] * 31, 1), (None, f32(row()), 1), (3, rows[3][1], 1), (3, f32(row()), None)]
    got = sorted(tuple(r) for r in orchard.compress(vectors(spark, rows, clash=True)).collect() if r["vec_id"] is not None)
    assert got == sorted(r for r in plain(rows) if r[0] is not None)


def test_few_empty_and_odd_rows(spark):
    from pkgsieve.llm import orchard

    few = [(1, [1.0, 2.0, 3.0], 0), (2, [5.0, 6.0, 7.0], 0), (3, [1.0], 0), (4, [3.0e38, -3.0e38, 0.0], 1)]
    out = {r["vec_id"]: r for r in orchard.compress(vectors(spark, few), parts=2).collect()}
    assert sorted(out) == [1, 2, 4]  # vec 3 has another length
    assert [out[i]["code"] for i in (1, 2, 4)] == ["0000", "0101", "0202"] and all(r["error"] == 0 for r in out.values())
    for none in ([], [(1, None, 2), (2, [], 1)]):
        assert [r["error"] for r in orchard.compress(vectors(spark, none)).collect()] in ([], [0])


def test_decode_is_near(spark):
    from pkgsieve.llm import orchard

    rnd = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rnd.normal(size=32)], 0) for i in range(64)]
    q = orchard.quantised(vectors(spark, rows))
    books = orchard.fit(q)
    back = {r["vec_id"]: r["embedding"] for r in orchard.decode(orchard.encode(q, books), books).collect()}
    want = {i: v for i, v, _ in rows}
    err = np.mean([(np.array(back[i]) - np.array(want[i])) ** 2 for i in want])
    assert err < 0.2  # a part of two components has 64 entries for 64 vectors
