from pkgsieve.llm import mixing
from tests.llm.helpers import docs, edge_rows, tuples, words


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        unit = budget / sum(w[s] for s in free)
        above = {s for s in free if 2 * sizes[s] <= unit * w[s]}
        if not above:
            break
        for s in above:
            target[s] = 2.0 * sizes[s]
            budget -= target[s]
        free -= above
    for s in free:
        target[s] = budget * w[s] / sum(w[x] for x in free)
    return target


def test_targets_equal_brute_force(spark):
    for sizes in ({"a": 100, "b": 1000, "c": 10, "d": 5, None: 7}, {"a": 0, "b": 3}, {None: 4}, {"x": 0},
                  {f"s{i:02}": (i * 37) % 101 for i in range(40)}):
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_plan_sizes_copies_and_reruns(spark):
    df = docs(spark, edge_rows(), clash=True)
    a, b = tuples(mixing.mix_plan(df)), tuples(mixing.mix_plan(df.repartition(7)))
    assert a == b and len(a) == len(edge_rows())
    assert sorted(r["size"] for r in mixing.mix_plan(df).collect()) == sorted(len(words(r[1])) for r in edge_rows())
    assert all(r["taken"] <= 2 * r["size"] for r in mixing.mix_plan(df).collect())


def test_taken_words_come_near_the_targets(spark):
    rows = [(i, " ".join(["w"] * (5 + i % 7)), "en", "abc"[i % 3] if i % 2 else "hot", 1) for i in range(6000)]
    per = {}
    for r in mixing.mix_plan(docs(spark, rows)).collect():
        t = per.setdefault(r["source"], [0, r["target"]])
        t[0] += r["taken"]
    assert all(abs(taken - target) < 0.06 * target for taken, target in per.values())


def test_mix_repeats_whole_rows(spark):
    df = docs(spark, edge_rows(), clash=True)
    out = mixing.mix(df)
    assert out.columns == df.columns
    times = {}
    for r in mixing.mix_plan(df).collect():
        times[r["doc_id"], r["source"], r["size"]] = times.get((r["doc_id"], r["source"], r["size"]), 0) + r["copies"]
    got = {}
    for r in out.collect():
        k = r["doc_id"], r["source"], len(words(r["text"]))
        got[k] = got.get(k, 0) + 1
        assert r["__size"] == "own __size"
    assert got == {k: n for k, n in times.items() if n}


def test_empty_table(spark):
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.mix_plan(docs(spark, [])).count() == 0
