"""Taint arrivals block by block against one pass over all edges in time order."""
import random

import pytest
from pyspark.sql import functions as F

from pkgsieve.taint import arrivals

EDGES = "file_id long, r int, a long, b long, lines array<int>"
SEEDS = "file_id long, rid long, tid long, at int, line int, guarded boolean"


def plain(edges, seeds):
    out = {}
    for file in {e[0] for e in edges} | {s[0] for s in seeds}:
        held, how = {}, {t: (line, guarded) for f, _, t, _, line, guarded in seeds if f == file}
        rows = sorted([(s[3], 0, s) for s in seeds if s[0] == file] + [(e[1], 1, e) for e in edges if e[0] == file])
        for r, is_edge, x in rows:
            if not is_edge:
                held.setdefault(x[1], {}).setdefault(x[2], r)
                continue
            for tid, at in list(held.get(x[2], {}).items()):
                line, guarded = how[tid]
                if at < r and not (guarded and line in x[4]):
                    held.setdefault(x[3], {}).setdefault(tid, r)
        out.update({(file, rec, tid): at for rec, taints in held.items() for tid, at in taints.items()})
    return out


def case(seed, files=6, visits=300, records=25, taints=6):
    rnd = random.Random(seed)
    edges, seeds = [], []
    for file in range(files):
        lines = {t: rnd.randrange(1, 9) for t in range(taints)}
        for r in range(0, visits, rnd.choice([1, 2, 3])):
            a = rnd.randrange(records)
            for b in {rnd.randrange(records) for _ in range(rnd.choice([0, 1, 1, 2]))} - {a}:
                edges.append((file, r, a, b, sorted({rnd.randrange(1, 40) for _ in range(rnd.randrange(1, 4))})))
        for t in range(taints):
            for rec in {rnd.randrange(records) for _ in range(rnd.randrange(1, 3))}:
                seeds.append((file, rec, t, rnd.randrange(visits), lines[t], t % 2 == 0))
    chain = [(files, 2 * i + 1, i, i + 1, [i % 7]) for i in range(visits // 2)]
    return edges + chain, seeds + [(files, 0, 1, 0, 99, False), (files, 0, 2, 0, 5, True), (files, 40, 3, 81, 9, True)]


@pytest.mark.parametrize("block", [1, 7, 40, 1 << 15])
def test_blocks_equal_one_pass(spark, block):
    for seed in (1, 2):
        edges, seeds = case(seed)
        e, s = spark.createDataFrame(edges, EDGES), spark.createDataFrame(seeds, SEEDS)
        long_files = e.where(F.col("r") >= block).select("file_id").distinct()
        got = arrivals.earliest(e, s, long_files, block).collect()
        assert len(got) == len({(r["file_id"], r["rid"], r["tid"]) for r in got})
        assert {(r["file_id"], r["rid"], r["tid"]): r["at"] for r in got} == plain(edges, seeds)


def test_a_large_file_is_shared_by_tasks(spark):
    """The rows of a file are dealt by block: no task gets all."""
    edges = [(1, r, r, r + 1, [1]) for r in range(4000)]
    e = spark.createDataFrame(edges, EDGES).withColumn("blk", F.floor(F.col("r") / 100).cast("int"))
    dealt = arrivals._dealt(arrivals._rows(e, first=F.lit(False)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little data would be put together
    try:
        sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 2000 and sum(sizes) == 4000


def test_small_blocks_share_a_batch(monkeypatch):
    from pkgsieve.taint import arrivals

    rows = [r for f in range(50) for r in ((f, 0, False, 1, None, 7, 70, 1, False, None, None, None), (f, 0, False, 5, 7, 8, None, None, None, [5], None, None))]
    given = arrivals._batch(rows, ", ".join(f"{c} {k}" for c, k in zip(arrivals.ROWS, arrivals.KINDS)))
    found = list(arrivals._within([given]))
    assert [b.num_rows for b in found] == [100]
    assert [tuple(r.values()) for r in found[0].to_pylist()[:2]] == [(0, 7, 70, 1), (0, 8, 70, 5)]
    monkeypatch.setattr(arrivals, "BATCH", 10)
    assert pa_rows(arrivals._within([given])) == pa_rows(found)


def pa_rows(batches):
    return [r for b in batches for r in b.to_pylist()]
