import math
import struct
import zlib

import xxhash

from pkgsieve.llm import sharding
from tests.conftest import SF_SMALL
from tests.llm.helpers import docs, edge_rows


def check(rows, texts, shards=40):
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert 0 <= r["shard"] < shards and r["grown_shard"] in (r["shard"], shards)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted(((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in texts), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=repr) == want


def shard_of(key, weights):
    """Weighted rendezvous by Python's own XXH64: the name's hash seeds that of the shard's number."""
    name = xxhash.xxh64_intdigest(("\0null" if key is None else str(key)).encode(), 42)

    def score(shard, weight):
        u = ((xxhash.xxh64_intdigest(struct.pack("<i", shard), name) >> 11) + 0.5) / 2.0 ** 53
        return -weight / math.log(u)

    return max(range(len(weights)), key=lambda k: (score(k, weights[k]), -k))


def test_shards_are_recomputed(spark):
    from pkgsieve.llm.queries import QUERIES

    for r in QUERIES["op5_rendezvous_shards"](spark, SF_SMALL).collect():
        assert (r["shard"], r["grown_shard"]) == (shard_of(r["doc_id"], [1.0] * 40), shard_of(r["doc_id"], [1.0] * 41))
    weights = [0.5, 3.0, 1.0, 2.0]
    for r in sharding.place(docs(spark, edge_rows()), weights=weights, grown=2.5).collect():
        assert (r["shard"], r["grown_shard"]) == (shard_of(r["doc_id"], weights), shard_of(r["doc_id"], [*weights, 2.5]))


def test_query(spark):
    from pkgsieve.llm.queries import QUERIES

    rows = QUERIES["op5_rendezvous_shards"](spark, SF_SMALL).collect()
    source = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    check(rows, [(r["doc_id"], r["text"]) for r in source])


def test_edges_and_small_blocks(spark):
    df = docs(spark, edge_rows(), clash=True)
    rows = sharding.number(sharding.place(df), rows_per_block=2).collect()
    check(rows, [(r[0], r[1]) for r in edge_rows()])
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add((r["shard"], r["grown_shard"]))
    assert all(len(v) == 1 for v in by.values())  # the key alone decides
    assert sharding.number(sharding.place(docs(spark, []))).count() == 0


def test_weights_and_growth(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "'t' as text")
    rows = sharding.place(df, weights=(1.0, 2.0, 1.0)).collect()
    share = [sum(r["shard"] == k for r in rows) / len(rows) for k in range(3)]
    assert abs(share[1] - 0.5) < 0.02 and abs(share[0] - 0.25) < 0.02
    moved = sum(r["shard"] != r["grown_shard"] for r in rows) / len(rows)
    assert abs(moved - 0.2) < 0.02 and all(r["grown_shard"] in (r["shard"], 3) for r in rows)
