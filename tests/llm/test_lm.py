import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pkgsieve.llm import lm
from pkgsieve.llm.queries import QUERIES
from tests.conftest import SF_SMALL
from tests.llm.helpers import ascii_lower, docs, edge_rows, words


def tokens(text):
    return words(ascii_lower(text or "")) + ["\n"]


def counts(rows, keep):
    uni, bi, starts = Counter(), Counter(), 0
    for fold, t in rows:
        if keep(fold):
            uni.update(t)
            bi.update(zip(["\r", *t], t))
            starts += 1
    uni_context = Counter(uni)
    uni_context["\r"] = starts
    return uni, uni_context, bi


def brute(rows):
    """(score, base) of each text of (fold, text), with weights learned likewise."""
    rows = [(f, tokens(t)) for f, t in rows]
    uni, context, bi = counts(rows, lambda f: f == lm.KEPT)
    n, v = sum(uni.values()), len(uni)
    bucket = lambda c: min(math.frexp(c)[1], lm.BUCKETS - 1)
    held = [(bucket(context[a]), bi[a, b] / context[a] if context[a] else 0.0, uni[b] / max(n, 1), 1 / (v + 1))
            for f, t in rows if f == lm.DELETED for a, b in zip(["\r", *t], t)]
    weights = np.full((lm.BUCKETS, 3), 1 / 3)
    while True:
        sums = np.zeros((lm.BUCKETS, 3))
        for k, *f in held:
            e = weights[k] * f
            sums[k] += e / e.sum()
        new = np.where(sums.sum(1, keepdims=True) > 0, sums / np.maximum(sums.sum(1, keepdims=True), 1e-300), weights)
        change, weights = np.abs(new - weights).max(), new
        if change < lm.TOLERANCE:
            break
    seen = sums.sum(1) > 0
    for k in range(2, lm.BUCKETS):
        if not seen[k] and seen[k - 1]:
            weights[k], seen[k] = weights[k - 1], True
    weights[0, 0] = 0
    weights = np.maximum(weights, [0, lm.FLOOR, lm.FLOOR])
    weights /= weights.sum(1, keepdims=True)
    uni, context, bi = counts(rows, lambda f: f != lm.TEST)
    n, v = sum(uni.values()), len(uni)
    out = []
    for _, t in rows:
        score = 0.0
        for a, b in zip(["\r", *t], t):
            w = weights[bucket(context[a])]
            score += math.log10(w[0] * bi[a, b] / max(context[a], 1) + w[1] * uni[b] / max(n, 1) + w[2] / (v + 1))
        out.append((len(t), sum(uni[x] > 0 for x in t), n, sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t), score))
    return out


def compare(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert tuple(g[:3]) == w[:3]
        assert g[3] == pytest.approx(w[3], rel=1e-9) and g[4] == pytest.approx(w[4], rel=1e-6)


COLUMNS = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").collect()
    crc = [zlib.crc32(str(r["doc_id"]).encode()) for r in rows]
    want = brute([(lm.TEST if c % 10 == 0 else lm.DELETED if c % 20 == 1 else lm.KEPT, r["text"]) for c, r in zip(crc, rows)])
    got = QUERIES["op4_deleted_interpolation"](spark, SF_SMALL).orderBy("doc_id").collect()
    assert [r["held_out"] for r in got] == [c % 10 == 0 for c in crc]
    compare([[r[c] for c in COLUMNS] for r in got], want)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def scored(spark, rows, **kw):
    """rows of (fold, text), numbered."""
    df = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(rows)], "doc_id long, fold int, text string")
    return [[r[c] for c in COLUMNS] for r in lm.score_corpus(df.repartition(3), **kw).orderBy("doc_id").collect()]


def test_edges_in_small_batches(spark):
    texts = [r[1] for r in edge_rows() if len(r[1] or "") < 1000] * 3
    for folds in ([0, 1, 2, 2], [2], [0], [0, 2], [1], [0, 1]):
        rows = [(folds[i % len(folds)], t) for i, t in enumerate(texts)]
        compare(scored(spark, rows, batch_tokens=30), brute(rows))


def test_long_text_null_ids_and_empty_table(spark):
    df = docs(spark, edge_rows(), clash=True).withColumn("fold", F.lit(lm.KEPT))
    out = lm.score_corpus(df).collect()
    assert sorted(repr(r["doc_id"]) for r in out) == sorted(repr(r[0]) for r in edge_rows())
    assert all(math.isfinite(r["score"]) for r in out)
    assert lm.score_corpus(df.limit(0)).count() == 0


def test_packing_round_trip():
    rnd = np.random.default_rng(1)
    keys = np.sort(rnd.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (lm._unpack_sorted(lm._pack_sorted(keys)) == keys).all()
    assert len(lm._unpack(lm._pack(np.zeros(0, "<u4")), "<u4")) == 0
