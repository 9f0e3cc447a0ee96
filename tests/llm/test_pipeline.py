import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from pkgsieve.llm import decontaminate as D
from pkgsieve.llm.common import cut
from pkgsieve.llm.queries import tokenizer_path
from tests.conftest import SF_SMALL
from tests.llm.helpers import classes, docs, edge_rows, fingerprint, tuples, words
from tests.llm.test_mixing import brute_targets
from tests.llm.test_quality import brute as measures


def quality_kept(rows):
    """Rows that pass; no host of this table is bad."""
    out = []
    for r in rows:
        n, chars, symbols, _, repeated, upper = measures(r["text"])
        if n >= 10 and 100 * repeated <= 20 * n and 100 * symbols <= 10 * n and 100 * upper <= 50 * chars:
            out.append(r)
    return out


@pytest.fixture(scope="module")
def stages(spark):
    """The result of each stage over the smallest documents, written and reread."""
    df, out = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), []
    for _, stage in C.STAGES:
        df = cut(stage(spark, df, SF_SMALL))
        out.append(df)
    return out


def test_stages_equal_brute_force(spark, stages):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    rows = quality_kept(rows)
    assert tuples(stages[0]) == sorted(map(tuple, rows), key=repr)
    label = classes(fingerprint(r["text"]) for r in rows)
    first = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        first.setdefault(label[fingerprint(r["text"])], r)
    rows = list(first.values())
    assert tuples(stages[1]) == sorted(map(tuple, rows), key=repr)
    bench = [D.fold(r["text"].encode()) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    matcher = D.Matcher(bench)
    rows = [r for r in rows if not list(matcher.matches(D.fold(r["text"].encode())))]
    assert not any(b in D.fold(r["text"].encode()) for r in rows for b in bench)
    assert tuples(stages[2]) == sorted(map(tuple, rows), key=repr)
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(words(r["text"]))
    targets, taken = brute_targets(sizes), {}
    by = {r["doc_id"]: r for r in rows}
    mixed = stages[3].collect()
    times = {}
    for r in mixed:
        assert tuple(r) == tuple(by[r["doc_id"]])
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
        taken[r["source"]] = taken.get(r["source"], 0) + len(words(r["text"]))
    for r in rows:
        rate = targets[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0
        assert times.get(r["doc_id"], 0) in (int(rate), int(rate) + 1)
    assert abs(sum(taken.values()) - sum(targets.values())) < 0.1 * sum(targets.values())
    whole, start, want = Tokenizer.from_file(tokenizer_path()), 0, []
    for r in sorted(mixed, key=lambda r: r["doc_id"]):
        ids = np.array([*whole.encode(r["text"], add_special_tokens=False).ids, 1], dtype="<u4")
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in stages[4].select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


def test_run_gives_the_last_stage(spark, stages):
    assert tuples(C.run(spark, SF_SMALL)) == tuples(stages[-1])


def test_stages_on_edges_and_empty_tables(spark):
    for rows in ([], edge_rows(), [(None, None, None, None, None)] * 3):
        for _, stage in C.STAGES[:4]:
            df = docs(spark, rows, clash=True)
            out = stage(spark, df, SF_SMALL)
            assert out.columns == df.columns and out.count() <= 2 * len(rows)
        assert C.STAGES[4][1](spark, docs(spark, rows, clash=True), SF_SMALL).count() == len(rows)
