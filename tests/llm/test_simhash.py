import random

from pyspark.sql import functions as F

from pkgsieve.llm import simhash
from pkgsieve.llm.textops import word_pieces
from tests.conftest import SF_SMALL
from tests.llm.helpers import classes, docs, edge_rows, fingerprint, long_text


def test_word_pieces_cut_at_spaces_only():
    text = long_text(n=3000).encode()
    assert [w for p in word_pieces(text, 100) for w in p] == text.split()
    assert list(word_pieces(b"  \t\n")) == [] and list(word_pieces(b"")) == []


def test_fingerprint_equals_definition():
    for text in [r[1] for r in edge_rows()] + ["A", "a B", "a b c", "a b c d", "x " * 50]:
        assert simhash.fingerprint((text or "").encode()) == fingerprint(text)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_equal_all_pairs(spark):
    rnd = random.Random(4)
    for bits in (0, 1, 2, 3, 5):
        prints = {0, (1 << 64) - 1}
        for _ in range(25):
            base = rnd.getrandbits(64)
            for _ in range(8):
                p = base
                for b in rnd.sample(range(64), rnd.randint(0, bits + 1)):
                    p ^= 1 << b
                prints.add(p)
        df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
        got = {frozenset((r["a"], r["b"])) for r in simhash.links(df, bits).collect()}
        want = {frozenset((signed(a), signed(b))) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= bits}
        assert got == want, bits


def test_components_of_a_long_chain(spark):
    path = list(range(200))
    random.Random(1).shuffle(path)
    pairs = spark.createDataFrame([(min(p), max(p)) for p in zip(path, path[1:])] + [(900, 901)], "a long, b long")
    got = {r["fp"]: r["label"] for r in simhash.components(pairs).collect()}
    assert got == {**{i: 0 for i in range(200)}, 900: 900, 901: 900}


def near(rnd, text):
    w = text.split()
    w[rnd.randrange(len(w))] = "changed"
    return " ".join(w)


def sample():
    rnd = random.Random(9)
    rows = list(edge_rows())
    for g in range(6):
        base = long_text(seed=g, n=900)
        rows += [(1000 * g + 100 + i, near(rnd, base) if i % 3 else base, "en", "s", 1) for i in range(12)]
    return rows


def test_components_equal_brute_force(spark):
    rows = sample()
    label = classes(fingerprint(r[1]) for r in rows)
    first = {}
    for r in rows:
        if r[0] is not None:
            k = label[fingerprint(r[1])]
            first[k] = min(r[0], first.get(k, r[0]))
    want = sorted(((r[0], signed(fingerprint(r[1])), first.get(label[fingerprint(r[1])])) for r in rows), key=repr)
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs(spark, rows)).collect()), key=repr)
    assert got == want


def test_one_row_of_each_component_stays(spark):
    rows = sample()
    df = docs(spark, rows, clash=True)
    out = simhash.drop_near_duplicates(df)
    assert out.columns == df.columns
    label = classes(fingerprint(r[1]) for r in rows)
    kept = out.collect()
    assert sorted(label[fingerprint(r["text"])] for r in kept) == sorted(set(label.values()))
    by = {label[fingerprint(r["text"])]: r["doc_id"] for r in kept}
    for k, d in by.items():
        ids = [r[0] for r in rows if label[fingerprint(r[1])] == k and r[0] is not None]
        assert d == (min(ids) if ids else None)
    assert {r["fp"] for r in kept} == {"own fp"}


def test_only_null_ids_and_empty_table(spark):
    rows = [(None, "a b c d", None, None, None), (None, "a b c d", None, None, None), (None, "other words here now", None, None, None)]
    assert simhash.drop_near_duplicates(docs(spark, rows)).count() == 2
    assert simhash.drop_near_duplicates(docs(spark, [])).count() == 0
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_query_on_the_whole_table(spark):
    from pkgsieve.llm.queries import QUERIES

    source = {r["doc_id"]: fingerprint(r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    label = classes(source.values())
    first = {}
    for d, p in sorted(source.items()):
        first.setdefault(label[p], d)
    rows = QUERIES["op7_simhash_components"](spark, SF_SMALL).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {
        d: (f"{p:016x}", first[label[p]]) for d, p in source.items()}


def test_copies_cost_one_probe(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(long_text(n=50)).alias("text"))
    assert {r["component_id"] for r in simhash.near_duplicates(df).collect()} == {0}
