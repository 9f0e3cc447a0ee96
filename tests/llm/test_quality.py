from pkgsieve.llm import quality
from pkgsieve.llm.common import cut
from tests.llm.helpers import docs, edge_rows, tuples, words


def brute(text):
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    covered = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered),
            sum("A" <= c <= "Z" for c in t))


def test_measures_equal_brute_force(spark):
    rows = edge_rows() + [
        (20, "a b c d e a b c d e f\na b c d e\n\nx\nx\n \n", "en", "d", 1),
        (21, "q q q q q q q", "en", "d", 1),
        (22, "# ** $%&|<> A B\nA B", "en", "d", 1),
    ]
    got = tuples(quality.measure(docs(spark, rows)), "text", *quality.MEASURES)
    assert got == sorted(((r[1], *brute(r[1])) for r in rows), key=repr)


def test_empty_table(spark):
    assert quality.judge(cut(quality.measure(docs(spark, [])))).count() == 0
    assert quality.filter_docs(docs(spark, [])).count() == 0


def test_filter_keeps_columns_and_clean_rows(spark):
    clean = "plain words that make a normal sentence number {} with more than ten words"
    more = [(1000 + i, clean.format(i), "en", ["a", "b", "c", None][i % 4], 1) for i in range(80)]
    df = docs(spark, edge_rows() + more, clash=True)
    out = quality.filter_docs(df)
    assert out.columns == df.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert {r[0] for r in more} <= set(kept)
    kept = [k for k in kept if k is None or k < 1000]
    assert sorted(map(repr, kept)) == sorted(map(repr, [None, 4, 5, 5, 5, 6]))  # long, null-id and repeated rows stay
    assert {r["kept"] for r in out.collect()} == {"own kept"}


def test_own_columns_named_like_results_are_kept_aside(spark):
    df = docs(spark, edge_rows(), clash=True)
    measured = quality.measure(df)
    assert {r["n_words_1"] for r in measured.collect()} == {"own n_words"}
    judged = quality.judge(cut(measured)).collect()
    assert {(r["base_failed_1"], r["kept_1"], r["host_rejected_1"]) for r in judged} == {("own base_failed", "own kept", "own host_rejected")}
    plain = quality.judge(cut(quality.measure(docs(spark, edge_rows())))).collect()
    assert sorted((repr(r["doc_id"]), r["n_words"], r["kept"]) for r in judged) == sorted((repr(r["doc_id"]), r["n_words"], r["kept"]) for r in plain)


def test_bad_host_loses_its_clean_documents(spark):
    clean = "plain words that make a normal sentence number {} with more than ten words"
    rows = [(i, clean.format(i), "en", "good", 1) for i in range(40)]
    rows += [(100 + i, "short", "en", "bad", 1) for i in range(40)]
    rows += [(200, clean.format(200), "en", "bad", 1), (201, clean.format(201), "en", None, 1)]
    kept = {r["doc_id"] for r in quality.filter_docs(docs(spark, rows)).collect()}
    assert kept == set(range(40)) | {201}


def test_small_hosts_are_shrunk(spark):
    clean = "plain words that make a normal sentence number {} with more than ten words"
    rows = [(i, clean.format(i) if i % 20 else "short", "en", f"h{i % 5}", 1) for i in range(200)]
    rows += [(500, "short", "en", "tiny", 1)]  # one failure of one document
    measured = cut(quality.measure(docs(spark, rows)))
    rate = {r["host"]: r["base_failed_rate"] for r in quality.host_verdicts(measured).collect()}
    assert 0.05 < rate["tiny"] < 1.0 and rate["tiny"] > rate["h1"]


def test_no_python_in_the_plan(spark):
    plan = quality.judge(cut(quality.measure(docs(spark, edge_rows()))))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
