import random

from pkgsieve.llm import decontaminate as D
from tests.conftest import SF_SMALL
from tests.llm.helpers import docs, edge_rows, edit_distance_in


def edited(rnd, text, n):
    t = list(text)
    for _ in range(n):
        i, kind = rnd.randrange(len(t)), rnd.randrange(3)
        t[i:i + 1] = {0: [], 1: [t[i], "#"], 2: ["#"]}[kind]
    return "".join(t)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


ITEM = "Which of these rivers flows through the old town before it meets the northern sea at dawn and why does it do so?"
OTHER = "Name the smallest prime number greater than one hundred and prove that your answer is right in three steps."


def test_myers_equals_dynamic_programming():
    rnd = random.Random(2)
    for _ in range(300):
        p = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 90)))
        t = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 50)))
        assert min([len(p), *D.myers(p, t)]) == edit_distance_in(p, t)


def test_matcher_equals_brute_force():
    rnd = random.Random(3)
    texts = [D.fold(t.encode()) for t in (ITEM, OTHER, ITEM[:40].strip())]
    m = D.Matcher(texts)
    for n in range(40):
        k = rnd.randrange(3)
        noise = "".join(rnd.choice("etaoin shr") for _ in range(rnd.randint(0, 120)))
        text = noise + edited(rnd, texts[k], rnd.randint(0, m.budget[k] + 3)) + noise[::-1]
        got = {x.item: x for x in m.matches(text)}
        for i, item in enumerate(texts):
            best = edit_distance_in(item, text)
            assert (i in got) == (best <= m.budget[i])
            if i in got:
                x = got[i]
                assert x.distance == best and edit_distance_in(text[x.start:x.end], item) <= best


def test_folding_keeps_places():
    assert D.fold("A\nÉ\tZ".encode()) == "a É z" and len(D.fold("ßİ字🙂".encode())) == 4


def test_leaks_spans_blocks_and_edges(spark):
    rnd = random.Random(7)
    rows = edge_rows() + [
        (50, "Before. " + ITEM.upper() + " After.", "en", "s", 1),
        (51, long_noise(rnd) + edited(rnd, OTHER, 5) + long_noise(rnd), "en", "s", 1),
        (52, edited(rnd, OTHER, 40), "en", "s", 1),
        (53, ITEM.replace(" ", "\n") + OTHER, "en", "s", 1),
        (53, ITEM.replace(" ", "\n") + OTHER, "en", "s", 1),
    ]
    bench = items(spark, [(1, ITEM), (2, OTHER), (2, OTHER), (3, None), (4, ""), (5, "they"), (None, ITEM)])
    for block in (1 << 20, 130):  # one block of items, several blocks
        got = D.leaks(docs(spark, rows), bench, block_chars=block).collect()
        assert sorted(((r["doc_id"], r["item_id"]) for r in got), key=repr) == sorted(
            [(50, 1), (50, None), (51, 2)] + 2 * [(53, 1), (53, None), (53, 2)], key=repr)
        by = {(r["doc_id"], r["item_id"]): r for r in got}
        assert by[50, 1]["distance"] == 0 and by[50, 1]["start"] == 8 and by[50, 1]["end"] == 8 + len(ITEM)
        df = docs(spark, rows, clash=True)
        left = D.drop_leaks(df, bench, block_chars=block)
        assert left.columns == df.columns
        assert sorted((repr(r["doc_id"]) for r in left.collect())) == sorted(repr(r[0]) for r in rows if r[0] not in (50, 51, 53))


def test_items_of_every_length_equal_brute_force():
    """5 to 40 characters: the same share of edits for all; none allowed: between word boundaries."""
    rnd = random.Random(11)
    words = ["who", "wrote", "hamlet", "photosynthesis", "cell", "in", "a", "sea", "of", "stars", "x-ray"]
    cut = [" ".join(rnd.choice(words) for _ in range(9))[:n].strip() for n in range(5, 41)] + ["photosynthesis", "who wrote hamlet"]
    m = D.Matcher(cut)
    assert m.budget == [len(t) * 8 // 100 for t in cut] and max(m.budget) >= 3
    hits = 0
    for _ in range(400):
        i = rnd.randrange(len(cut))
        noise = "".join(rnd.choice("etaoin shr.") for _ in range(rnd.randint(0, 30)))
        text = noise + rnd.choice(["", " ", ". "]) + edited(rnd, cut[i], rnd.randint(0, m.budget[i] + 1)) + rnd.choice(["", " ", "s", "!"]) + noise
        got = {x.item: x for x in m.matches(text)}
        for k, item in enumerate(cut):
            if m.budget[k]:
                assert (k in got) == (edit_distance_in(item, text) <= m.budget[k])
            else:
                at = [p for p in range(len(text)) if text.startswith(item, p) and D.boundary(text, p) and D.boundary(text, p + len(item))]
                assert (k in got) == bool(at) and (not at or got[k].start == at[0])
            hits += k in got
    assert hits > 200


def test_short_items_are_found(spark):
    bench = items(spark, [(1, "Who wrote Hamlet? "), (2, "日本的首都是哪里？"), (3, "cat sat"), (4, "Hamlet"), (5, "  \n"),
                          (6, "東京は日本の首都"), (7, " " * 40), (8, "photosynthesis")])
    rows = [(k, text, "en", "s", 1) for k, text in enumerate([
        "Quiz: WHO WROTE\nHAMLET? Shakespeare.", "请问日本的首都是哪里？东京。", "The concat sat; a cat sat.", "a cat satin, tomcat sat",
        "cat sat\u0301 here", "the play Hamlet", " hamlet\n", "昔から東京は日本の首都である", " " * 90,
        "Q: name the process. Photosynthesis.", "who wrote hamIet?", "Photosyntesis, they say", "hamlets"])]
    got = {(r["doc_id"], r["item_id"]): (r["distance"], r["start"], r["end"]) for r in D.leaks(docs(spark, rows), bench).collect()}
    assert got == {(0, 1): (0, 6, 23), (0, 4): (0, 16, 22), (1, 2): (0, 2, 11), (2, 3): (0, 18, 25), (5, 4): (0, 9, 15),
                   (6, 4): (0, 1, 7), (7, 6): (0, 3, 11), (9, 8): (0, 21, 35), (10, 1): (1, 0, 17), (11, 8): (1, 0, 13)}
    left = D.drop_leaks(docs(spark, rows), bench)
    assert sorted(r["doc_id"] for r in left.collect()) == [3, 4, 8, 12]
    alone = {(r["doc_id"], r["item_id"]) for r in D.leaks(docs(spark, rows), bench, whole_words=True).collect()}
    assert alone == set(got) - {(0, 4), (5, 4)}  # a single word must then be the whole text


def test_runs_of_white_space_count_as_one_blank(spark):
    bench = items(spark, [(1, ITEM.strip()), (2, "Who  wrote Hamlet?"), (3, OTHER.strip().replace(" ", "\r\n  "))])
    rows = [(0, "x  y " + ITEM.strip().replace(" ", "  ") + "  end", "en", "s", 1), (1, "a\r\n\r\nwho wrote \n  hamlet?", "en", "s", 1),
            (2, OTHER.strip(), "en", "s", 1), (3, "  ".join(edited(random.Random(4), ITEM.strip(), 2).split()), "en", "s", 1)]
    got = {(r["doc_id"], r["item_id"]): r for r in D.leaks(docs(spark, rows), bench).collect()}
    assert sorted(got) == [(0, 1), (1, 2), (2, 3), (3, 1)] and 0 < got[3, 1]["distance"] <= 2
    for d, i in [(0, 1), (1, 2), (2, 3)]:
        assert got[d, i]["distance"] == 0
    assert rows[0][1][got[0, 1]["start"]:got[0, 1]["end"]] == ITEM.strip().replace(" ", "  ")
    assert rows[1][1][got[1, 2]["start"]:got[1, 2]["end"]] == "who wrote \n  hamlet?"
    assert D.drop_leaks(docs(spark, rows), bench).count() == 0


def long_noise(rnd):
    return " ".join("w%x" % rnd.randrange(9999) for _ in range(20_000)) + " "


def test_empty_tables(spark):
    bench = items(spark, [(1, ITEM)])
    assert D.leaks(docs(spark, []), bench).count() == 0
    assert D.leaks(docs(spark, edge_rows()), bench.limit(0)).count() == 0
    assert D.drop_leaks(docs(spark, edge_rows()), bench.limit(0)).count() == len(edge_rows())


def test_query_equals_brute_force(spark):
    from pkgsieve.llm.queries import QUERIES

    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in QUERIES["op2_edit_decontaminate"](spark, SF_SMALL).collect()}
    texts = {r["doc_id"]: D.fold((r["text"] or "").encode()) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    bench = {r["item_id"]: D.fold(r["text"].encode()).strip() for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()}
    want = {(d, i): 0 for d, t in texts.items() for i, x in bench.items() if x in t}
    assert want.items() <= got.items()
    for d, i in list(got.keys() - want.keys())[:20]:
        assert edit_distance_in(bench[i], texts[d]) == got[d, i]
    rnd = random.Random(1)  # no near occurrence is missed, by full distances on drawn pairs
    for d, i in rnd.sample([(d, i) for d, t in texts.items() if len(t) < 1500 for i in bench], 60):
        near = min([len(bench[i]), *D.myers(bench[i], texts[d])]) <= len(bench[i]) * D.PERCENT // 100
        assert near == ((d, i) in got)
