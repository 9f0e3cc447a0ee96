import itertools

import numpy as np
from pyspark.sql import functions as F

from pkgsieve.llm import langid as L
from pkgsieve.llm.queries import QUERIES
from tests.conftest import SF_CHECK, SF_SMALL
from tests.llm.helpers import docs, edge_rows, tuples

TRAIN = [("en", "the cat and the dog went to the house with the other animals"),
         ("de", "der hund und die katze gingen mit den anderen tieren nach hause"),
         ("ru", "собака и кошка пошли домой вместе с другими животными"),
         ("bg", "кучето и котката отидоха вкъщи заедно с другите животни")]


def model(spark):
    return L.fit(spark.createDataFrame(TRAIN * 20, "lang string, text string"))


def test_viterbi_equals_all_paths():
    rnd = np.random.default_rng(3)
    scores = rnd.normal(0, 3, (12, 3)).astype(np.float32)
    texts = [rnd.integers(0, 12, n) for n in (0, 1, 6, 3, 6, 2)]
    for at, got in zip(texts, L.viterbi(scores, texts, switch=2.0)):
        value = lambda p: sum(scores[w, k] for w, k in zip(at, p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
        best = max((value(p) for p in itertools.product(range(3), repeat=len(at))), default=0)
        assert len(got) == len(at) and abs(value(tuple(got)) - best) < 1e-3


def test_spans_of_mixed_text(spark):
    found = L.spans(model(spark), "the dog and the cat went home with the other, 12 und der hund mit den anderen tieren собака и кошка")
    assert [lang for lang, _ in found] == ["en", "de", "ru"]
    assert found[1][1].split()[-1] == "tieren"


MIXED = TRAIN + [("zh", "今天天气很好 我们一起去公园散步 明天再来学习中文"), ("ja", "今日はとてもいい天気です みんなで公園に行きましょう ひらがなとカタカナ"),
                 ("th", "วันนี้อากาศดีมาก เราไปเดินเล่นในสวนกันเถอะ"), ("el", "η γάτα και ο σκύλος πήγαν στο σπίτι με τα άλλα ζώα")]


def brute_force(m, text):
    """Spans by a plain dynamic programme over the pieces."""
    at = L.places(text)
    words = [L.lower(text)[a:b] for a, b in at]
    table = L.WordScores(m)
    rows = [table.rows([w]) for w in words]
    assert all(len(r[0]) == 1 for r in rows)  # a piece is cut no further
    score = np.array([table.scores[r[0][0]] for r in rows])
    letters = np.array([table.letters[r[0][0]] for r in rows])
    best = {}
    for k, row in enumerate(score):  # best value of a sequence that ends with each language
        best = {i: max(((v - (L.SWITCH if j != i else 0), p) for j, (v, p) in best.items()), default=(0.0, ())) for i in range(len(m.langs))}
        best = {i: (v + row[i], (*p, i)) for i, (v, p) in best.items()}
    value, path = max(best.values(), key=lambda x: x[0])
    runs = [list(g) for _, g in itertools.groupby(range(len(path)), key=lambda i: path[i])]
    return value, [(at[r[0]][0], at[r[-1]][1], m.langs[path[r[0]]], letters[r].sum() / letters.sum()) for r in runs]


def test_span_table_of_mixed_scripts_equals_brute_force(spark):
    m = L.fit(spark.createDataFrame(MIXED * 20, "lang string, text string"))
    texts = ["今天天气很好thecatandthedog와together with the other animals собака и кошка", "das ist der hund 今日はいい天気です and the house",
             "собакаthe catкошка", "วันนี้อากาศดีมากthe dog went home", "  12 the cat, η γάτα και ο σκύλος !! 34 ", "漢字かなまじり文 the end", "just the dog", "!!! 12", ""]
    table = L.span_table(docs(spark, [(k, t, None, None, None) for k, t in enumerate(texts)], clash=True), m).collect()
    got = {k: [(r["start"], r["end"], r["lang"], r["score"]) for r in sorted(table, key=lambda r: r["span"]) if r["doc_id"] == k] for k in range(len(texts))}
    for k, text in enumerate(texts[:-2]):
        _, want = brute_force(m, text)
        assert [g[:3] for g in got[k]] == [w[:3] for w in want]
        assert np.allclose([g[3] for g in got[k]], [w[3] for w in want])
    assert got[7] == got[8] == []
    named = {k: [(lang, texts[k][a:b]) for a, b, lang, _ in v] for k, v in got.items()}
    assert named[0][0] == ("zh", "今天天气很好") and named[0][1][0] == "en" and named[0][-1] == ("ru", "собака и кошка")
    assert [lang for lang, _ in named[2]] == ["ru", "en", "ru"]  # a script admits its own languages alone
    assert named[3][0] == ("th", "วันนี้อากาศดีมาก") and named[3][1][0] == "en"
    assert [lang for lang, _ in named[4]] == ["en", "el"]


def test_lower_case_keeps_places():
    assert L.lower("İSTANBUL ΑΣ") == "İstanbul ας" or len(L.lower("İSTANBUL ΑΣ")) == 11
    assert L.pieces("abc-def дом漢字漢字kana") == ["abc-def", "дом", "漢字", "漢字", "kana"]
    assert [("x дом漢字漢 y")[a:b] for a, b in L.places("x дом漢字漢 y")] == ["x", "дом", "漢字", "漢", "y"]


def test_scripts_narrow_candidates(spark):
    m = model(spark)
    cyrillic = m.candidate[1 + list(L.SCRIPTS).index("Cyrillic")]
    assert [m.langs[k] for k in np.flatnonzero(cyrillic)] == ["bg", "ru"]
    assert m.candidate[1 + list(L.SCRIPTS).index("Han")].all()  # in no training text
    assert L.spans(m, "абв где")[0][0] in ("bg", "ru")


def test_training_sample_holds_distinct_texts_of_every_language(spark):
    copied, drawn = "the same page again", [("en", "xx%d yy" % i) for i in range(300)]
    for seed in range(5):  # a text of 2,000 copies, whether drawn or not, weighs as one
        texts = [("en", "%s %d" % (copied, seed)), ("de", "der hund %d" % seed), ("fr", "le chien %d" % seed)]
        rows = drawn + texts[:1] * 2000 + texts[1:2] * 500 + texts[2:]
        one = L.fit(spark.createDataFrame(drawn + texts, "lang string, text string"), 20)
        many = L.fit(spark.createDataFrame(rows, "lang string, text string"), 20)
        assert many.langs == ("de", "en", "fr") and np.array_equal(one.logp, many.logp)
    few = L.fit(spark.createDataFrame(drawn + texts, "lang string, text string"), 0.001)  # no text would be drawn
    assert few.langs == ("de", "en", "fr")


def test_edges(spark):
    rows = edge_rows() + [(60, "123 !? 456", None, None, None), (61, "漢字", None, None, None)]
    df = docs(spark, rows, clash=True).withColumn("Language", F.lit("own"))
    assert {r["Language_1"] for r in L.predict(df, model(spark)).collect()} == {"own"}
    got = {repr((r["doc_id"], r["text"])): (r["language"]["lang"], r["language"]["score"]) for r in L.predict(df, model(spark)).collect()}
    assert len(got) == len({(r[0], r[1]) for r in rows})
    for r in rows:
        lang, score = got[repr((r[0], r[1]))]
        letters = any(c.isalpha() for c in r[1] or "")
        assert (lang == "und", score == 0.0) == (not letters, not letters) and 0 <= score <= 1
    assert L.predict(docs(spark, []), model(spark)).count() == 0
    none = L.fit(docs(spark, []).select("text", "lang"))
    assert {r["language"]["lang"] for r in L.predict(docs(spark, rows), none).collect()} == {"und"}


def test_word_table_forgets_and_gives_the_same(spark):
    m, texts = model(spark), ["the dog %d went home with der katze w%d" % (i, i) for i in range(200)]
    small, large = L.WordScores(m, limit=10), L.WordScores(m)
    assert [L._label(small, [t]) for t in texts] == [L._label(large, [t]) for t in texts]


def test_query_equals_its_operators_on_every_document(spark):
    """Language and score of each row from the spans by brute force, on short texts of the whole query."""
    got = {r["doc_id"]: r for r in QUERIES["op10_language_spans"](spark, SF_SMALL).collect()}
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    m = L.fit(rows.where(fold != 2).select("text", "lang"))
    texts = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    assert set(got) == set(texts)
    short = sorted((d for d, t in texts.items() if any(c.isalpha() for c in t)), key=lambda d: len(texts[d]))[:60]
    for d in short:
        _, want = brute_force(m, texts[d])
        share = {}
        for _, _, lang, s in want:
            share[lang] = share.get(lang, 0) + s
        top = max(share.values())
        assert abs(got[d]["score"] - top) < 1e-9 and share[got[d]["lang_pred"]] == top
        assert [(s["start"], s["end"], s["lang"]) for s in got[d]["spans"]] == [w[:3] for w in want]


def test_held_out_accuracy(spark):
    rows = QUERIES["op10_language_spans"](spark, SF_CHECK).join(
        spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = rows.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert held[0] > 0.98 and held[1] > 100
    assert tuples(rows.where("score < 0 or score > 1")) == []
