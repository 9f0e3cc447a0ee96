"""Language ID: spans of mixed-language text by Viterbi over per-word scores.

Model (``fit``): from labelled documents, at most about
``DOCS_PER_LANG`` distinct texts of a language (chosen by a hash of the text,
the one with the smallest hash always), the hashed
character 1- to 3-grams of the words per language, and the share of its
letters in each script.  A word's score for a language is the mean-damped log
probability of its grams.

Text: a piece is a word, cut where the script of its letters changes, and runs
of scripts written without spaces cut after ``UNSPACED_LETTERS`` letters.  Its
script leaves the languages written in it as candidates, all others are out.
Viterbi finds the best sequence of languages over the pieces, where a change
of language costs ``SWITCH``; the pieces between changes are a span.  The
text's language is the one with the most letters, its score the share of them.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and
no span; pieces without a letter take the language around them and count no
letters; a script that no training text has leaves all languages as
candidates; ties go to the first language by code point; without any labelled
document every text is ``und``; equal rows get equal results; long texts are
read whole; an empty table gives an empty result; columns named like a result
column are kept under a new name (``give_way``), others are left alone.
"""
from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_way
from .textops import PIECE

DOCS_PER_LANG = 2000
BUCKETS = 1 << 16
GRAMS = 3
SMOOTH = 0.5
DAMP = 0.5
SWITCH = 8.0
OUTSIDE = -np.inf
UNSPACED_LETTERS = 2
MIN_SCRIPT_SHARE = 0.01
GROUP_CHARS = 1 << 23
CACHED_WORDS = 400_000

# The first and last code point of the letter blocks of each script.
SCRIPTS = {
    "Latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "Devanagari": [(0x900, 0x97F)],
    "Bengali": [(0x980, 0x9FF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Georgian": [(0x10A0, 0x10FF)],
    "Hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "Ethiopic": [(0x1200, 0x137F)],
    "Kana": [(0x3040, 0x30FF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
}
_TABLE: list[np.ndarray] = []


def script_table() -> np.ndarray:
    """Per code point: 0 for no letter, 1 + the script's place, or one more for other letters."""
    if not _TABLE:
        letter = np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])
        script = np.where(letter, len(SCRIPTS) + 1, 0).astype(np.uint8)
        for k, ranges in enumerate(SCRIPTS.values()):
            for a, b in ranges:
                script[a:b + 1][letter[a:b + 1]] = k + 1
        _TABLE.append(script)
    return _TABLE[0]


# The scripts written without spaces.
UNSPACED = ("Thai", "Kana", "Han")
# letters beyond Latin start at U+0250; U+2000 to U+2BFF are punctuation and symbols
_OTHER = re.compile("[\u0250-\u1dff\u1f00-\u1fff\u2c00-\U0010ffff]")


def lower(text: str) -> str:
    """``text`` in lower case, as many characters as before."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@lru_cache(maxsize=1 << 16)
def cut_word(word: str) -> tuple[str, ...]:
    """The pieces of a word of more than Latin letters."""
    table, unspaced = script_table(), {1 + list(SCRIPTS).index(s) for s in UNSPACED}
    out, start, now, letters = [], 0, 0, 0
    for i, c in enumerate(word):
        script = int(table[ord(c)])
        if not script:
            continue
        if now and (script != now or now in unspaced and letters >= UNSPACED_LETTERS):
            out.append(word[start:i])
            start, letters = i, 0
        now, letters = script, letters + 1
    return (*out, word[start:])


def pieces(text: str) -> list[str]:
    words = text.split()
    if not _OTHER.search(text):
        return words
    return [p for w in words for p in (cut_word(w) if _OTHER.search(w) else (w,))]


def places(text: str) -> list[tuple[int, int]]:
    """Start and end of the pieces of a text."""
    out = []
    for m in re.finditer(r"\S+", text):
        at = m.start()
        for p in pieces(m.group()):
            out.append((at, at + len(p)))
            at += len(p)
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


@dataclass
class Grams:
    """The grams of a list of words, framed by ``\\x02`` and ``\\x03``."""

    bucket: np.ndarray  # (characters, GRAMS); BUCKETS where the gram leaves the word
    first: np.ndarray  # each word's first character
    letters: np.ndarray  # letters per word
    script: np.ndarray  # script of the first letter, 0 if there is none


def grams(words: list[str]) -> Grams:
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lengths = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths)
    first = ends - lengths
    left = np.repeat(ends, lengths) - np.arange(len(codes))  # characters to the word's end
    bucket = np.full((len(codes), GRAMS), BUCKETS, dtype=np.int64)
    h = np.zeros(len(codes), dtype=np.uint64)
    for n in range(GRAMS):
        h = h[: len(codes) - n] if n else h
        h = _mix(h * np.uint64(31) + codes[n:].astype(np.uint64) + np.uint64(n + 1))
        inside = left[: len(h)] > n
        bucket[: len(h), n] = np.where(inside, (h % np.uint64(BUCKETS)).astype(np.int64), BUCKETS)
    script = script_table()[np.minimum(codes, 0x10FFFF)]
    is_letter = script > 0
    letters = np.add.reduceat(is_letter.astype(np.int64), first) if len(words) else np.zeros(0, np.int64)
    at = np.where(is_letter, np.arange(len(codes)), len(codes))
    where = np.minimum.reduceat(at, first) if len(words) else np.zeros(0, np.int64)
    return Grams(bucket, first, letters, np.append(script, 0)[where])


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    logp: np.ndarray  # (BUCKETS + 1, langs); the last row is 0
    candidate: np.ndarray  # (scripts + 2, langs) boolean


def fit(labelled: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> Model:
    """The model of rows (text, lang).  Counting is done in tasks; the driver
    gets one count per language and bucket."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    ticket = F.shiftrightunsigned(F.xxhash64("text"), 11)  # copies of a text have one ticket and count once
    sizes = (rows.select("lang", ticket.alias("ticket")).distinct().groupBy("lang")
             .agg(F.count("*").alias("n"), F.min("ticket").alias("least")).collect())  # the model has a row per language too
    if sizes:
        below = F.create_map(*[F.lit(x) for r in sizes for x in (
            r["lang"], max(r["least"] + 1, int((1 << 53) * min(1.0, docs_per_lang / r["n"]))))])
        chosen = rows.where(ticket < F.element_at(below, F.col("lang"))).distinct()
    else:
        chosen = rows.limit(0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        slots = BUCKETS + len(SCRIPTS) + 2
        for batch in batches:
            for lang, text in zip(*batch.columns):
                g = grams(pieces(lower(text.as_py())))
                inside = g.bucket[g.bucket < BUCKETS]
                counts = held.setdefault(lang.as_py(), np.zeros(slots, dtype=np.int64))
                counts[:BUCKETS] += np.bincount(inside, minlength=BUCKETS)
                np.add.at(counts, BUCKETS + g.script.astype(np.int64), g.letters)
        for lang, counts in held.items():
            slot = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(slot), pa.string()),
                                              "slot": pa.array(slot), "n": pa.array(counts[slot])})

    found = (chosen.mapInArrow(count, "lang string, slot long, n long").groupBy("lang", "slot")
                   .agg(F.sum("n").alias("n")).toArrow())
    return _model(found)


def _model(found: pa.Table) -> Model:
    names = found.column("lang").to_pylist()
    langs = tuple(sorted(set(names)))
    counts = np.zeros((len(langs), BUCKETS + len(SCRIPTS) + 2))
    place = {lang: k for k, lang in enumerate(langs)}
    rows = np.array([place[x] for x in names], dtype=np.int64)
    counts[rows, found.column("slot").to_numpy()] = found.column("n").to_numpy()
    grams_ = counts[:, :BUCKETS] + SMOOTH
    logp = np.log(grams_ / grams_.sum(axis=1, keepdims=True)).T if langs else np.zeros((BUCKETS, 0))
    letters = counts[:, BUCKETS:]
    share = letters / np.maximum(letters.sum(axis=1, keepdims=True), 1)
    candidate = share.T >= MIN_SCRIPT_SHARE
    candidate[~candidate.any(axis=1)] = True
    candidate[0] = True
    centred = logp - logp.mean(axis=1, keepdims=True) if langs else logp
    return Model(langs, np.vstack([centred, np.zeros((1, len(langs)))]).astype(np.float32), candidate)


class WordScores:
    """Scores (per language) and letters of each distinct word, a row each in
    arrays that double as they fill; beyond a bound all is forgotten."""

    def __init__(self, model: Model, limit: int = CACHED_WORDS):
        self.model, self.limit = model, limit
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.scores = np.zeros((1 << 12, len(self.model.langs)), dtype=np.float32)
        self.letters = np.zeros(1 << 12, dtype=np.int64)

    def rows(self, texts: list[str]) -> list[np.ndarray]:
        """The rows of the pieces of each text."""
        split = [pieces(lower(t)) for t in texts]
        new = list({w for words in split for w in words if w not in self.place})
        for a in range(0, len(new), 1 << 15):
            self._add(new[a:a + (1 << 15)])
        return [np.fromiter(map(self.place.__getitem__, words), dtype=np.int32, count=len(words)) for words in split]

    def _add(self, words: list[str]) -> None:
        g, n = grams(words), len(self.place)
        per_char = np.zeros((len(g.bucket), len(self.model.langs)), dtype=np.float32)
        for k in range(GRAMS):
            per_char += self.model.logp[g.bucket[:, k]]
        score = np.add.reduceat(per_char, g.first, axis=0) * np.float32(DAMP)
        score += np.where(self.model.candidate[g.script], np.float32(0), np.float32(OUTSIDE))
        score[g.letters == 0] = 0
        while n + len(words) > len(self.letters):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        self.scores[n:n + len(words)], self.letters[n:n + len(words)] = score, g.letters
        self.place.update(zip(words, range(n, n + len(words))))


def viterbi(scores: np.ndarray, words: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """The best language of every word, for all texts at once: ``words`` are
    rows of ``scores``; step t handles word t of every text that has one."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    flat = np.concatenate([words[i] for i in order]) if len(words) else np.zeros(0, np.int64)
    starts = np.cumsum(lengths[order]) - lengths[order]
    alive = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")  # texts with a word t
    n, k = len(words), scores.shape[1]
    best = np.zeros((n, k), dtype=np.float32)
    stays = np.zeros((len(flat), k), dtype=bool)
    tops = np.zeros(len(flat), dtype=np.uint8 if k < 256 else np.int32)
    for t, m in enumerate(alive.tolist()):
        at = starts[:m] + t
        now = best[:m]
        if t:
            top = now.argmax(axis=1)
            leave = (now[np.arange(m), top] - np.float32(switch))[:, None]
            stay = now >= leave
            stays[at], tops[at] = stay, top
            now = np.where(stay, now, leave)
        best[:m] = now + scores[flat[at]]
    labels = np.zeros(len(flat), dtype=np.int64)
    lang = best.argmax(axis=1)
    for t in range(len(alive) - 1, -1, -1):
        m = alive[t]
        at = starts[:m] + t
        labels[at] = lang[:m]
        if t:
            lang[:m] = np.where(stays[at, lang[:m]], lang[:m], tops[at])
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * n
    for i, a in zip(order.tolist(), starts.tolist()):
        out[i] = labels[a:a + lengths[i]]
    return out


Span = tuple[int, int, str, float]  # start and end in the text, language, share of the text's letters


def text_spans(model: Model, text: str, labels: np.ndarray, letters: np.ndarray) -> list[Span]:
    """The spans of a text from its pieces' languages; none without letters."""
    total = letters.sum()
    if not total:
        return []
    first = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]])
    share = np.add.reduceat(letters, first) / total
    if len(first) == 1:
        return [(len(text) - len(text.lstrip()), len(text.rstrip()), model.langs[labels[0]], 1.0)]
    at = places(text)
    last = [*(first[1:] - 1), len(labels) - 1]
    return [(at[i][0], at[j][1], model.langs[labels[i]], float(s)) for i, j, s in zip(first, last, share)]


def spans(model: Model, text: str) -> list[tuple[str, str]]:
    """(language, passage) of the spans of a text."""
    if not model.langs:
        return []
    return [(lang, text[a:b]) for a, b, lang, _ in _label(WordScores(model), [text])[2][0]]


def _label(table: WordScores, texts: list[str]) -> tuple[list[str], list[float], list[list[Span]]]:
    langs = table.model.langs
    if len(table.place) > table.limit:
        table.clear()
    words: list[np.ndarray] = []
    for part in _groups(texts, PIECE):
        words += table.rows(part)
    names, scores, found = [], [], []
    for text, at, labels in zip(texts, words, viterbi(table.scores, words)):
        letters = table.letters[at]
        weight = np.bincount(labels, weights=letters, minlength=len(langs))
        total = weight.sum()
        names.append(langs[int(weight.argmax())] if total else "und")
        scores.append(float(weight.max() / total) if total else 0.0)
        found.append(text_spans(table.model, text, labels, letters))
    return names, scores, found


def _groups(texts: Iterable[str], size: int) -> Iterator[list[str]]:
    """Runs of texts of about ``size`` characters, at least one text each."""
    group: list[str] = []
    held = 0
    for text in texts:
        group.append(text)
        held += len(text)
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


SPANS = "array<struct<start:int,end:int,lang:string,score:double>>"


def predict_udf(model: Model):
    """Arrow UDF text -> (lang, score, spans)."""
    held: list[WordScores] = []  # one table per task
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf(f"lang string, score double, spans {SPANS}")
    def run(column: pa.Array) -> pa.Array:
        names, scores, found = ["und"] * len(column), [0.0] * len(column), [[]] * len(column)
        if model.langs:
            if not held:
                held.append(WordScores(model))
            names, scores, found = [], [], []
            for texts in _groups((v.as_py() or "" for v in column), GROUP_CHARS):
                n, s, f = _label(held[0], texts)
                names, scores, found = names + n, scores + s, found + f
        sizes = np.fromiter(map(len, found), dtype=np.int32, count=len(found))
        flat = [pa.array([f[i] for x in found for f in x], span.field(i).type) for i in range(4)]
        spans_ = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)),
                                          pa.StructArray.from_arrays(flat, fields=list(span)))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), spans_],
                                          names=["lang", "score", "spans"])

    return run


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with a struct column (lang, score, spans) named ``language``."""
    docs = give_way(docs, "language", keep=(text,))
    return docs.withColumn("language", predict_udf(model)(text))


def span_table(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, span, start, end, lang, score): the spans of each document
    (doc_id, text), numbered from 0; places are characters of the text."""
    found = docs.select("doc_id", predict_udf(model)("text")["spans"].alias("spans"))
    return found.select("doc_id", F.posexplode("spans").alias("span", "s")).select("doc_id", "span", "s.*")
