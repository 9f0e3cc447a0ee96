"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may occur in a text with up to k = m * percent / 100
edits.  It is split into k + 1 pieces; k edits leave at least one piece
intact, so every occurrence holds an exact piece.  One Aho-Corasick automaton
finds the pieces of a block of items, and Myers' bit-parallel distance
verifies the item around each hit.

Texts are compared with A-Z in lower case and every run of ASCII white space
as one blank; places are places in the text itself.

The items are queries against all documents, taken in blocks of a fixed size
(``BLOCK_CHARS``), one pass over the documents per block; a block is all that
a task holds besides its rows.

Defined cases: a null or empty text matches nothing; every item but a blank
one is searched, without the space around it, with the same share of edits;
one too short to be allowed any (under 13 characters at 8 %) must stand
between word boundaries; with ``whole_words`` (off) such an item that is a
single word must be the whole text; texts of any length are searched whole; of
several occurrences of an item in a text the one with the smallest distance,
then the first, is told; equal rows are told apart by nothing and each gets
its rows; empty tables give no matches.  Extra columns are left alone.
"""
from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, replace

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import fresh

PERCENT = 8
BLOCK_CHARS = 1 << 20
_FOLD = bytes(range(256)).lower().translate(bytes.maketrans(b"\t\n\x0b\f\r", b"     "))
# Fixed value: the letters of the scripts written without spaces (Thai, Lao,
# Burmese, Khmer, Kana, Bopomofo, Han), where a word may end after any letter.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u312f\u31f0-\u31ff\u3400-\u4dbf"
                       "\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def fold(text: bytes) -> str:
    """The text as it is compared: as many characters as before."""
    return text.translate(_FOLD).decode("utf-8", "replace")


_RUN = re.compile("  +")


def join(folded: str) -> str:
    """The folded text with one blank for each run of them."""
    return _RUN.sub(" ", folded) if "  " in folded else folded


def places(folded: str, found: list[Match]) -> list[Match]:
    """Matches in ``join(folded)`` with their places in ``folded``."""
    if not found or "  " not in folded:
        return found
    after, extra, total = [], [0], 0  # blanks of runs in the joined text; characters dropped up to there
    for run in _RUN.finditer(folded):
        after.append(run.start() - total)
        total += run.end() - run.start() - 1
        extra.append(total)

    def place(i: int) -> int:
        return i + extra[bisect_left(after, i)]

    return [replace(m, start=place(m.start), end=place(m.end - 1) + 1) for m in found]


def _in_word(c: str) -> bool:
    """Whether ``c`` is a character of a word that spaces set off."""
    return (c.isalnum() or c == "_" or unicodedata.category(c)[0] == "M") and not _UNSPACED.match(c)


def bare_word(item: str) -> bool:
    return all(map(_in_word, item))


def boundary(text: str, at: int) -> bool:
    """Whether no word of ``text`` goes on from ``at - 1`` to ``at``."""
    if not 0 < at < len(text):
        return True
    return unicodedata.category(text[at])[0] != "M" and not (_in_word(text[at - 1]) and _in_word(text[at]))


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) of ``budget + 1`` pieces of near-equal length."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str, anchored: bool = False) -> list[int]:
    """Smallest edit distance of ``pattern`` to a substring of ``text`` that
    ends after each character (to the prefix that ends there if ``anchored``)."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    plus, minus, score, out = full, 0, m, []
    for c in text:
        eq = peq.get(c, 0)
        diag = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        up, down = minus | (full & ~(diag | plus)), plus & diag
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1 | anchored) & full, down << 1 & full
        plus, minus = down | (full & ~(diag | up)), up & diag
        out.append(score)
    return out


@dataclass(frozen=True)
class Match:
    item: int
    distance: int
    start: int
    end: int


class Matcher:
    """The pieces of a block of items (already folded), ready to be searched."""

    def __init__(self, items: list[str], percent: int = PERCENT, whole_words: bool = False):
        self.items = [t.strip() for t in items]
        self.budget = [len(t) * percent // 100 for t in self.items]
        self.alone = [whole_words and not k and bare_word(t) for t, k in zip(self.items, self.budget)]
        owners: dict[str, list[tuple[int, int]]] = {}
        for k, t in enumerate(self.items):
            if not t:
                continue
            for at, piece in pieces(t, self.budget[k]):
                owners.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, owned in owners.items():
            self.automaton.add_word(piece, (len(piece), owned))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def matches(self, text: str) -> Iterator[Match]:
        """The best occurrence of every item that ``text`` holds."""
        if self.empty:
            return
        windows: dict[int, list[list[int]]] = {}
        exact: dict[int, int] = {}  # start of the first occurrence of an item without budget
        whole = text.strip()
        for end, (length, owned) in self.automaton.iter(text):
            for k, at in owned:
                if not self.budget[k]:
                    start = end + 1 - length
                    if k not in exact and (whole == self.items[k] if self.alone[k]
                                           else boundary(text, start) and boundary(text, end + 1)):
                        exact[k] = start
                    continue
                lead, budget = end + 1 - length - at, self.budget[k]
                a, b = max(0, lead - budget), lead + len(self.items[k]) + budget
                spans = windows.setdefault(k, [])
                if spans and a <= spans[-1][1] and a >= spans[-1][0]:
                    spans[-1][1] = max(b, spans[-1][1])  # one look at places that overlap
                else:
                    spans.append([a, b])
        for k, start in exact.items():
            yield Match(k, 0, start, start + len(self.items[k]))
        for k, spans in windows.items():
            found = [self._best(k, text, a, b) for a, b in spans]
            best = min((f for f in found if f), default=None)
            if best:
                yield Match(k, *best)

    def _best(self, k: int, text: str, a: int, b: int) -> tuple[int, int, int] | None:
        item = self.items[k]
        scores = myers(item, text[a:b])
        distance = min(scores, default=len(item))
        if distance > self.budget[k]:
            return None
        end = a + scores.index(distance) + 1
        back = myers(item[::-1], text[max(a, end - len(item) - distance):end][::-1], anchored=True)
        return distance, end - back.index(distance) - 1, end


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[object, str]]]:
    """(item_id, folded text) of the items, a bounded block at a time."""
    rows = items.select("item_id", "text").where(F.length("text") > 0).distinct()
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars)
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield [(r["item_id"], join(fold(r["text"].encode()))) for r in sorted(part, key=repr)]


def _match_udf(block: list[tuple[object, str]], item_type, percent: int, whole_words: bool):
    """Arrow UDF text -> matches of the block's items."""
    kind = ArrayType(StructType([StructField("item_id", item_type), StructField("distance", LongType()),
                                 StructField("start", LongType()), StructField("end", LongType())]))
    ids, texts = [i for i, _ in block], [t for _, t in block]
    held: list[Matcher] = []  # built once per task

    @F.arrow_udf(kind)
    def run(column: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        if not held:
            held.append(Matcher(texts, percent, whole_words))
        folded = (fold(t.as_buffer().to_pybytes()) if t.is_valid else "" for t in column)
        found = [[{"item_id": ids[m.item], "distance": m.distance, "start": m.start, "end": m.end}
                  for m in places(t, list(held[0].matches(join(t))))] for t in folded]
        return pa.array(found, to_arrow_type(kind))

    return run


def leaks(docs: DataFrame, items: DataFrame, percent: int = PERCENT, whole_words: bool = False,
          block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, start, end): the best occurrence of every
    item in every document (doc_id, text) that holds it."""
    kind = items.schema["item_id"].dataType
    out = None
    for block in _blocks(items, block_chars):
        run = _match_udf(block, kind, percent, whole_words)
        part = docs.select("doc_id", F.explode(run("text")).alias("m")).select("doc_id", "m.*")
        out = part if out is None else out.unionByName(part)
    if out is None:
        none = F.lit(None)
        out = docs.where("false").select("doc_id", none.cast(kind).alias("item_id"), *[
            none.cast("long").alias(c) for c in ("distance", "start", "end")])
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, percent: int = PERCENT, whole_words: bool = False,
               block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    kind = items.schema["item_id"].dataType
    hits = fresh(docs, "__hits")[0]
    for block in _blocks(items, block_chars):
        run = _match_udf(block, kind, percent, whole_words)
        docs = docs.withColumn(hits, F.size(run("text"))).where(F.col(hits) == 0).drop(hits)
    return docs
