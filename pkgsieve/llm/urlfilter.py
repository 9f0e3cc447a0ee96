"""URL filter: all glob rules at once, by an extended Shift-And automaton.

A rule is a glob over the canonical URL ``.host/path``: ``?`` is one character
and ``*`` any run of characters but ``/``; ``**`` is any run.  Every glob takes
one bit per state; all globs lie side by side in the words of one bit vector.
One step per character does, for all globs of all URLs of a batch,

    D = ((D << 1) & step[c]) | (D & stay[c])

where step[c] holds the states that c leads into and stay[c] those whose
wildcard accepts c; the carry runs from word to word.  A glob matches if its
last state is set after the last character.

Defined cases: a null URL, or one without ``://``, has an empty host and path
and takes the default verdict, as do URLs that no rule fits; of the rules that
fit, the longest decides, a block before an allow of the same length.  Long
URLs are read whole; a batch holds one bit vector per URL, not per character.
Repeated rows are judged alike; an empty table gives an empty result; columns
named like a result column are kept under a new name (``give_way``).
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, give_way, lower_ascii

AFTER_SCHEME = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for the URLs of ``host`` and its subdomains whose path
    starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"**.{self.host}{self.path}**" if not self.path.startswith("/") else f"*.{self.host}{self.path}**"


def url_host(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, AFTER_SCHEME, 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, AFTER_SCHEME, 2), F.lit(""))


class GlobSet:
    """The bit masks of a list of globs."""

    def __init__(self, globs: Sequence[str]):
        states: list[list[str]] = [[] for _ in globs]  # the symbols that lead into each state
        stays: list[dict[int, str]] = [{} for _ in globs]
        for k, glob in enumerate(globs):
            i = 0
            while i < len(glob):
                if glob[i] == "*":
                    many = glob[i:i + 2] == "**"
                    here = stays[k].get(len(states[k]))
                    stays[k][len(states[k])] = "any" if many or here == "any" else "segment"
                    i += 2 if many else 1
                else:
                    states[k].append(glob[i])
                    i += 1
        first = np.cumsum([0] + [len(s) + 1 for s in states])
        self.words = max(1, -(-int(first[-1]) // 64))
        letters = sorted({c for s in states for c in s if c != "?"} | {"/"})
        self.letters = np.array([ord(c) for c in letters], dtype=np.uint32)
        self.step = np.zeros((len(letters) + 1, self.words), dtype=np.uint64)  # last row: any other character
        self.stay = np.zeros_like(self.step)
        self.start = np.zeros(self.words, dtype=np.uint64)
        self.final = [int(first[k]) + len(s) for k, s in enumerate(states)]
        slash = letters.index("/")
        for k, into in enumerate(states):
            at = int(first[k])
            self._set(self.start, at)
            for j, c in enumerate(into):
                rows = [letters.index(c)] if c != "?" else [r for r in range(len(letters) + 1) if r != slash]
                for r in rows:
                    self._set(self.step[r], at + j + 1)
            for j, kind in stays[k].items():
                for r in range(len(letters) + 1):
                    if kind == "any" or r != slash:
                        self._set(self.stay[r], at + j)

    @staticmethod
    def _set(row: np.ndarray, bit: int) -> None:
        row[bit >> 6] |= np.uint64(1) << np.uint64(bit & 63)

    def run(self, urls: Sequence[str]) -> np.ndarray:
        """Boolean (url, glob): which globs match which URLs."""
        lengths = np.array([len(u) for u in urls], dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        codes = np.frombuffer("".join(urls).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        place = np.searchsorted(self.letters, codes)
        known = place < len(self.letters)
        known[known] = self.letters[place[known]] == codes[known]
        symbol = np.where(known, place, len(self.letters))
        starts = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        d = np.tile(self.start, (len(urls), 1))
        alive = len(urls)
        for j in range(int(lengths[0]) if len(urls) else 0):
            while lengths[alive - 1] <= j:  # the longest come first
                alive -= 1
            c = symbol[starts[:alive] + j]
            now = d[:alive]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            d[:alive] = (moved & self.step[c]) | (now & self.stay[c])
        hit = np.zeros((len(urls), len(self.final)), dtype=bool)
        for k, bit in enumerate(self.final):
            hit[order, k] = (d[:, bit >> 6] >> np.uint64(bit & 63)) & np.uint64(1)
        return hit


def judge(pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null if none fits) and
    ``verdict``.  The rules are parameters, compiled once per task."""
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "block", r.name))
    pages = give_way(pages, "host", "path", "rule", "verdict", keep=(url,))
    keep = pages.columns
    canonical = fresh(pages, "__canonical")[0]
    rows = pages.withColumn(canonical, F.concat(F.lit("."), url_host(F.col(url)), url_path(F.col(url))))
    rows = rows.select(*keep, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"), canonical)
    out = rows.drop(canonical).withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(""))
    schema = out.schema

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = GlobSet([r.glob for r in ranked])
        names = pa.array([r.name for r in ranked] + [None], pa.string())
        verdicts = pa.array([r.verdict for r in ranked] + [default], pa.string())
        for batch in batches:
            hit = automaton.run(batch.column(batch.num_columns - 1).to_pylist())
            hit = np.column_stack([hit, np.ones(len(hit), dtype=bool)])
            first = pa.array(hit.argmax(axis=1))
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, names.take(first), verdicts.take(first)], names=schema.names)

    return rows.mapInArrow(match, schema)
