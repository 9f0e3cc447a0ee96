"""Small inputs and brute-force versions shared by the operator tests."""
import random
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = ("size", "rank", "target", "kept", "host", "fp", "label", "row", "part", "__hits", "__c0", "__size", "__host", "n_words",
         "base_failed", "host_rejected", "language", "verdict", "rule")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return WORD.findall(text or "")


def long_text(seed=1, n=60_000):
    rnd = random.Random(seed)
    return " ".join("w%x" % rnd.randrange(40_000) for _ in range(n))


def edge_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    a = "The quick brown fox jumps over the lazy dog while seven wizards box quietly."
    return [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \t\n\x0b", "en", "a", 4),
        (None, a, "en", "b", len(a)),
        (None, None, None, "b", None),
        (4, a, "en", None, len(a)),
        (5, a, "en", "b", len(a)),
        (5, a, "en", "b", len(a)),
        (5, "Another text of the very same id, with enough words to count here.", "en", "b", 10),
        (6, long_text(), "xx", "c", 1),
        (7, "Ünïcode ßtraße 漢字 words 🙂 \u0301 and\u00a0no-break\u2003space", "de", "c", 9),
        (8, "one two", "en", "c", 7),
        (9, "spam spam spam spam spam spam spam spam spam spam spam spam", "en", "c", 7),
    ]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, clash=False):
    """A table of documents; ``clash`` adds columns named like the operators' own."""
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        df = df.selectExpr("*", *[f"'own {c}' as `{c}`" for c in CLASH])
    return df


def tuples(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def fingerprint(text, n=3):
    w = words(ascii_lower(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, max_bits=2):
    """For each fingerprint the smallest of its component, by comparing all pairs."""
    prints = sorted(set(prints))
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1:]:
            if (a ^ b).bit_count() <= max_bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


def edit_distance_in(item, text):
    """Smallest edit distance of ``item`` to a substring of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        last, row[0] = row[0], i + 1
        for j, t in enumerate(text):
            last, row[j + 1] = row[j + 1], min(last + (c != t), row[j + 1] + 1, row[j] + 1)
    return min(row)
