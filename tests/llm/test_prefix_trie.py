"""The conversation trie against one built by Python dictionaries."""
import hashlib
import random
import re
import zlib

import pytest

from tests.llm.helpers import CLASH

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string"
COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows, stride=20, heads=4):
    digest = lambda r: hashlib.md5((str(len((r[2] or "").encode())) + ":" + (r[2] or "") + (r[3] or "")).encode()).hexdigest()
    convs = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, digest(r))):
        convs.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    members, nodes = {}, {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % heads
        rest = abs(c) % stride * (1 if c >= 0 else -1)  # the remainder has the sign of the id
        seq = tuple(convs.get(c - rest, [])[:h] + own[h:])
        members.setdefault(seq, []).append(c)
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    children = {}
    for n in nodes:
        if n:
            children.setdefault(n[:-1], []).append(n)
    leaves, saved = {}, {}
    for n in sorted(nodes, key=len, reverse=True):
        kids = children.get(n, [])
        leaves[n] = sum(leaves[k] for k in kids) or 1
        words = len(WORD.findall(n[-1][1])) if n else 0
        saved[n] = (len(nodes[n]) - 1) * words + sum(saved[k] for k in kids)
    return sorted(((min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), len(children.get(n, [])), leaves[n], saved[n],
                    hashlib.sha256(",".join(map(str, sorted(members.get(n, [])))).encode()).hexdigest()) for n, m in nodes.items()), key=repr)


def got(spark, rows, clash=False, **kw):
    from pkgsieve.llm.prefix_trie import prefix_trie

    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        df = df.selectExpr("*", *[f"'own {c}' as `{c}`" for c in (*CLASH, "depth", "k0", "seq", "path", "words", "leaf", "digest", "pos")])
    return sorted((tuple(r[c] for c in COLS) for r in prefix_trie(df, **kw).collect()), key=repr)


def test_edges_equal_plain_version(spark):
    rows = [(0, 0, "user", "hello there  you"), (0, 1, "assistant", "one two three"), (0, 2, "user", "x"),
            (20, 0, None, None), (20, 1, "", ""), (-7, 0, "user", "hello there  you"), (-20, 5, "u", "neg base"),
            (41, 0, "a", "only turn")]  # conversations 41.. have no base
    rows += [(c, 0, "user", "hello there  you") for c in range(1, 20)]
    rows += [(c, t, "user", f"{t} same words") for c in range(100, 140) for t in range(3)]
    rows += [(c, t, "user", f"{t} same words") for c in range(200, 210) for t in range(5)]
    rows += [(50, None, "user", "first"), (50, None, "user", "also first"), (50, 3, None, "late"), (50, 3, "user", None),
             (51, 1, "user", "repeated"), (51, 1, "user", "repeated"), (None, 1, "user", "nobody's"),
             (60, 0, "user", "long " * 200_000), (61, 0, "us", "erx"), (62, 0, "use", "rx")]
    assert got(spark, rows, clash=True) == plain(rows)


def test_long_and_branching_conversations_in_small_blocks(spark, monkeypatch):
    from pkgsieve.llm import prefix_trie

    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", 2)
    rnd = random.Random(4)
    rows = []
    for c in range(1000, 1090):  # a comb: many ways leave one long conversation
        stay = rnd.randrange(30)
        rows += [(c, t, "user", f"turn {t}" if t <= stay else f"own {c} {t}") for t in range(min(30, stay + rnd.randrange(1, 9)))]
    for c in range(2000, 2060):  # a random tree of small choices
        rows += [(c, t, rnd.choice("ab"), rnd.choice(["yes", "no no"])) for t in range(rnd.randrange(7))]
    for heads in (1, 4):
        assert got(spark, rows, heads=heads) == plain(rows, heads=heads)


def test_empty_table(spark):
    assert got(spark, []) == []


@pytest.mark.parametrize("bits", [1, 12])
def test_end_lists_are_whole(spark, monkeypatch, bits):
    from pkgsieve.llm import prefix_trie

    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", bits)
    rows = [(c, 0, "user", "the same") for c in range(-30, 700, 3)]
    turns, convs = prefix_trie.rebuild(spark.createDataFrame(rows, SCHEMA), heads=1)
    sequences, ends = prefix_trie.collapse(turns, convs)
    assert [(r["seq"], r["depth"], r["weight"]) for r in sequences.collect()] == [(-30, 1, 244)]
    assert sorted(i for r in ends.collect() for i in r["ids"]) == list(range(-30, 700, 3))
    want = hashlib.sha256(",".join(map(str, range(-30, 700, 3))).encode()).hexdigest()
    assert [r["ends_sha256"] for r in prefix_trie.end_digests(ends).collect()] == [want]
