import random
import re

from pkgsieve.llm.queries import URL_RULES
from pkgsieve.llm.urlfilter import GlobSet, Rule, judge


def as_regex(glob):
    parts = re.split(r"(\*\*|\*|\?)", glob)
    kinds = {"**": r"[\s\S]*", "*": r"[^/]*", "?": r"[^/]"}
    return re.compile("".join(kinds.get(p) or re.escape(p) for p in parts))


def test_automaton_equals_regex():
    rnd = random.Random(5)
    for _ in range(60):
        globs = ["".join(rnd.choice(["a", "b", "/", ".", "?", "*", "**", "é"]) for _ in range(rnd.randint(0, 14)))
                 for _ in range(rnd.randint(1, 30))]  # some sets take several words
        urls = ["".join(rnd.choice("ab/.é字") for _ in range(rnd.randint(0, 12))) for _ in range(40)] + [""]
        got = GlobSet(globs).run(urls)
        for i, u in enumerate(urls):
            for k, g in enumerate(globs):
                assert got[i, k] == bool(as_regex(g).fullmatch(u)), (g, u)


def brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [r for r in URL_RULES if ("." + host).endswith("." + r.host) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


def test_judge_equals_brute_force(spark):
    urls = [None, "", "no scheme.org/", "http://", "http://org/", "http://a.ORG/x", "http://a.org", "https://xorg/",
            "http://Example.ORG/es/1?q", "http://sub.example.org/en/12#f", "http://example.org/en/2", "x://a.com/fr/",
            "x://a.com/de/y/org/", "x://b.net/a.org/es/", "x://a.com:80/de/", "a://b://c.org/", "x://é.org/字?x",
            "x://a.org/\n/es/", "x://www.example.org/es/" + "long/" * 4000, "X://org/", "X://org/"]
    df = spark.createDataFrame(list(enumerate(urls)) + [(None, "http://a.org/")], "page_id long, url string")
    df = df.selectExpr("*", "'mine' as rule", "1 as verdict", "'c' as __canonical")
    got = {(r["page_id"], r["url"]): (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge(df, URL_RULES).collect()}
    assert got == {(i, u): brute(u) for i, u in [*enumerate(urls), (None, "http://a.org/")]}
    assert judge(df.limit(0), URL_RULES).count() == 0


def test_ties_block_first(spark):
    df = spark.createDataFrame([(1, "x://b.org/xy")], "page_id long, url string")
    rules = [Rule("allow", "b.org", "/"), Rule("block", "org", "/xy")]
    assert judge(df, rules).first()["verdict"] == "block"
