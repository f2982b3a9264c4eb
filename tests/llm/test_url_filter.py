import random
import re

from tessera.llm.url_filter import LIMIT, Rule, Vocabulary, judge_urls, keep_urls, vocabulary


def plain_hits(url, terms):
    """Every term looked for by a pattern of its own."""
    found = set()
    for term in terms:
        edge = [r"[0-9]" if c.isdigit() else r"[^\x00-\x60\x7B-\x7F]" for c in (term[0], term[-1])]
        if re.search(rf"(?<!{edge[0]}){term}(?!{edge[1]})", url):
            found.add(term)
    return found


def test_automaton_matches_plain_patterns():
    terms = vocabulary()
    known, rng = Vocabulary(terms), random.Random(4)
    pieces = [*rng.sample(sorted(terms), 60), "1xbet", "-", "/", ".", "é", "7", "a", "s", "?q=", "%20", "日"]
    for _ in range(5_000):
        url = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        assert known.hits(url) == plain_hits(url, terms), url
    assert known.hits("") == set() and Vocabulary({}).hits("casino") == set()


def test_boundaries():
    known = Vocabulary(vocabulary())
    assert known.hits("http://essex.example/scunthorpe") == set()  # no word of its own
    assert known.hits("http://sex-cams24.example/") == {"sex", "cams"}
    assert known.hits("http://casino.example/1xbet") == {"casino", "1xbet"}
    assert known.hits("http://11xbet.example/casinoé") == set()


def judged(spark, urls, **how):
    rows = judge_urls(spark.createDataFrame([(u,) for u in urls], "url string"), **how).collect()
    return {r["url"]: r for r in rows}


def test_rules_come_first_and_the_longest_wins(spark):
    got = judged(spark, ["http://a.example.net/en/x?y#z", "https://EXAMPLE.net", "http://example.net/e", "ftp://b.Example.com/de/q", "http://xexample.com/de/q", "http://org/fr/casino", "http://o.org/frr", "http://h.org?x/fr/", "http://h.org#/fr/"])
    assert {u: (r["host"], r["path"], r["rule"], r["verdict"]) for u, r in got.items()} == {
        "http://a.example.net/en/x?y#z": ("a.example.net", "/en/x", "example.net/en/", "allow"), "https://EXAMPLE.net": ("example.net", "", None, "allow"),
        "http://example.net/e": ("example.net", "/e", "net/", "block"), "ftp://b.Example.com/de/q": ("b.example.com", "/de/q", "example.com/de/", "block"),
        "http://xexample.com/de/q": ("xexample.com", "/de/q", None, "allow"), "http://org/fr/casino": ("org", "/fr/casino", "org/fr/", "allow"),
        "http://o.org/frr": ("o.org", "/frr", None, "allow"), "http://h.org?x/fr/": ("h.org", "", None, "allow"), "http://h.org#/fr/": ("h.org", "", None, "allow"),
    }


def test_one_strict_or_several_soft(spark):
    got = judged(spark, ["http://x.org/casino", "http://x.org/pills", "http://x.org/pills/PILLS-pills", "http://cheap-pills.org/", "http://free.org/cheap-sale", "http://x.org/free-cheap-sale-offer", "http://x.org/free?q=Porn"])
    assert [r["verdict"] for r in got.values()] == ["block", "allow", "allow", "block", "allow", "block", "block"]
    assert got["http://cheap-pills.org/"]["soft"] == "cheap,pills" and got["http://cheap-pills.org/"]["points"] == LIMIT
    assert judged(spark, ["http://x.org/blue"], terms={"blue": (True, 5)}, rules=())["http://x.org/blue"]["verdict"] == "block"
    tie = judged(spark, ["http://x.org/a"], rules=[Rule.of("x.org/", "allow"), Rule.of("x.org/", "block")])
    assert tie["http://x.org/a"]["verdict"] == "block"


def test_odd_rows(spark):
    rows = [(1, None, "h"), (2, "", "h"), (3, "no scheme/casino", None), (3, "no scheme/casino", None), (None, "a://b://c/d", "h"), (5, "x://" + "casin" * 200_000 + "/p", "h"), (6, "://\n/é\n?", "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = judge_urls(pages).collect()
    assert len(got) == 7 and len(judge_urls(pages).columns) == 9
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got[:3]] == [("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "block")]
    assert (got[4]["host"], got[4]["path"]) == ("b:", "//c/d") and (got[6]["host"], got[6]["path"]) == ("\n", "/é\n")
    kept = keep_urls(pages)
    assert kept.columns == pages.columns and kept.count() == 5
    assert judge_urls(pages.limit(0)).count() == 0
