import random
import re
from collections import Counter

import pytest

from tessera.llm import divergence
from tessera.llm.divergence import audit_sources, leading_terms, source_distances, tables


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows, min_docs, top):
    """The audit by its definition, every term of every group."""
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))) for lang, source, text in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        held = Counter(t for r in mine for t in set(r[2]))
        kept = [t for t, n in held.items() if n >= min_docs]

        def chances(some):
            counts = Counter(t for r in some for t in r[2])
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}, counts

        q, _ = chances(mine)
        sources = sorted({r[1] for r in mine})
        p = {s: chances([r for r in mine if r[1] == s]) for s in sources}
        for s in sources:
            pairs = [(o, sum(abs(p[s][0][t] - p[o][0][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][0][t] - q[t]) for t in kept if p[s][1][t] and p[s][0][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def sample(rng, n, sources=7):
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)] + ["ÉTÉ", "été", "日本", "Ab", "aB"]
    rows = [("en", None, None), (None, "s1", "only one"), ("xx", "a", "1 2 3"), ("xx", "b", None), ("xx", "", ""), ("lone", "z", "w " * 40)]
    for _ in range(n):
        source = f"s{min(rng.randrange(sources * 2), sources - 1)}"  # the last one has more than half
        rows.append((rng.choice(["en", "en", "de", None, ""]), rng.choice([source, source, None]), rng.choice(["-", " ", "_1"]).join(rng.choices(words[: rng.choice([5, 30, 65])], k=rng.randrange(30)))))
    return rows


def test_sums_by_blocks_match_the_definition(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TASK_SOURCES", 3)
    monkeypatch.setattr(divergence, "TASK_POSTINGS", 40)
    monkeypatch.setattr(divergence, "HELD_COUNTS", 50)
    rows = sample(random.Random(1), 400)
    got = audit_sources(spark.createDataFrame(rows, "lang string, source string, text string"), min_docs=5, top=6).collect()
    expected = plain(rows, 5, 6)
    assert {tuple(r) for r in got} == expected and len(got) == len(expected) > 150


@pytest.mark.parametrize("top", [1, 3, 50])
def test_search_by_bounds_matches_a_full_sort(spark, top):
    """Buckets of several counts, ties at the kth place, and groups of fewer terms than asked for."""
    rng = random.Random(top)
    rows = []
    for source in ("a", "b", "c"):
        for k in range(200 if source != "c" else 2):
            n = rng.choice([1, 2, 40, 41, 42, 43, 90, 3000])
            rows.append(("en", source, f"t{rng.randrange(10_000)}", n, 1000 + n * 10, 1000 + rng.choice([0, 5, n * 4, n * 12])))
    rows = list({r[1:3]: r for r in rows}.values())
    got = {tuple(r) for r in leading_terms(spark.createDataFrame(rows, "lang string, source string, term string, n long, p long, q long"), top).collect()}
    expected = set()
    for source in ("a", "b", "c"):
        above = sorted(((r[2], r[4] - r[5]) for r in rows if r[1] == source and r[4] > r[5]), key=lambda x: (-x[1], x[0]))[:top]
        expected |= {("en", source, t, v, k) for k, (t, v) in enumerate(above, 1)}
    assert got == expected


def test_counts_beyond_long_and_odd_tables(spark):
    wide = spark.createDataFrame([(9 * 10**17, 10**18, 3)], "a long, b long, v long").select(divergence._probability("a", "b", "v").alias("p")).first()[0]
    assert wide == 1 + 10**9 * (9 * 10**17 + 5) // (10**18 + 15)
    empty = spark.createDataFrame([], "text string, lang string, source string, rank int, value string")
    assert audit_sources(empty).count() == 0
    rows = [(None, None, "x y z" * 3, 1, "v")] * 3 + [("en", "long", "word " * 50_000 + "é" * 100_000, 2, "v")]
    got = audit_sources(spark.createDataFrame(rows, "lang string, source string, text string, rank int, value string"), min_docs=1).collect()
    assert {(r["lang"], r["source"], r["part"]) for r in got} <= {("", "", "term"), ("en", "long", "term")}
    groups, postings = tables(spark.createDataFrame(rows[:3], "lang string, source string, text string, rank int, value string"), 30)
    assert groups.count() == 1 and postings.count() == 0 and source_distances(groups, postings).count() == 0
