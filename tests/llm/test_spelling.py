import random
import re
import zlib
from collections import Counter

import pytest

from tessera.llm.spelling import Automaton, count_words, group_spellings, near_words, roots


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def made_up(rng, n, letters="abé"):
    words = set()
    while len(words) < n:
        word = "".join(rng.choice(letters) for _ in range(rng.randint(6, 9)))
        words.add(word)
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(word) + 1)
            words.add(word[:at] + rng.choice(["", *letters]) + word[at + rng.randint(0, 1) :])
    return sorted(w for w in words if len(w) >= 6)


def test_automaton_numbers_its_words_and_is_minimal():
    words = made_up(random.Random(1), 400)
    automaton = Automaton(words)
    for i, word in enumerate(words):
        state, number = automaton.walk(automaton.top, 0, word)
        assert number == i and automaton.states[state][0]
    assert automaton.sizes[automaton.top] == len(words)
    endings = set()  # states of a minimal automaton are as many as the prefixes' distinct sets of endings
    for prefix in {w[:k] for w in words for k in range(len(w) + 1)}:
        endings.add(frozenset(w[len(prefix) :] for w in words if w.startswith(prefix)))
    assert len(automaton.states) == len(endings)
    assert Automaton([]).sizes == [0]


def test_one_error_matches_all_pairs():
    words = made_up(random.Random(2), 300, "ab")
    automaton = Automaton(words)
    for word in words + ["aaaaaa", "babababa", "zzzzzz"]:
        for exact in (0, 3, len(word)):
            got = sorted(automaton.one_error(word, exact))
            expected = sorted((i, len(w) > len(word)) for i, w in enumerate(words) if len(w) >= len(word) and near(w, word) and w[:exact] == word[:exact])
            assert got == expected, (word, exact)


@pytest.mark.parametrize("shard", [8, 64, 16_384])
def test_near_words_match_all_pairs(spark, shard):
    rng = random.Random(3)
    words = {w: rng.choice([5, 6, 30, 30, 700]) for w in made_up(rng, 260) + ["encyclopaedia", "encyclopedia", "encyclopedias", "aaaaaaa", "aaaaaa", "aaaaab"]}
    got = {r["word"]: (r["n_near"], r["near_n"], r["near"]) for r in near_words(spark.createDataFrame(list(words.items()), "word string, n long"), shard).collect()}
    expected = {}
    for word in words:
        found = [w for w in words if near(w, word)]
        if found:
            best = min(found, key=lambda w: (-words[w], w))
            expected[word] = (len(found), words[best], best)
    assert got == expected and len(expected) > 150


def test_counts_and_slips(spark, monkeypatch):
    monkeypatch.setattr("tessera.llm.spelling.HELD_WORDS", 3)
    rng = random.Random(5)
    texts = [None, "", "École ÉCOLE école", "naïve×words÷x ÿÿÿÿÿÿ", "a1b2 don't"] + [" ".join(rng.choice(["Straße", "strasse", "WORDS", "café", "wordings"]) for _ in range(40)) for _ in range(120)]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)]
    expected = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            expected[run if h % 19 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    got = {r["word"]: r["n"] for r in count_words(spark.createDataFrame(rows, "doc_id long, text string"), min_chars=5, slip=19).collect()}
    assert got == {w: n for w, n in expected.items() if len(w) >= 5}


def plain(counts, times=5):
    """word -> (form, root, n, n_near, form_n), each pair of words compared."""
    forms, out = {}, {}
    for word, n in counts.items():
        found = [w for w in counts if near(w, word)]
        best = min(found, key=lambda w: (-counts[w], w), default=None)
        forms[word] = best if best is not None and counts[best] >= times * n else None
        out[word] = [forms[word], word, n, len(found), counts.get(forms[word])]
    for word in counts:
        while forms[out[word][1]] is not None:
            out[word][1] = forms[out[word][1]]
    return {w: tuple(x) for w, x in out.items()}


def test_forms_and_roots(spark):
    counts = {"because": 4000, "becuase": 3, "becaus": 40, "becauss": 8, "beecaus": 7, "another": 9, "anothers": 9, "rarely": 4, "longest" * 3_000: 6, "longest" * 3_000 + "s": 30}
    text = " ".join(f"{w} " * n for w, n in counts.items())
    rows = [(1, text, "x", 1), (2, None, "y", 2), (None, "becuase becuase", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in group_spellings(docs).collect()}
    expected = plain({w: n for w, n in (counts | {"becuase": 5}).items() if n >= 5})
    assert got == expected and got["beecaus"][:2] == ("becaus", "because") and got["anothers"][0] is None
    assert group_spellings(docs.limit(0)).count() == 0


def test_roots_of_long_chains(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(23)] + [("x", "w5"), ("y", "z")]
    got = {r["word"]: r["root"] for r in roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {**{f"w{k}": "w23" for k in range(23)}, "x": "w23", "y": "z"}
