import random
import re
import time
from re import _parser

from tessera.llm.license_scan import BASE, FORMS, GATE, Scanner, rules, scan_licenses, scan_text

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_force(text):
    words = WORD.findall(lower(text or ""))
    places = [(i, label) for phrase, label in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_matches_brute_force(spark):
    rng = random.Random(2)
    pieces = ["under", "the", "mit", "MIT", "license", "License,", "apache", "Apache", "version", "2", "2.0", "cc", "CC-", "by", "BY-", "nc", "é", "\n", "licenses", "x"]
    rows = [(i, rng.choice(["", "  "]).join(rng.choice(pieces) + rng.choice([" ", "\n", "--", " "]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "Released under the MIT License. " * 500), (None, "CC BY-NC"), (903, "CC BY-NC"), (903, "CC BY-NC")]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = sorted(((i, *brute_force(t)) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=str) == expected
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)


def test_rules_and_suppression():
    scanner = Scanner()
    assert len(scanner.rules) > 300
    cases = {
        "This work is licensed under the GNU General Public License, version 3.": {"gpl-3"},
        "SPDX-License-Identifier: GPL-2.0-or-later": {"gpl-2"},
        "see https://creativecommons.org/licenses/by-nc-sa/4.0/": {"cc-by-nc-sa"},
        "All rights reserved.": {"all-rights-reserved"},
        "Licensed under CC BY-NC-SA 4.0.": {"cc-by-nc-sa", "cc-by-nc"},
        "GNU Lesser General Public License v2.1": {"lgpl-2.1"},
        "mit der Apache und the license": set(),
    }
    for text, labels in cases.items():
        assert scan_text(scanner, text.encode())["labels"] == labels, text


def test_a_better_detection_inside_a_longer_one_stays():
    scanner = Scanner()
    tag = next(i for i, r in enumerate(scanner.rules) if r.form == "tag")
    name = next(i for i, r in enumerate(scanner.rules) if r.form == "name")
    assert scanner.resolved([(0, 50, name), (10, 20, tag), (12, 18, name), (12, 18, tag), (600, 610, name)]) == [(0, 50, name), (10, 20, tag), (600, 610, name)]


def test_gate_misses_no_rule():
    """Every pattern of literal words holds some gate word, so that the gate only saves time."""
    gate = [g.decode() for g in GATE]
    for rule in rules():
        parts = re.sub(r"\((?:[^()]|\([^()]*\))*\)[?]?|\(\?<!\\S\)|\(\?!\\S\)", " ", rule.pattern.pattern)
        text = rule.pattern.pattern
        assert any(g in text.replace("licen[cs]e", "license") for g in gate) or any(g in parts for g in gate), rule


def test_empty_table(spark):
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string, labels string")).collect() == []


def samples(parsed):
    """One text for each way through the alternatives of a parsed pattern, with options left out and taken."""
    texts = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "IN":
            more = ["x" if str(arg[0][0]) == "CATEGORY" and "WORD" in str(arg[0][1]) else "1" if str(arg[0][0]) == "CATEGORY" else chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0])]
        elif name == "BRANCH":
            more = [x for branch in arg[1] for x in samples(branch)]
        elif name == "SUBPATTERN":
            more = samples(arg[3])
        elif name == "MAX_REPEAT":
            more = [x * max(1, arg[0]) for x in samples(arg[2])]
            more = (["", more[0], more[-1]] if len(more) > 1 else ["", *more]) if arg[0] == 0 else more
        elif name in ("ASSERT", "ASSERT_NOT"):
            more = [""]
        else:
            raise ValueError(name)
        texts = [a + b for a in texts[:40] for b in more] if len(texts) * len(more) > 4000 else [a + b for a in texts for b in more]
    return texts


def test_keywords_are_in_every_alternative():
    for rule in rules():
        for text in samples(_parser.parse(rule.pattern.pattern)):
            assert rule.pattern.fullmatch(text), (rule, text)
            assert any(word in text for word in rule.keywords), (rule, text)
            assert all(piece in text for piece in rule.needs), (rule, text)
    assert sum(bool(rule.needs) for rule in rules()) > 200


def test_labels_that_no_gate_may_lose():
    scanner = Scanner()
    cases = {
        "under Creative Commons Zero": "cc0", "released under the GFDL": "gfdl", "MIT-No-Attribution": "mit-0", "mit\nno attribution": "mit-0",
        "the Public Domain Dedication and License": "pddl",
    }
    for text, label in cases.items():
        assert label in scan_text(scanner, text.encode())["labels"], text


def test_dense_detections_take_linear_time():
    scanner, took = Scanner(), []
    for n in (2_000, 4_000):
        text = ("SPDX-License-Identifier: MIT licensed under the Apache License, version 2.0. Ünï " * n).encode()
        began = time.time()
        spans = scan_text(scanner, text)["spans"]
        took.append(time.time() - began)
        words = WORD.findall(lower(text.decode()))
        assert len(spans) == 2 * n and all(" ".join(words[a:b]) in ("spdx license identifier mit", "licensed under the apache license version 2 0") for a, b, _, _ in spans)
    assert took[1] < 2.5 * took[0] + 0.2, took


def test_rule_layer_matches_a_plain_scan():
    """Every rule over every text without gates, and suppression by holding each detection against all better ones."""
    scanner, rng, several = Scanner(), random.Random(12), 0
    phrases = [rng.choice(samples(_parser.parse(rule.pattern.pattern))) for rule in scanner.rules for _ in range(2)]
    for _ in range(400):
        text = " ".join(rng.choice([rng.choice(phrases), "the", "mit", "license", "version 2", "under", "x", "licensed under the", "public"]) for _ in range(rng.randint(1, 9)))
        words = " ".join(WORD.findall(text))
        found = [(m.start(), m.end(), i) for i, rule in enumerate(scanner.rules) for m in rule.pattern.finditer(words)]
        priority = lambda x: (-FORMS[scanner.rules[x[2]].form][0], x[0] - x[1], x[2])
        kept = []
        for x in sorted(found, key=priority):
            if not any(y[0] <= x[0] and x[1] <= y[1] for y in kept):
                kept.append(x)
        expected = [(words[:a].count(" "), words[:b].count(" ") + 1, scanner.rules[i].label, scanner.rules[i].form) for a, b, i in sorted(kept)]
        got = scan_text(scanner, text.encode())
        assert got["spans"] == expected, text
        assert got["labels"] == {x[2] for x in expected} | got["base"]
        several += len(found) > len(kept) > 1
    assert several > 30
