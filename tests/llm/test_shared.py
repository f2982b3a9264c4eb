import random

import numpy as np
import pytest

from tessera.llm.shared import Words, block_tasks, connected_components


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components_match_union_find(spark, shape):
    rng = random.Random(5)
    pairs = {
        "path": [(i, i + 1) for i in range(60)],
        "star": [(500, i) for i in range(80)] + [(900, 901)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)],
    }[shape]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    expected = {x: find(x) for p in pairs if p[0] != p[1] for x in p}
    got = connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == expected
    assert len(got) == len(expected)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_block_tasks_bring_each_pair_together_once(spark):
    rows = spark.createDataFrame([(c, c * 1000 + i) for c, n in ((1, 3), (2, 50)) for i in range(n)], "cell long, id long")
    dealt = block_tasks(rows, ["cell"], "id", 8).collect()
    tasks = {}
    for r in dealt:
        tasks.setdefault((r["cell"], r["block_a"], r["block_b"]), []).append((r["id"], r["block"]))
    seen = []
    for (cell, a, b), members in tasks.items():
        for x in members:
            for y in members:
                if x[0] < y[0] and (a == b or x[1] != y[1]):
                    seen.append((x[0], y[0]))
    expected = sorted((c * 1000 + i, c * 1000 + j) for c, n in ((1, 3), (2, 50)) for i in range(n) for j in range(i + 1, n))
    assert sorted(seen) == expected


def test_words_of_bytes():
    texts = ["Ab c-9 élan", "", "  ", "x" * 3000 + " ab", "AB"]
    words = Words([t.encode() for t in texts])
    assert np.diff(words.first).tolist() == [4, 0, 0, 2, 1]
    assert words.hash[0] == words.hash[5] == words.hash[6]
    assert len(set(words.hash.tolist())) == 5


def test_large_ids_beside_nulls_stay_exact(spark):
    from tessera.llm import chat_format, decontaminate, language_id, license_scan, lm_score, packing, pii, simhash

    big = 2**62 + 1
    docs = spark.createDataFrame([(big, "some words for everyone here", None), (None, "other words", 7)], "doc_id long, text string, n long").coalesce(1)
    items = spark.createDataFrame([(big, "some words for everyone here")], "item_id long, text string")
    model = language_id.train_filter(spark.createDataFrame([("some words", "en")], "text string, lang string"))
    frames = [
        simhash.simhash_groups(docs), license_scan.scan_licenses(docs), pii.find_personal_data(docs), lm_score.score_corpus(docs), packing.pack_documents(docs),
        decontaminate.flag_contaminated(docs, items), language_id.identify(docs, model),
    ]
    for frame in frames:
        assert {r["doc_id"] for r in frame.collect()} == {big, None}
    assert decontaminate.contamination(docs, items).first()["item_id"] == big
    assert {r["n"] for r in language_id.identify(docs, model).collect()} == {None, 7}
    rows = docs.selectExpr("doc_id as conv_id", "1 as turn", "'user' as role", "text")
    assert {r["conv_id"] for r in chat_format.digests(chat_format.format_conversations(rows)).collect()} == {big, None}


def test_word_hashes_do_not_depend_on_other_words():
    import subprocess
    import sys

    code = "from tessera.llm.shared import Words; print(Words([b'a b']).hash.tolist()); print(Words([b'a b longer']).hash.tolist()[:2])"
    short, long = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.splitlines()
    assert short == long
