import random
import re

import corpus_pipeline
import numpy as np
import pytest
import xxhash

from tessera.llm.simhash import (
    alike_edges, bands_of, close_edges, copy_groups, drop_near_duplicates, fingerprint, link_fingerprints, shingle_hashes, simhash_groups, trees,
)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_matches_plain_and_spark(spark, monkeypatch):
    rng = random.Random(1)
    texts = [None, "", " \n", "One", "one two", "É é A", "a b c d\x0be\x1cf"] + [" ".join(rng.choice(["Aa", "b", "ÇÉ", "dd\t", "e\n"]) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    monkeypatch.setattr("tessera.llm.simhash.STEP_WORDS", 7)
    assert [fingerprint(t) for t in texts] == [plain(t) for t in texts]
    assert spark.sql("SELECT xxhash64('one two three')").first()[0] % 2**64 == xxhash.xxh64_intdigest("one two three", 42)


def groups_of(fps, radius=3):
    root = list(range(len(fps)))
    near = np.bitwise_count(np.array(fps, np.uint64)[:, None] ^ np.array(fps, np.uint64)[None, :]) <= radius
    changed = True
    while changed:
        changed = False
        for i, j in np.argwhere(near):
            low = min(root[i], root[j])
            changed |= root[i] != low or root[j] != low
            root[i] = root[j] = low
    return root


def planted(rng, n):
    fps = []
    while len(fps) < n:
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 3, 12])):
            fps.append(f)
            for _ in range(rng.randint(0, 5)):
                f ^= 1 << rng.randrange(64)
    return list(dict.fromkeys(fps))


@pytest.mark.parametrize("leaf", [16, 64, 8192])
def test_links_match_brute_force(spark, leaf):
    fps = planted(random.Random(2), 600)
    rows = [(int(np.array([f], np.uint64).view(np.int64)[0]), i) for i, f in enumerate(fps)]
    got = {r["node"]: r["component"] for r in link_fingerprints(spark.createDataFrame(rows, "fp long, rep long"), leaf=leaf).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == groups_of(fps)


def test_close_pairs_share_a_leaf():
    rng = random.Random(3)
    fps = np.array(planted(rng, 3000), np.uint64)
    made = trees(fps, 5, 3)
    assert all(t.leaves > 4 for t in made)
    leaves = []
    for t in made:
        row, leaf = t.leaves_of(fps)
        mine = [set() for _ in fps]
        for r, x in zip(row.tolist(), leaf.tolist()):
            mine[r].add(x)
        leaves.append(mine)
    near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, 1))
    assert len(near) > 100
    assert all(any(mine[i] & mine[j] for mine in leaves) for i, j in near)


def test_edges_across_blocks_only():
    fps = np.array([0, 1, 3, 2], np.uint64)
    a, b = close_edges(fps, np.array([10, 11, 12, 13]), np.array([0, 0, 1, 1]), 0)
    assert len(a) == 0
    a, b = close_edges(fps, np.array([10, 11, 12, 13]), np.array([0, 0, 1, 1]), 3)
    assert set(a) == {11, 12, 13} and set(b) == {10}


def test_groups_and_one_row_of_each(spark):
    base = " ".join(f"word{i}" for i in range(200))
    rows = [(5, base, "a"), (3, base.upper(), "b"), (9, base + " tail", "c"), (7, None, "d"), (8, "", "e"), (1, "something else entirely here", "f"), (None, base, "g"), (None, "lonely null text", "h"), (3, base, "i"), (11, "w " * 50_000, "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash_groups(docs).collect()
    assert sorted((r["fingerprint"], r["doc_id"] or -1) for r in got) == sorted((f"{plain(t):016x}", i or -1) for i, t, _ in rows)
    component = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    assert component == {5: 3, 3: 3, 9: 3 if np.bitwise_count(np.uint64(plain(base) ^ plain(base + " tail"))) <= 3 else 9, 7: 7, 8: 7, 1: 1, 11: 11}
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] if r["doc_id"] is not None else -1 for r in kept.collect()))
    assert ids == [-1, -1, *sorted(set(component.values()))]
    assert simhash_groups(docs.limit(0)).count() == 0


def test_rows_of_one_id_tie_their_groups(spark):
    a, b = " ".join(f"x{i}" for i in range(90)), " ".join(f"y{i}" for i in range(90))
    got = simhash_groups(spark.createDataFrame([(1, a), (5, a), (5, b), (7, b)], "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {1}


def shingle_groups(texts):
    """Groups by a share of 0.8 or more of the five-word shingles, in plain Python."""
    sets = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and 10 * len(a & b) >= 8 * len(a | b):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


@pytest.mark.parametrize("block", [4, 512])
def test_near_copies_at_any_share_of_shingles(spark, monkeypatch, block):
    monkeypatch.setattr("tessera.llm.simhash.COPY_BLOCK", block)
    rng = random.Random(5)
    texts = [None, "", "one two", "One TWO", "one two three"]
    for _ in range(12):
        base = [f"w{rng.randrange(10_000)}" for _ in range(rng.randint(60, 300))]
        for copy in range(12):
            words = list(base)
            for _ in range(copy * len(base) // 250):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10_000)}"
            texts.append(" ".join(words))
    rows = list(enumerate(texts)) + [(None, texts[-1])]
    got = {r["doc_id"]: r["component_id"] for r in copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["doc_id"] is not None}
    assert [got[i] for i in range(len(texts))] == shingle_groups(texts)
    assert 12 < len(set(got.values())) < len(texts) - 60


def test_alike_across_blocks_only():
    sets = [np.arange(k, 20 + k, dtype=np.uint64) for k in (0, 1, 2, 3)]  # neighbours share 19 of 21, the next but one 18 of 22
    a, b = alike_edges(sets, np.array([10, 11, 12, 13]), np.array([0, 0, 1, 1]), 0.85)
    assert (a.tolist(), b.tolist()) == ([12], [11])


def test_pipeline_stage_catches_near_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    expected = [rows[k][0] for k in sorted(set(shingle_groups([t for _, t in rows])))]
    kept = dict(corpus_pipeline.STAGES)["simhash"](spark, docs, "/root/testdata/sf0.001")
    assert sorted(r["doc_id"] for r in kept.collect()) == expected


def chain(n, seed=0):
    """Texts of 60 words, each starting eight words after the one before: neighbours have 0.75 of their five-word shingles in common, so that no pair links."""
    words = [f"w{seed}x{k}" for k in range(60 + 8 * n)]
    return [(i, " ".join(words[8 * i : 8 * i + 60])) for i in range(n)]


def test_a_chain_of_candidates_is_dealt_in_proportion(spark, monkeypatch):
    from tessera.llm import simhash

    dealt = []
    plain = simhash.dealt_apart

    def counted(rows):
        out = plain(rows)
        dealt.append((out.count(), out.select("tile", "block_a", "block_b").distinct().count()))
        return out

    monkeypatch.setattr(simhash, "dealt_apart", counted)
    for n in (1_000, 4_000):
        got = copy_groups(spark.createDataFrame(chain(n), "doc_id long, text string")).collect()
        assert all(r["doc_id"] == r["component_id"] for r in got)
    assert dealt[1][0] <= 4.4 * dealt[0][0] and dealt[1][1] <= 4 * dealt[0][1] + 2, dealt


def test_recall_of_short_texts():
    """Bands that near copies of 5 to 20 words meet in, where least hashes are few and not independent."""
    rng, met, pairs = random.Random(3), 0, 0
    for n in range(5, 21):
        for _ in range(60):
            words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            other = words + [f"x{rng.randrange(10**6)}"]
            a, b = shingle_hashes(" ".join(words)), shingle_hashes(" ".join(other))
            if 10 * len(np.intersect1d(a, b)) >= 8 * len(np.union1d(a, b)):
                pairs += 1
                met += bool((bands_of(a) == bands_of(b)).any())
    assert pairs > 500 and met >= 0.99 * pairs, (met, pairs)
