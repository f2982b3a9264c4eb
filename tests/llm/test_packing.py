import random

import numpy as np
import pytest

from tessera.llm.packing import pack, pack_documents


@pytest.mark.parametrize("seed", range(5))
def test_pieces_fit_and_bins_are_small(seed):
    rng = np.random.default_rng(seed)
    sizes = (64, 128, 256)
    lengths = np.minimum(rng.geometric(0.02, 700), 256) * (rng.random(700) > 0.02)
    bins, offsets, capacity = pack(lengths, sizes, 4)
    ends = {}
    for b in np.unique(bins):
        mine = np.flatnonzero(bins == b)
        used = int(lengths[mine].sum())
        size = set(capacity[mine].tolist())
        assert len(size) == 1 and used <= size.pop() == min(s for s in sizes if s >= used)
        spans = sorted((offsets[i], offsets[i] + lengths[i]) for i in mine if lengths[i])
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        ends[b] = used
    total = sum(int(capacity[bins == b][0]) for b in np.unique(bins))
    assert lengths.sum() >= 0.93 * total
    assert pack(np.zeros(0, np.int64), sizes)[0].tolist() == []


def test_matches_a_plain_best_fit_for_one_size():
    rng = random.Random(5)
    lengths = np.array([rng.randint(1, 100) for _ in range(300)])
    bins, offsets, _ = pack(lengths, (100,))
    room, expected = [], {}
    for i in sorted(range(300), key=lambda i: (-lengths[i], i)):
        fits = [(r, k) for k, r in enumerate(room) if r >= lengths[i]]
        if fits:
            k = min(fits)[1]
        else:
            k = len(room)
            room.append(100)
        room[k] -= lengths[i]
        expected[i] = k
    assert [expected[i] for i in range(300)] == bins.tolist()


def test_documents(spark):
    rng = random.Random(7)
    texts = [" ".join("w" for _ in range(rng.randint(0, 300))) for _ in range(200)] + [None, "", " \n ", "w " * 9_001, "dup", "dup"]
    rows = [(i if i < 204 else 900, t, 1) for i, t in enumerate(texts)] + [(None, "a b", 1), (None, "a b", 1)]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string, bin int"), shard_pieces=50).collect()
    whole = {}
    for r in got:
        whole.setdefault((r["doc_id"], r["copy"], r["n_tokens"] if r["doc_id"] is None else 0), []).append((r["start"], r["n_tokens"]))
    for (i, copy, _), pieces in whole.items():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:]))
        if i is not None and i < 204:
            assert sum(n for _, n in pieces) == len((texts[i] or "").split())
    assert len([r for r in got if r["doc_id"] == 900]) == 2 and len([r for r in got if r["doc_id"] is None]) == 2
    slots = {}
    for r in got:
        if r["n_tokens"]:
            slots.setdefault((r["shard"], r["bin"]), []).append((r["bin_offset"], r["bin_offset"] + r["n_tokens"], r["bin_tokens"]))
    for spans in slots.values():
        spans.sort()
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] <= spans[0][2]
    assert len({r["shard"] for r in got}) > 1
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_fill(falling, at, size):
    total = 0
    for n in falling[at:]:
        if n and total + n <= size:
            total += n
    return max(1, total)


def test_fill_and_choice_among_sizes_match_plain_versions():
    from tessera.llm.packing import _fill

    for seed in range(12):
        rng = random.Random(seed)
        lengths = np.array([rng.choice([0, 3, rng.randint(1, 20), rng.randint(1, 90)]) for _ in range(120)])
        falling = np.sort(lengths)[::-1]
        for at in range(0, 120, 7):
            for size in (16, 64, 90, 200):
                if falling[at] <= size:
                    assert _fill(falling, at, size) == plain_fill(falling.tolist(), at, size), (seed, at, size)
        sizes, cost = (16, 48, 96), 5
        bins, _, capacity = pack(lengths, sizes, cost)
        used, limit, where = [], [], {}
        for rank, i in enumerate(sorted(range(120), key=lambda i: (-lengths[i], i))):
            fits = sorted((limit[k] - used[k], k) for k in range(len(used)) if limit[k] - used[k] >= lengths[i] and limit[k] > used[k])
            if fits:
                k = fits[0][1]
            else:
                k = len(used)
                used.append(0)
                limit.append(min((s for s in sizes if s >= lengths[i]), key=lambda s: ((s + cost) / plain_fill(falling.tolist(), rank, s), s)))
            used[k] += lengths[i]
            where[i] = k
        assert [where[i] for i in range(120)] == bins.tolist(), seed
        assert capacity.tolist() == [min(s for s in sizes if s >= used[where[i]]) for i in range(120)]
