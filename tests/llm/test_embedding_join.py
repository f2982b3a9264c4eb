import numpy as np
import pytest

from tessera.llm.embedding_join import embedding_groups

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(rows, least=0.93):
    n = len(rows)
    links = np.zeros((n, n), bool)
    for i, (_, a, la) in enumerate(rows):
        for j, (_, b, lb) in enumerate(rows):
            if i == j or la is None or la != lb or not usable(a) or not usable(b) or len(a) != len(b):
                continue
            x, y = np.array(a, np.float64), np.array(b, np.float64)
            links[i, j] = x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least
    group = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in np.argwhere(links):
            low = min(group[i], group[j])
            changed |= group[i] != low or group[j] != low
            group[i] = group[j] = low
    out = []
    for i, (v, _, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(n) if group[k] == group[i] and rows[k][0] is not None]
        least_id = min(ids) if ids else None
        out.append((v, int(links[i].sum()), least_id, v is not None and v == least_id))
    return sorted(out, key=str)


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("cell", [8, 4096])
def test_matches_brute_force(spark, cell):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(160):
        v = centres[rng.integers(6)] + rng.normal(0, rng.choice([0.05, 0.3, 1.0]), 8)
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(2))))
    rows += [(1000 + i, rows[3][1], rows[3][2]) for i in range(40)]  # a hot vector
    rows += [
        (2000, None, 1), (2001, [0.0] * 8, 1), (2002, [None, *rows[0][1][1:]], rows[0][2]), (2003, [float("nan")] * 8, 1),
        (2004, [float("inf"), *rows[0][1][1:]], rows[0][2]), (2005, rows[0][1], None), (2006, rows[0][1][:4], rows[0][2]),
        (2007, [], 1), (2008, rows[3][1], rows[3][2]), (2008, rows[3][1], rows[3][2]), (None, rows[3][1], rows[3][2]),
    ]
    got = embedding_groups(spark.createDataFrame(rows, SCHEMA), cell=cell).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_force(rows)


def test_empty_and_extra_columns(spark):
    assert embedding_groups(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, [1.0, 0.0], 0, 7, 7), (2, [1.0, 0.01], 0, 8, 8)]
    got = embedding_groups(spark.createDataFrame(rows, SCHEMA + ", node int, n_links int")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_huge_components_do_not_overflow(spark):
    rows = [(1, [1e300, 1e300], 0), (2, [1.0, 1.0], 0)]
    got = embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(r["n_links"] for r in got) == [1, 1]
