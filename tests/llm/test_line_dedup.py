import random
import time

from tessera.llm.line_dedup import dedup_lines, drop_repeated_lines


def brute_force(rows, min_chars=20, min_docs=3):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            held.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        ids = lambda line: held[key(line)] - {None}
        kept = [x for x in lines if len(key(x)) < min_chars or len(ids(x)) < min_docs or (i is not None and i == max(ids(x)))]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rng = random.Random(4)
    pool = ["a common line of more than twenty", "  A COMMON line of more than twenty\r", "short", "", "Éine Zeile mit Ümlauten, lang genug", "éine Zeile mit Ümlauten, lang genug", "exactly twenty chars", "nineteen characters", "x" * 50, "\t\x0bÉine Zeile mit ümlauten, lang genug\x0c"]
    rows = [(i, "\n".join(rng.choice(pool) + rng.choice(["", "", str(rng.randrange(9))]) for _ in range(rng.randint(1, 8)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "\n\n"), (7, rows[7][1]), (7, "another text\n" + pool[0]), (None, pool[0] + "\nown"), (None, pool[0]), (503, "\n".join(pool * 300))]
    docs = spark.createDataFrame([(*r, 1, 2, [3]) for r in rows], "doc_id long, text string, pos int, h1 int, _drop array<int>")
    got = dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "pos", "h1", "_drop", "n_lines", "n_dropped"]
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()), key=str) == brute_force(rows)


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_documents_take_linear_time(spark):
    took = []
    for n in (8_000, 16_000, 32_000):
        texts = ["\n".join(f"a line that three documents hold {k}" if k % 2 else f"own line of document number {i} {k}" for k in range(n)) for i in range(3)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()
        docs.count()
        began = time.time()
        assert {(r["n_lines"], r["n_dropped"]) for r in dedup_lines(docs).select("n_lines", "n_dropped").collect()} == {(n, n // 2), (n, 0)}
        took.append(time.time() - began)
    assert took[2] < 2.5 * took[1] + 1, took


def test_clashing_columns_stay(spark):
    rows = [(i, "a line that three documents hold\nown", 70 + i, 80 + i, 90 + i, [i]) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, N_DROPPED int, _lines int, `a.b` array<int>")
    got = drop_repeated_lines(docs)
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == [(i, rows[i][1] if i == 2 else "own", *rows[i][2:]) for i in range(3)]
    assert sorted(r["n_dropped"] for r in dedup_lines(docs.drop("N_DROPPED")).collect()) == [0, 1, 1]
