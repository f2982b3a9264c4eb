import hashlib
import random
import re
import timeit

from tessera.llm.pii import _MARK, KINDS, all_spans, base_spans, find_personal_data, joined, luhn, trained, windows

PATTERNS = {
    0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    2: r"[0-9]([\x20-]?[0-9])+", 3: r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", m[0])
            good = {
                0: True, 1: kind != 1 or all(int(p) <= 255 for p in m[0].split(".")),
                2: 12 <= len(digits) <= 19 and luhn(digits), 3: 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_matches_plain_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("a.@-+1 2(0)5.%") for _ in range(rng.randint(0, 40)))
        assert base_spans(text) == plain(text), text


def test_long_runs_take_linear_time():
    text = "a" * 200_000 + "@" + "1" * 200_000 + " " + "1." * 50_000
    assert base_spans(text) is not None


def test_added_spans():
    field = trained()
    for text, kind, value in [
        ("call (415) 555-0134 now", "phone", "(415) 555-0134"), ("mail bob [at] example [dot] com please", "email", "bob [at] example [dot] com"),
        ("server 10[.]1[.]2[.]3 is up", "ip", "10[.]1[.]2[.]3"), ("card 4539.5787.6362.1486 x", "card", "4539.5787.6362.1486"),
        ("on +1 (269) 555-3296 4524132264652876 end", "card", "4524132264652876"),
    ]:
        spans = all_spans(text, base_spans(text), field)
        assert (kind, value) in [(KINDS[k], text[a:b]) for a, k, b in spans], text
    for text in ["order 20231212 of 2023-05-15 v 1.2.3", "pages 123 456 789", "the 555 1234", "at the end", "sha a95f8013a8e106335957369e74af1c836a0da03c", ""]:
        assert all_spans(text, base_spans(text), field) == [], text


def test_held_out_sentences():
    from tessera.llm.pii import Window, _example

    rng, field, right = random.Random(99), trained(), 0
    for _ in range(300):
        text, spans = _example(rng)
        right += sorted(field.best(Window(text, 0, len(text)))) == sorted(spans)
    assert right >= 240, right


def test_query_rows(spark):
    text = "Ünï a@b.co +1 (648) 555-1250 and 78.118.65.158"
    rows = [(1, text), (2, None), (3, ""), (4, text), (4, text), (None, "x" * 100_000)]
    got = {(r["doc_id"], i): r for i, r in enumerate(find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect())}
    assert len(got) == 6
    for r in got.values():
        expected = base_spans(text) if r["doc_id"] in (1, 4) else []
        assert r["base_sha256"] == hashlib.sha256(joined(expected).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[1] == k for s in expected) for k in range(4)]
        assert set(joined(expected).split(",")) <= set(r["spans"].split(",")) or not expected
    assert find_personal_data(spark.createDataFrame([], "doc_id long, text string, spans int")).count() == 0


def plain_windows(text):
    """The windows by the definition, in quadratic time."""
    found = []
    marks = [m.span() for m in re.finditer(r"\S+", text) if re.search("[0-9@]", m[0])] + [m.span() for m in _MARK.finditer(text)]
    for a, b in sorted(marks):
        for _ in range(4):
            a = max(text.rfind(c, 0, max(0, a - 1)) for c in " \n\t") + 1 if a > 0 else 0
            run = re.compile(r"\S+").search(text, b)
            b = run.end() if run else len(text)
        if found and a <= found[-1][1]:
            found[-1][1] = max(found[-1][1], b)
        else:
            found.append([a, b])
    return [tuple(x) for x in found]


def test_windows_match_their_definition():
    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choice(["a", "bc", " ", " ", "\n", "\t", "　", "7", "@", "[at]", "dot com", "漢"]) for _ in range(rng.randint(0, 60)))
        assert windows(text) == plain_windows(text), text


def test_added_spans_take_linear_time():
    field = trained()
    for piece in ["漢字" * 5 + "7" + "漢字" * 500, "漢字" * 500 + " ", "call (415) 555-0134 or mail a@b.co now, ", "1.2.3.4 ", "x" * 80 + "\n7 ", "[at]", "1.2.3.4", "a[at]b.c"]:
        took = []
        for n in (15_000, 30_000):
            text = (piece * (n // len(piece) + 1))[:n]
            base = base_spans(text)
            took.append(min(timeit.repeat(lambda: all_spans(text, base, field), number=1, repeat=2)))
        assert took[1] < 2.5 * took[0] + 0.1, (piece[:20], took)


def all_segmentations(items, n, at=0):
    """Every way to choose segments that don't overlap, as lists of (start, end, kind, score)."""
    if at >= n:
        yield []
        return
    yield from all_segmentations(items, n, at + 1)
    for item in items:
        if item[0] == at:
            for rest in all_segmentations(items, n, item[1]):
                yield [item, *rest]


def test_best_segmentation_of_all():
    from tessera.llm.pii import Window

    rng, field, several, margin = random.Random(8), trained(), 0, -4.0
    pieces = ["call +1 ", "415", "-", " ", "555", "0134", ".", "78.118.65.158", "bob", " [at] ", "x", "[dot]", "com", " card ", "4539", "(", ")", "id "]
    for _ in range(400):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(2, 9)))
        window = Window(text, 0, len(text))
        items = [(i, j, k, score - margin) for i, j, k, score in field.scored(window) if score > margin]
        best = max(sum(x[3] for x in chosen) for chosen in all_segmentations(items, len(window.tokens)))
        got = field.best(window, margin)
        scores = {(window.tokens[i][0], k, window.tokens[j - 1][1]): s for i, j, k, s in items}
        assert all(a[2] <= b[0] for a, b in zip(sorted(got), sorted(got)[1:])) and abs(sum(scores[s] for s in got) - best) < 1e-9, text
        several += len(items) > 2
    assert several > 50


def test_segments_state_features_of_their_text():
    """Features that are built up token by token are those of the segment's text."""
    from tessera.llm.pii import Window

    rng = random.Random(9)
    for _ in range(500):
        text = "".join(rng.choice("0123456789 .-()+/@a") for _ in range(30))
        window = Window(text, 0, len(text))
        for i, j, mask, names in window.segments():
            inner = text[window.tokens[i][0] : window.tokens[j - 1][1]]
            if mask == 0b1110:
                groups = re.findall("[0-9]+", inner)
                assert f"shape:{'-'.join(str(len(g)) for g in groups[:7])}" in names and f"seps:{''.join(sorted(set(re.sub('[0-9]', '', inner))))}" in names
                assert f"digits:{min(20, sum(map(len, groups)))}" in names
