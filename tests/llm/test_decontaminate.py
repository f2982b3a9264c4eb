import random
import re

from tessera.llm.decontaminate import UNITS, contamination, drop_contaminated, flag_contaminated

ITEMS = [
    (1, "A farmer in Ohio named Tom Baker has 12 apples and gives 5 kg of them to his friend Tom before the long winter begins again."),
    (2, "Which river runs through the old town and under the stone bridge that soldiers built in the year of the great flood?"),
    (3, "short one"),
    (4, "seven words make one very small item"),
    (5, None), (None, "no id " * 10), (1, "A farmer in Ohio named Tom Baker has 12 apples and gives 5 kg of them to his friend Tom before the long winter begins again."),
]
FILL = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split()


def fill(rng, n=30):
    return " ".join(rng.choice(FILL) for _ in range(n))


def flags(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    if options:
        return {r["doc_id"]: r for r in contamination(docs, items, **options).collect()}
    return {r["doc_id"]: r for r in flag_contaminated(docs, items).collect()}


def test_leaks(spark):
    rng = random.Random(8)
    one, two = ITEMS[0][1], ITEMS[1][1]
    texts = [
        fill(rng) + " " + one + " " + fill(rng), fill(rng) + "\n" + two.upper() + fill(rng), two.replace(" ", "\n"), one.lower(),
        fill(rng) + one.replace("12", "31").replace("5 kg", "9 lbs").replace("Tom", "Jim").replace("Ohio", "Iowa"),  # other values, used alike
        fill(rng) + one.replace("friend Tom", "friend Ann").replace("Tom Baker", "Jim Baker").replace("12", "31"),  # two values for one
        "Seven words make one very small item", fill(rng, 300), "short one", None, "", two[:40], fill(rng, 50_000) + " " + two,
    ]
    got = flags(spark, texts)
    assert [got[i]["item_ids"] for i in range(len(texts))] == [[1], [2], [2], [1], [1], [], [4], [], [], [], [], [], [2]]
    assert got[4]["reworded"] and not got[0]["reworded"]
    # the join without the prefilter finds the same
    assert set(flags(spark, texts, max_broadcast=0)) == {i for i in got if got[i]["contaminated"]}


def test_rows_and_ids(spark):
    two = ITEMS[1][1]
    rows = [(1, two, 1), (1, "clean words only here and nothing else at all", 2), (None, two, 3), (None, "also clean", 4), (2, two, 5), (2, two, 6), (3, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, t1 int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r["t1"] for r in kept.collect()) == [2, 4, 7]
    assert flag_contaminated(docs, items).count() == len(rows)
    assert flag_contaminated(docs.limit(0), items).count() == 0
    assert drop_contaminated(docs, items.limit(0)).count() == len(rows)


def test_items_of_numbers(spark):
    train = "A train travels 60 km in 2 hours and 45 km in 3 hours. What is its speed?"
    items = spark.createDataFrame([(1, train), (2, "Compute 3 + 4 * 5 - 6 / 2 + 7 * 8 - 9")], "item_id long, text string")
    texts = [
        "lorem ipsum " + train, train.replace("60", "80").replace("45", "30"), "lorem compute 3 + 4 * 5 - 6 / 2 + 7 * 8 - 9 dolor",
        "compute 3 + 4 * 5 - 6 / 2 + 7 * 8 - 1", "compute 1 + 2 * 3 - 4 / 5 + 6 * 7 - 8", "it travels 60 km in 2 hours and 45 km in 3 hours",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for limit in (1_000_000, 0):
        got = {(r["doc_id"], r["item_id"]) for r in contamination(docs, items, max_broadcast=limit).collect()}
        assert got == {(0, 1), (1, 1), (2, 2)}


def test_verbatim_windows_beside_a_conflict(spark):
    item = (
        "The baker sold 12 loaves of bread on the first day of the fair. Her sister who came from the village "
        "by the lake brought 12 baskets of ripe apples for all of the children at the school."
    )
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [
        item.replace("12 baskets", "15 baskets"), item.replace("sold 12", "sold 15").replace("12 baskets", "31 baskets"),
        item.replace("12", "15"), "sold 15 loaves of bread on the first day and brought 31 baskets of ripe apples for all of the pupils",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["reworded"] for r in contamination(docs, items).collect()}
    assert got == {0: True, 1: False, 2: True}


def described(text):
    """(word, number or unit, name) of each word of an ASCII text, by the definition."""
    out, end = [], 0
    for m in re.finditer(r"[0-9A-Za-z]+", text):
        word, number_before = m[0].lower(), bool(out) and out[-1][1] == "number"
        kind = "number" if word.isdigit() else "unit" if number_before and word in UNITS else None
        opens = not out or re.search(r'[.!?:\n"]', text[end : m.start()])
        out.append((word, kind, m[0][0].isupper() and not opens))
        end = m.end()
    return out


def described_windows(words, width):
    """(place, what is compared, values of placeholders, plain) of every window."""
    for at in range(len(words) - width + 1):
        part = words[at : at + width]
        found = []
        for names in (True, False):
            slot = [kind or ("name" if names and name else None) for _, kind, name in part]
            if slot.count(None) >= min(4, width):
                found.append((tuple(k or f"={w}" for k, (w, _, _) in zip(slot, part)), [w for k, (w, _, _) in zip(slot, part) if k], False))
            elif not names:
                found.append((("plain", *(w for w, _, _ in part)), [], True))
        for shown, values, plain in found:
            yield at, shown, values, plain


def brute_leak(doc, item):
    item, doc = described(item), described(doc)
    if len(item) < 5:
        return False
    width = min(8, len(item))
    mine = list(described_windows(item, width))
    need = min(6, len(item) - width + 1)
    canonical = sum(sum(kind is None for _, kind, _ in item[at : at + width]) >= min(4, width) for at in range(len(item) - width + 1))
    shifts = {}
    for at, shown, values, plain in described_windows(doc, width):
        for place, wanted, own, _ in mine:
            if shown == wanted:
                shifts.setdefault(at - place, []).append((place, own, values, plain))
    places, free = set(), set()
    for rows in shifts.values():
        pairs = {p for _, own, values, _ in rows if own != values for p in zip(own, values)}
        good = len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})
        for place, own, values, plain in rows:
            if good or own == values:
                places.add(place)
                free |= set() if plain else {place}
    return len(places) >= need or len(free) >= (min(6, canonical) or 6)


def test_matches_brute_force(spark):
    rng = random.Random(88)
    plain = "how many apples does the old farmer sell before each long winter day begins again near that stone bridge".split()

    def made(kind):
        out = []
        for _ in range(rng.randint(5, 40)):
            r = rng.random()
            if kind != "named" and r < (0.6 if kind == "numeric" else 0.25):
                out.append(str(rng.randint(1, 9)) + rng.choice(["", " kg", " days", " +"]))
            elif kind != "numeric" and r > 0.75:
                out.append(rng.choice(["Tom", "Ann", "Ohio", "Lee"]))
            else:
                out.append(rng.choice(plain) + rng.choice(["", "", "", ".", ","]))
        return " ".join(out)

    items = [made(kind) for kind in ("numeric", "named", "mixed") for _ in range(12)]
    docs = []
    for text in items:
        swapped = re.sub(r"[0-9]+", lambda m: str(int(m[0]) + 20), text).replace("Tom", "Jim")
        uneven = re.sub(r"[0-9]+", lambda m: str(rng.randint(1, 9)), text)
        words = text.split()
        for body in (text, swapped, uneven, " ".join(words[: len(words) // 2]), " ".join(words[:-1] + ["other"])):
            docs.append(rng.choice(["", "so 5 ", "It was said: "]) + body + rng.choice(["", " kg and more 7"]))
    docs += [made("mixed") for _ in range(20)]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    wanted = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contamination(frame, wanted).collect()}
    assert got == {(d, i) for d, doc in enumerate(docs) for i, item in enumerate(items) if brute_leak(doc, item)}
    assert len(got) > 100


def test_phrase_that_all_items_begin_with(spark):
    """1,000 items and 1,000 documents share five windows: no pair of them is made, and a leak is still found."""
    from tessera.llm import decontaminate

    rng = random.Random(4)
    start = "read the passage below with care and then answer what is asked "
    items = spark.createDataFrame([(i, start + " ".join(f"w{rng.randint(0, 10**9)}x" for _ in range(12))) for i in range(1000)], "item_id long, text string")
    texts = [(i, start + " ".join(f"v{rng.randint(0, 10**9)}y" for _ in range(12))) for i in range(999)] + [(999, items.filter("item_id = 7").first()["text"])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    wanted = decontaminate.item_windows(items)
    rare = decontaminate.rare_windows(wanted, decontaminate.document_windows(docs, None, [8]))
    assert rare.groupBy("h").agg({"item_id": "count"}).filter("`count(item_id)` > 500").count() == 0
    assert [(r["doc_id"], r["item_id"]) for r in contamination(docs, items).collect()] == [(999, 7)]


def test_passage_that_many_documents_quote(spark):
    """A passage of one item that 500 documents quote, too short for a leak, isn't where its leaks are looked for."""
    from tessera.llm import decontaminate

    rng = random.Random(6)
    quoted = " ".join(f"q{k}z" for k in range(12))  # five windows
    rest = " ".join(f"r{k}z" for k in range(20))
    items = spark.createDataFrame([(1, f"{rest} {quoted}")], "item_id long, text string")
    texts = [(i, quoted + " " + " ".join(f"v{rng.randint(0, 10**9)}y" for _ in range(9))) for i in range(500)] + [(500, f"see {rest} {quoted}"), (501, rest)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    wanted, found = decontaminate.item_windows(items), decontaminate.document_windows(docs, None, [8])
    rare = decontaminate.rare_windows(wanted, found)
    assert found.join(rare, "h").select("doc_id").distinct().count() == 2
    assert sorted(r["doc_id"] for r in decontaminate.flag_contaminated(docs, items).filter("contaminated").collect()) == [500, 501]
