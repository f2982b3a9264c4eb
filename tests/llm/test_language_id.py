import random
import zlib

from tessera.llm.language_id import UNKNOWN, LanguageFilter, held_out, identify, session_filter, train_filter

STEMS = {"en": "the and ing tion er of with that", "de": "der und ung schaft ein lich über straße", "ru": "это был что как для привет мир", "es": "que ción los mente por está niño"}


def corpus(n=200, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(STEMS))
        words = STEMS[lang].split()
        rows.append((i, " ".join("".join(rng.choice(words) for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(8, 60))), lang))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train_filter(docs.filter(~held_out()))
    got = {r["doc_id"]: r for r in identify(docs, model).collect()}
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(test) > 50
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in test) >= 0.97 * len(test)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_odd_rows(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    model = train_filter(docs)
    odd = [(1, None, "en", 1), (2, "", "de", 2), (3, "12 34 !?", None, 3), (4, "the and with that", None, 4), (4, "the and with that", None, 4), (None, "und der ein", "xx", 5), (6, "漢字漢字", None, 6), (7, "the " * 300_000, None, 7)]
    got = identify(spark.createDataFrame(odd, "doc_id long, text string, lang string, score int"), model).collect()
    assert [r["lang_pred"] for r in got[:3]] == [UNKNOWN] * 3 and [r["score"] for r in got[:3]] == [0.0] * 3
    assert [r["lang_pred"] for r in got[3:6]] == ["en", "en", "de"] and got[7]["lang_pred"] == "en"
    assert got[6]["lang_pred"] in STEMS and got[6]["score"] == 0.0
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert identify(empty, model).count() == 0
    assert [r["lang_pred"] for r in identify(docs, train_filter(empty)).limit(3).collect()] == [UNKNOWN] * 3


def test_steps_do_not_change_counts(monkeypatch):
    import numpy as np

    import tessera.llm.language_id as m

    texts = [t.encode() for _, t, _ in corpus(40)] + [b"", b"a", b"abc" * 4000]
    members = {"a": np.unique(m.grams(np.frombuffer(m.normalised(texts[0]), np.uint8))), "b": np.unique(m.grams(np.frombuffer(m.normalised(texts[1]), np.uint8)))}
    model = LanguageFilter.build(members, "a")
    whole = model.rates(texts)
    single = np.concatenate([model.rates([t]) for t in texts])
    monkeypatch.setattr(m, "CHUNK_BYTES", 100)
    assert np.allclose(whole, single) and np.allclose(whole, model.rates(texts))


def test_filter_keeps_the_rest(spark):
    rows = [*corpus(), (900, None, "en"), (901, "123", "en")]
    kept = session_filter(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert kept.columns == ["doc_id", "text", "lang"]
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(200))


def test_more_languages_than_a_word_has_bits(spark):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    stems = {f"l{k:03}": ["".join(rng.choice(letters) for _ in range(5)) for _ in range(6)] for k in range(150)}
    rows = [(i, " ".join(rng.choice(stems[lang]) for _ in range(20)), lang) for i, lang in enumerate(list(stems) * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train_filter(docs)
    assert model.masks.shape[1] == 3 and len(model.languages) == 150
    got = {r["doc_id"]: r["lang_pred"] for r in identify(docs, model).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 0.98 * len(rows)


def test_rates_match_a_naive_counter():
    """Without the filter, from sets: each n-gram's share in a language differs by false positives only."""
    import numpy as np

    import tessera.llm.language_id as m

    texts = [t for _, t, _ in corpus(60)] + ["漢字 mixed the und", "x", ""]
    split = lambda t: [m.normalised(t.encode())[k : k + 4] for k in range(max(0, len(m.normalised(t.encode())) - 3))]
    sets = {lang: {g for t in texts[k * 12 : k * 12 + 12] for g in split(t)} for k, lang in enumerate("abcde")}
    model = LanguageFilter.build({k: np.array(sorted(int.from_bytes(g, "little") for g in v), np.uint64) for k, v in sets.items()}, "a")
    rates = model.rates([t.encode() for t in texts])
    for t, row in zip(texts, rates):
        own = split(t)
        for k, lang in enumerate("abcde"):
            exact = sum(g in sets[lang] for g in own) / max(1, len(own))
            assert abs(exact - row[k]) < 0.01, (t, lang)


def test_clashing_columns_stay(spark):
    rows = [(i, text, lang, 777.0, "mine", 0.5, i) for i, text, lang in corpus(60)]
    docs = spark.createDataFrame([*rows, (99, "12", "en", 1.0, "x", 0.1, 9)], "doc_id long, text string, lang string, score double, lang_pred string, RATE double, _language int")
    kept = session_filter(spark, docs)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == rows
    again = session_filter(spark, docs.unionByName(docs))
    assert again.count() == 2 * len(rows) and session_filter(spark, docs.limit(0)).count() == 0
