import random
import re
from collections import Counter

import numpy as np

from tessera.llm import lm_score
from tessera.llm.shared import Words
from tessera.llm.lm_score import CLASSES, MEMBERS, PAD, SIDE, VOCABULARY, WindowNetwork, count_words, examples, framed, score_corpus, score_documents, train, vocabulary


def test_probabilities_sum_to_one_and_gradient_is_right():
    net = WindowNetwork.initial(np.ones(VOCABULARY))
    context = np.array([[1, 2, 3, PAD]])
    every = np.arange(VOCABULARY)
    p = np.exp(net.log_probabilities(np.repeat(context, VOCABULARY, axis=0), every))
    assert abs(p.sum() - 1) < 1e-4
    rng = np.random.default_rng(1)
    context, target = rng.integers(0, VOCABULARY + 1, (64, 2 * SIDE)), rng.integers(0, VOCABULARY, 64)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    before = {k: v.copy() for k, v in net.w.items()}
    squares = {k: np.full(v.shape, 1e12) for k, v in net.w.items()}
    net.learn(context, target, squares, rate=1e6)  # squares so large that a step is the gradient itself
    steps = {k: before[k] - net.w[k] for k in before}
    for name, where in [("vectors", (1, int(context[0, 1]), 3)), ("class_out", (2, int(target[0]) // MEMBERS)), ("out", (int(target[0]) // MEMBERS, 4, 1)), ("class_bias", (3,)), ("bias", (int(target[1]) // MEMBERS, 2))]:
        around = []
        for sign in (1, -1):
            w = {k: v.copy() for k, v in before.items()}
            w[name][where] += sign * 1e-4
            around.append(-WindowNetwork(w).log_probabilities(context, target).mean())
        assert abs((around[0] - around[1]) / 2e-4 - steps[name][where]) < 1e-5, name


def test_flat_round_trip():
    net = WindowNetwork.initial(np.arange(VOCABULARY))
    again = WindowNetwork.of(net.flat().astype(np.float64))
    assert all(np.array_equal(net.w[k], again.w[k]) for k in net.w)


def corpus(n=150):
    rng = random.Random(6)
    follow = {"a": "b c", "b": "c d", "c": "d e", "d": "e a", "e": "a b"}
    rows = []
    for i in range(n):
        words = ["a"]
        for _ in range(60):
            words.append(rng.choice(follow[words[-1]].split()))
        if i % 10 == 9:
            rng.shuffle(words)
        rows.append((i, " ".join(words)))
    return rows


def test_orderly_texts_score_higher(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(2).cache()
    got = {r["doc_id"]: r["mean_log_likelihood"] for r in score_corpus(docs).collect()}
    shuffled, orderly = [v for k, v in got.items() if k % 10 == 9], [v for k, v in got.items() if k % 10 != 9]
    assert np.mean([s < o for s in shuffled for o in orderly]) > 0.9


def test_scores_match_one_text_at_a_time(spark):
    rows = [*corpus(20), (100, None), (101, ""), (102, "..."), (103, "a"), (103, "a"), (None, "b b"), (104, "zz " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = vocabulary(docs)
    assert {r["n"] for r in count_words(spark.createDataFrame([(1, "x y x")], "doc_id long, text string")).collect()} == {1, 2}
    net = train(docs, words)
    got = score_documents(docs, words, net).collect()
    assert len(got) == len(rows)
    for r, (i, text) in zip(got, rows):
        context, target, _ = examples([(text or "").encode()], words)
        assert r["doc_id"] == i and r["n_tokens"] == len(target)
        if len(target):
            one = sum(float(net.log_probabilities(context[k : k + 1], target[k : k + 1])[0]) for k in range(min(len(target), 200)))
            assert len(target) > 200 or abs(one - r["log_likelihood"]) < 1e-3
        else:
            assert r["log_likelihood"] == 0 and r["mean_log_likelihood"] is None
    empty = spark.createDataFrame([], "doc_id long, text string, n int")
    assert score_corpus(empty).count() == 0
    assert CLASSES * MEMBERS == VOCABULARY


def rare_corpus(n=60):
    rng = random.Random(3)
    return [(i, " ".join(rng.choice("abcdefgh") if rng.random() < 0.6 else f"w{rng.randrange(400)}" for _ in range(80))) for i in range(n)] + [(70, None), (71, "w1 unseen"), (71, "w1 unseen"), (None, "w2 a"), (72, "...")]


def test_rare_words_have_their_share_of_a_bucket(spark, monkeypatch):
    """Against a scorer in plain Python, word by word, with a vocabulary too small for the corpus."""
    monkeypatch.setattr("tessera.llm.lm_score.FREQUENT", 10)
    rows = rare_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = count_words(docs).cache()
    words = vocabulary(docs, counts)
    assert not words.complete and len(words.hashes) == 10
    held = Counter(w for _, t in rows for w in re.findall(r"\w+", t or ""))
    assert sorted(held.values()) == sorted(r["n"] for r in counts.collect()) and words.counts.sum() == sum(held.values())
    net = train(docs, words)
    got = sorted(((r["doc_id"] or -1, r["n_tokens"], round(r["log_likelihood"], 4)) for r in score_documents(docs, words, net, counts).collect()))
    assert got == sorted((r["doc_id"] or -1, r["n_tokens"], round(r["log_likelihood"], 4)) for r in score_documents(docs, words, net).collect())
    id_of = {w: int(words.tokens(Words([w.encode()]).hash)[0][0]) for w in held}
    bucket = {w: bool(words.tokens(Words([w.encode()]).hash)[1][0]) for w in held}
    size = Counter()
    for w, n in held.items():
        size[id_of[w]] += n * bucket[w]
    expected = []
    for i, t in rows:
        own, total = re.findall(r"\w+", t or ""), 0.0
        ids = [PAD] * SIDE + [id_of[w] for w in own] + [PAD] * SIDE
        for k, w in enumerate(own):
            context = np.array([[*ids[k : k + SIDE], *ids[k + SIDE + 1 : k + 2 * SIDE + 1]]])
            total += float(net.log_probabilities(context, np.array([id_of[w]]))[0])
            total += np.log(held[w] / size[id_of[w]]) if bucket[w] else 0.0
        expected.append((i or -1, len(own), total))
    for a, b in zip(got, sorted(expected)):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 2e-3, (a, b)


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr("tessera.llm.lm_score.FREQUENT", 50)
    monkeypatch.setattr("tessera.llm.lm_score.PART_TOKENS", 150)
    docs = spark.createDataFrame(rare_corpus(200), "doc_id long, text string")
    found = []
    for n in (1, 3, 17):
        got = score_corpus(docs.repartition(n)).collect()
        found.append(sorted((r["doc_id"] or -1, r["n_tokens"], r["log_likelihood"]) for r in got))
    for other in found[1:]:
        assert all(a[:2] == b[:2] and abs(a[2] - b[2]) <= 1e-6 * max(1, abs(a[2])) for a, b in zip(found[0], other))


def test_held_out_loss_beats_unigrams(spark, monkeypatch):
    """Trained on some texts, tokens of others cost a fifth less than by their frequencies alone."""
    monkeypatch.setattr("tessera.llm.lm_score.STEP", 64)
    rows = corpus(400)
    train_docs, test_docs = (spark.createDataFrame([r for r in rows if (r[0] % 5 == 0) == held], "doc_id long, text string") for held in (False, True))
    counts = count_words(train_docs).cache()
    words = vocabulary(train_docs, counts)
    net = train(train_docs, words, share=1.0)
    got = score_documents(test_docs, words, net, counts).agg({"log_likelihood": "sum", "n_tokens": "sum"}).first()
    total = words.counts.sum()
    unigram = sum(np.log(words.counts[i] / total) for _, t in rows[::5] for i in words.tokens(Words([t.encode()]).hash)[0])
    n = sum(len(t.split()) for _, t in rows[::5])
    assert got["sum(n_tokens)"] == n and got["sum(log_likelihood)"] / n > 0.8 * unigram / n, (got, unigram / n)


def test_frames_are_the_examples_of_a_text(spark):
    texts = ["a b c d e f", "one", "", "x y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = vocabulary(docs)
    for text in texts:
        context, target, _ = examples([text.encode()], words)
        assert (framed(target.astype(np.uint16)) == np.column_stack([target, context]).reshape(len(target), 1 + 2 * SIDE)).all()


def test_learning_in_groups_of_classes_is_plain_gradient_ascent():
    """One step against the same step with every class by itself."""
    rng = np.random.default_rng(3)
    counts = rng.integers(1, 1000, VOCABULARY).astype(float)
    target = np.where(rng.random(300) < 0.5, rng.integers(0, VOCABULARY, 300), rng.integers(0, 5, 300))  # some classes with very many rows
    context = rng.integers(0, VOCABULARY + 1, (300, 2 * SIDE))
    net, plain = WindowNetwork.initial(counts), WindowNetwork.initial(counts)
    squares = {k: np.full(s, 1e-4, np.float32) for k, s in WindowNetwork.SHAPES.items()}
    net.learn(context, target, squares)
    h = plain.hidden(context)
    for c in np.unique(target // MEMBERS):
        rows = np.flatnonzero(target // MEMBERS == c)
        logits = h[rows] @ plain.w["out"][c] + plain.w["bias"][c]
        error = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
        error[np.arange(len(rows)), target[rows] % MEMBERS] -= 1
        for name, gradient in (("out", h[rows].T @ error / 300), ("bias", error.sum(axis=0) / 300)):
            expected = plain.w[name][c] - 0.1 * gradient / np.sqrt(1e-4 + gradient**2 + 1e-8)
            assert np.abs(net.w[name][c] - expected).max() < 1e-4
    idle = np.setdiff1d(np.arange(CLASSES), target // MEMBERS)
    assert (net.w["out"][idle] == plain.w["out"][idle]).all()


def test_training_predicts_every_token(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 97}" for j in range(k % 60))) for k in range(200)], "doc_id long, text string")
    words, seen, real = vocabulary(docs), [], lm_score.averaged

    def spied(nets, parts):
        nets = nets.persist()
        seen.append(sum(r["seen"] for r in nets.select("seen").collect()))
        return real(nets, parts)

    monkeypatch.setattr(lm_score, "averaged", spied)
    train(docs, words)
    assert sum(seen) == words.counts.sum() == sum(k % 60 for k in range(200))


def test_a_step_of_all_classes_matches_one_with_large_scores():
    """Scores too large for plain exponentials, and classes of very different sizes, against float64 with every row by itself."""
    rng = np.random.default_rng(5)
    target = np.concatenate([np.full(700, 3), rng.integers(0, VOCABULARY, 200)])
    context = np.concatenate([np.full((600, 2 * SIDE), 9), rng.integers(0, VOCABULARY + 1, (300, 2 * SIDE))])
    for size in (1, 60):
        net = WindowNetwork.initial(np.ones(VOCABULARY))
        net.w = {k: v * np.float32(1 if k == "vectors" else 10 * size) for k, v in net.w.items()}
        exact = {k: v.astype(np.float64) for k, v in net.w.items()}
        h = np.tanh(sum(exact["vectors"][k][context[:, k]] for k in range(2 * SIDE)))
        outer = h @ exact["class_out"] + exact["class_bias"]
        inner = np.einsum("nk,nkm->nm", h, exact["out"][target // MEMBERS]) + exact["bias"][target // MEMBERS]
        expected = 0.0
        for x, at in ((outer, target // MEMBERS), (inner, target % MEMBERS)):
            x = x - x.max(axis=1, keepdims=True)
            expected = expected + x[np.arange(900), at] - np.log(np.exp(x).sum(axis=1))
        assert np.abs(net.log_probabilities(context, target) - expected).max() < 2e-3 * size
        squares = {k: np.full(s, 1e-4, np.float32) for k, s in WindowNetwork.SHAPES.items()}
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            net.learn(context, target, squares)
        assert all(np.isfinite(v).all() for v in net.w.values())
        error = np.exp(outer - outer.max(axis=1, keepdims=True))
        error /= error.sum(axis=1, keepdims=True)
        error[np.arange(900), target // MEMBERS] -= 1
        gradient = error.sum(axis=0) / 900
        assert np.abs(net.w["class_bias"] - (exact["class_bias"] - 0.1 * gradient / np.sqrt(1e-4 + gradient**2))).max() < 1e-3


def test_steps_in_one_call_are_the_same_steps():
    rng = np.random.default_rng(8)
    target, context = rng.integers(0, 900, 500), rng.integers(0, 900, (500, 2 * SIDE))
    nets = [WindowNetwork.initial(np.ones(VOCABULARY)) for _ in range(2)]
    squares = [{k: np.full(s, 1e-4, np.float32) for k, s in WindowNetwork.SHAPES.items()} for _ in range(2)]
    nets[0].learn(context, target, squares[0], size=200)
    for at in (0, 200, 400):
        nets[1].learn(context[at : at + 200], target[at : at + 200], squares[1])
    assert all(np.array_equal(nets[0].w[k], nets[1].w[k]) and np.array_equal(squares[0][k], squares[1][k]) for k in nets[0].w)


def test_texts_framed_together_are_framed_one_by_one():
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, VOCABULARY, n).astype(np.uint16) for n in (3, 0, 1, 40, 2)]
    assert (lm_score.framed_texts([t.tobytes() for t in texts]) == np.concatenate([framed(t) for t in texts])).all()
    assert lm_score.framed_texts([]).shape == (0, 1 + 2 * SIDE)


def test_listed_and_joined_counts_give_the_same_scores(spark, monkeypatch):
    monkeypatch.setattr("tessera.llm.lm_score.FREQUENT", 10)
    docs = spark.createDataFrame(rare_corpus(), "doc_id long, text string")
    counts = count_words(docs).cache()
    words = vocabulary(docs, counts)
    net, found = train(docs, words), []
    for listed in (0, 100, 500_000):
        monkeypatch.setattr("tessera.llm.lm_score.LISTED", listed)
        found.append(sorted((r["doc_id"] or -1, r["n_tokens"], r["log_likelihood"]) for r in score_documents(docs, words, net, counts).collect()))
    for other in found[1:]:
        assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-6 for a, b in zip(found[0], other)) and len(other) == len(found[0])
