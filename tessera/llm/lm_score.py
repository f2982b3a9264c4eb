"""Masked pseudo-likelihood: a bidirectional window network, trained in numpy on all documents, scores each token from both sides.

The network predicts ids: of the most frequent words, and of buckets of all
others. A word in a bucket has its share of the bucket's tokens, from the
counts of the whole corpus, so that every word has a probability of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import Words, chunks, cut, encoded, ids_and_texts, mix, remove, scratch, with_long_ids

#: Classes and ids of a class; the ids of the last members are buckets of all words that are rarer than the others.
CLASSES, MEMBERS, BUCKETS = 128, 128, 1_024
#: Words on each side, width of the hidden layer, tokens of one step, step size.
SIDE, WIDTH, STEP, RATE = 2, 16, 2_048, 0.1
#: Such tokens, about, that one network is trained on before the networks are averaged; rounds of that; networks averaged at once.
PART_TOKENS, ROUNDS, FAN_IN = 1_000_000, 2, 16
#: Token pairs that scoring takes at once.
SCORE_STEP = 65_536
#: Words whose counts a task holds before it hands them on.
HELD_WORDS = 1_000_000
#: Rare words whose counts go to every task, at most; those of the others are joined.
LISTED = 500_000
#: Bytes of tokens that are framed at once.
TOKEN_BYTES = 200_000
#: Rows whose class scores are computed together.
BLOCK = 2_048
#: The largest sum of exponentials that is taken as it is.
LARGEST = 1e20
#: First bits of a hash by which the frequent words are looked up.
SLOT_BITS = 17
SLOTS = 1 << SLOT_BITS
VOCABULARY = CLASSES * MEMBERS
FREQUENT = VOCABULARY - BUCKETS
PAD = VOCABULARY  # what stands beyond the ends of a text


class WindowNetwork:
    """tanh of the sum of position-wise word vectors, then a two-step softmax: class, and token of the class."""

    SHAPES = {
        "vectors": (2 * SIDE, VOCABULARY + 1, WIDTH), "class_out": (WIDTH, CLASSES), "class_bias": (CLASSES,),
        "out": (CLASSES, WIDTH, MEMBERS), "bias": (CLASSES, MEMBERS),
    }

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def initial(cls, counts: np.ndarray, seed: int = 11) -> WindowNetwork:
        """The same start everywhere: small random weights, biases of the corpus's own token frequencies."""
        rng = np.random.default_rng(seed)
        w = {k: rng.normal(0, 0.1, shape).astype(np.float32) for k, shape in cls.SHAPES.items()}
        share = (counts + 1.0).reshape(CLASSES, MEMBERS)
        w["class_bias"] = np.log(share.sum(axis=1) / share.sum()).astype(np.float32)
        w["bias"] = np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)
        return cls(w)

    @classmethod
    def of(cls, flat: np.ndarray) -> WindowNetwork:
        sizes = np.cumsum([int(np.prod(s)) for s in cls.SHAPES.values()])
        parts = np.split(flat.astype(np.float32), sizes[:-1])
        return cls({k: p.reshape(s) for (k, s), p in zip(cls.SHAPES.items(), parts)})

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[k].ravel() for k in self.SHAPES])

    def hidden(self, context: np.ndarray) -> np.ndarray:
        flat = self.w["vectors"].reshape(-1, WIDTH)
        total = flat.take(context[:, 0], axis=0)
        for k in range(1, 2 * SIDE):
            total += flat.take(context[:, k] + k * (VOCABULARY + 1), axis=0)
        return np.tanh(total, out=total)

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log P(token | both sides) of each row."""
        h = _with_one(self.hidden(context))
        group, member = target // MEMBERS, target % MEMBERS
        out = np.empty(len(target))
        space, weights = np.empty((BLOCK, MEMBERS), h.dtype), np.empty((WIDTH + 1, MEMBERS), h.dtype)
        _log_softmax_at(h, _with_bias(self.w["class_out"], self.w["class_bias"]), group, out, np.empty((BLOCK, CLASSES), h.dtype))
        order, bounds = _by_class(group)
        h, member, inner = h.take(order, axis=0), member.take(order), np.empty(len(target))
        for c in range(CLASSES):
            rows = slice(bounds[c], bounds[c + 1])
            weights[:WIDTH], weights[WIDTH] = self.w["out"][c], self.w["bias"][c]
            _log_softmax_at(h[rows], weights, member[rows], inner[rows], space)
        out[order] += inner
        return out

    def learn(self, context: np.ndarray, target: np.ndarray, squares: dict[str, np.ndarray], rate: float = RATE, size: int | None = None) -> None:
        """Gradient ascent with per-weight step sizes, in steps of ``size`` rows each; one of all rows, if that isn't given."""
        w, n = self.w, len(target)
        merged = {k: [_with_bias(x[k], x[bias]) for x in (w, squares)] for k, bias in (("class_out", "class_bias"), ("out", "bias"))}
        merged["vectors"] = [x["vectors"].reshape(-1, WIDTH) for x in (w, squares)]
        for at in range(0, n, size or n):
            part = slice(at, at + (size or n))
            self._step(context[part], target[part], merged, rate)
        for k, bias in (("class_out", "class_bias"), ("out", "bias")):
            for x, both in zip((w, squares), merged[k]):
                x[k][...], x[bias][...] = both[..., :WIDTH, :], both[..., WIDTH, :]

    def _step(self, context: np.ndarray, target: np.ndarray, merged: dict[str, list], rate: float) -> None:
        """One step, on weights and squares that hold the biases as last rows.

        Softmaxes aren't divided by their sums: with e the exponentials less their sum at the target, a row's error is e by the sum, and
        the few numbers that it is multiplied with are divided instead.
        """
        n = len(target)
        order, bounds = _by_class(target // MEMBERS)
        context, target = context.take(order, axis=0), target.take(order)
        hidden = self.hidden(context)
        h = _with_one(hidden)
        weights, error = merged["class_out"][0], np.empty((n, CLASSES), h.dtype)

        def fill_classes() -> None:
            np.dot(h, weights, out=error)

        fill_classes()
        scale = _less_sums(error, fill_classes, target // MEMBERS, n)
        back, gradient = error @ weights[:WIDTH].T, (h * scale).T @ error
        back *= scale
        out = merged["out"][0]
        classes, slots, groups, size = _filled_up(bounds)
        some, filled, found = out.take(classes, axis=0), np.zeros((size, WIDTH + 1), h.dtype), np.empty((len(classes), *out.shape[1:]), h.dtype)
        filled[slots] = h
        inner_error, down = np.empty((size, MEMBERS), h.dtype), np.empty((size, WIDTH), h.dtype)

        def fill_members() -> None:
            for of, rows, shape in groups:
                np.matmul(filled[rows].reshape(*shape, -1), some[of], out=inner_error[rows].reshape(*shape, -1))

        fill_members()
        sums = _exponentials(inner_error, fill_members).take(slots)
        inner_error.reshape(-1)[slots * MEMBERS + target % MEMBERS] -= sums
        scale = (1 / (sums * n))[:, None]
        factor = np.zeros((size, 1), h.dtype)
        factor[slots] = scale
        filled *= factor
        for of, rows, shape in groups:
            errors = inner_error[rows].reshape(*shape, -1)
            np.matmul(errors, some[of, :WIDTH].transpose(0, 2, 1), out=down[rows].reshape(*shape, -1))
            np.matmul(filled[rows].reshape(*shape, -1).transpose(0, 2, 1), errors, out=found[of])
        inner_back = down.take(slots, axis=0)
        inner_back *= scale
        inner_gradient = np.empty_like(out) if len(classes) == CLASSES else np.zeros_like(out)
        inner_gradient[classes] = found
        _ascend(*merged["out"], inner_gradient, rate)
        _ascend(*merged["class_out"], gradient, rate)
        back += inner_back
        back *= 1 - hidden * hidden
        ids, gradient = _sums_by_id(context, back)
        vectors, squares = (x.take(ids, axis=0) for x in merged["vectors"])
        _ascend(vectors, squares, gradient, rate)
        for x, new in zip(merged["vectors"], (vectors, squares)):
            x[ids] = new


def _with_one(h: np.ndarray) -> np.ndarray:
    """Rows of the hidden layer, and a last column of ones for the biases."""
    out = np.ones((len(h), WIDTH + 1), h.dtype)
    out[:, :WIDTH] = h
    return out


def _with_bias(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Weights with the biases as their last row."""
    return np.concatenate([weights, bias[..., None, :]], axis=-2)


def _exponentials(x: np.ndarray, fill: Callable[[], None]) -> np.ndarray:
    """Makes each row of the scores x its exponentials, in place, but for a factor of the row; returns the rows' sums.

    Rows are as they are unless a sum is out of range; then ``fill`` writes the scores again, and each row's largest one is taken off first.
    """
    np.exp(x, out=x)
    sums = x @ np.ones(x.shape[1], x.dtype)
    if not (sums.max() < LARGEST and sums.min() > 1 / LARGEST):
        fill()
        x -= x.max(axis=1, keepdims=True)
        np.exp(x, out=x)
        sums = x.sum(axis=1)
    return sums


def _less_sums(x: np.ndarray, fill: Callable[[], None], at: np.ndarray, n: int) -> np.ndarray:
    """Makes x its exponentials less the row's sum at the target, in place; returns what turns that into the error of a row of n, as a column."""
    sums = _exponentials(x, fill)
    x.reshape(-1)[np.arange(0, x.size, x.shape[1]) + at] -= sums
    sums *= n
    return (1 / sums)[:, None]


def _ascend(weights: np.ndarray, squares: np.ndarray, gradient: np.ndarray, rate: float) -> None:
    """One step of weights, in place, by the squares of all their gradients; the gradient is used up."""
    sums = gradient * gradient
    squares += sums
    np.sqrt(squares, out=sums)
    gradient /= sums
    gradient *= np.float32(rate)
    weights -= gradient


def _by_class(group: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The rows in the order of their classes, and where each class begins."""
    order = np.argsort(group.astype(np.uint16), kind="stable")  # 16 bits are sorted by digits
    return order, [0, *np.cumsum(np.bincount(group, minlength=CLASSES)).tolist()]


def _filled_up(bounds: list[int]) -> tuple[np.ndarray, np.ndarray, list[tuple[slice, slice, tuple[int, int]]], int]:
    """How classes of about the same number of rows are worked on together, each filled up with rows of zeros to the largest of its group.

    The classes with rows, the largest first; the place of each row, if rows go by class; the groups, as (which of the classes, places,
    (classes, rows of each)); and the number of places.
    """
    sizes = np.diff(bounds)
    classes = np.argsort(-sizes, kind="stable")[: np.count_nonzero(sizes)]
    ordered, starts, groups, at, end = sizes[classes].tolist(), np.zeros(CLASSES, np.int64), [], 0, 0
    while at < len(ordered):
        large, to = ordered[at], at + 1
        while to < len(ordered) and 5 * ordered[to] >= 4 * large:
            to += 1
        starts[classes[at:to]] = end + large * np.arange(to - at)
        groups.append((slice(at, to), slice(end, end + (to - at) * large), (to - at, large)))
        at, end = to, groups[-1][1].stop
    return classes, np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], sizes), groups, end


def _sums_by_id(context: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place and id as one number, sum of ``back`` over the rows that have the id there), each pair once."""
    n, columns = len(context), context.T.astype(np.uint16)
    order = np.argsort(columns, axis=1, kind="stable")
    at = (columns.ravel().take(order + n * np.arange(2 * SIDE)[:, None]) + np.arange(2 * SIDE, dtype=np.int32)[:, None] * (VOCABULARY + 1)).ravel()
    rows, new = order.ravel(), np.ones(len(at) + 1, bool)
    np.not_equal(at[1:], at[:-1], out=new[1:-1])
    first = np.flatnonzero(new)
    ids, out = at.take(first[:-1]), back.take(rows.take(first[:-1]), axis=0)
    alone = new[:-1] & new[1:]
    several = np.flatnonzero(~alone.take(first[:-1]))
    if len(several):
        out[several] = np.add.reduceat(back.take(rows[~alone], axis=0), np.flatnonzero(new[:-1][~alone]), axis=0)
    return ids, out


def _log_softmax_at(h: np.ndarray, weights: np.ndarray, at: np.ndarray, out: np.ndarray, space: np.ndarray) -> None:
    """Puts the logarithm of each row's softmax at the target into ``out``; a block's scores, in ``space``, stay in the cache."""
    for first in range(0, len(h), BLOCK):
        part = slice(first, min(first + BLOCK, len(h)))
        x, cell = space[: part.stop - first], np.arange(0, (part.stop - first) * space.shape[1], space.shape[1]) + at[part]
        own = np.empty(len(x), x.dtype)

        def fill() -> None:
            np.dot(h[part], weights, out=x)

        def fill_again() -> None:
            fill()
            np.subtract(x.reshape(-1).take(cell), x.max(axis=1), out=own)

        fill()
        own[:] = x.reshape(-1).take(cell)
        sums = _exponentials(x, fill_again)
        np.subtract(own, np.log(sums), out=out[part])


class Vocabulary:
    """The most frequent words' hashes, sorted, and how many tokens each id has; ids are dealt so that each class has about the same share."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, buckets: np.ndarray):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        rank = np.empty(len(hashes), np.int64)
        rank[np.lexsort((hashes, -counts))] = np.arange(len(hashes))
        self.ids = self._id(rank)[order].astype(np.int32)
        self.bucket_ids = self._id(FREQUENT + np.arange(BUCKETS)).astype(np.int32)
        self.counts = np.zeros(VOCABULARY)
        self.counts[self.ids] = counts[order]
        self.counts[self.bucket_ids] = buckets
        self.complete = not buckets.any()
        starts = np.arange(SLOTS, dtype=np.uint64) << np.uint64(64 - SLOT_BITS)
        self.slots = np.searchsorted(self.hashes, starts).astype(np.uint16)  # the first hash that may begin with these bits

    @staticmethod
    def _id(rank: np.ndarray) -> np.ndarray:
        """Rank r is member r // CLASSES of class r % CLASSES."""
        return (rank % CLASSES) * MEMBERS + rank // CLASSES

    def tokens(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, whether it is a bucket's) of each word."""
        ids = self.bucket_ids.take((words & np.uint64(BUCKETS - 1)).astype(np.int64))
        if not len(self.hashes):
            return ids, np.ones(len(words), bool)
        at = self.slots.take((words >> np.uint64(64 - SLOT_BITS)).astype(np.int64)).astype(np.int64)
        last = len(self.hashes) - 1
        while True:
            found = self.hashes.take(at, mode="clip")
            on = (found < words) & (at < last)
            if not on.any():
                break
            at += on
        known = found == words
        return np.where(known, self.ids.take(at, mode="clip"), ids), ~known


def _added(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of words, from several; sorted by word."""
    word, n = (np.concatenate(x) for x in zip(*counts))
    order = np.argsort(word)
    word, n = word[order], n[order]
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1])[: len(word)])
    return word[first], np.add.reduceat(n, first) if len(n) else n


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): how often the corpus has each word, as the 64 bits of its hash; all texts, whole."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for _, part in chunks(encoded(batch["text"])):
                held.append(np.unique(Words(part).hash, return_counts=True))
                size += len(held[-1][0])
                if size > HELD_WORDS:
                    held = [_added(held)]
                    size = len(held[0][0])
                    if 2 * size > HELD_WORDS:
                        yield pd.DataFrame({"word": held[0][0].view(np.int64), "n": held[0][1]})
                        held, size = [], 0
        if held:
            word, n = _added(held)
            yield pd.DataFrame({"word": word.view(np.int64), "n": n})

    rows = docs.select(F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, counts: DataFrame | None = None) -> Vocabulary:
    """The ids for the words of ``docs``; ``counts`` are those of ``count_words``, if there are any yet."""
    counts = count_words(docs) if counts is None else counts
    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).toPandas()
    known = docs.sparkSession.createDataFrame([(int(x),) for x in top["word"]], "word long")
    # as unsigned numbers, words and buckets are the same in numpy: 2**64 is a multiple of BUCKETS
    rest = counts.join(F.broadcast(known), "word", "left_anti").groupBy(F.pmod("word", F.lit(BUCKETS)).alias("bucket")).agg(F.sum("n").alias("n")).toPandas()
    buckets = np.zeros(BUCKETS)
    buckets[rest["bucket"].to_numpy(np.int64)] = rest["n"].to_numpy(float)
    return Vocabulary(top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(float), buckets)


def examples(texts: list[bytes], words: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, target, text of each token): every token with the words on both sides inside its text."""
    return examples_and_rare(texts, words)[:3]


def examples_and_rare(texts: list[bytes], words: Vocabulary) -> tuple:
    """``examples``, and (text, word, times) of the words that are in buckets."""
    found = Words(texts)
    ids, rare = words.tokens(found.hash)
    n = len(ids)
    context = np.full((n, 2 * SIDE), PAD, np.int32)
    offsets = [*range(-SIDE, 0), *range(1, SIDE + 1)]
    for k, o in enumerate(offsets):
        a, b = max(0, -o), n - max(0, o)
        if a < b:
            same = found.text[a:b] == found.text[a + o : b + o]
            context[a:b, k] = np.where(same, ids[a + o : b + o], PAD)
    text, word = found.text[rare], found.hash[rare]
    order = np.lexsort((word, text))
    text, word = text[order], word[order]
    first = np.flatnonzero(np.diff(text, prepend=-1) | (np.diff(word.view(np.int64), prepend=0) != 0) | (np.arange(len(word)) == 0))
    times = np.diff(np.append(first, len(word)))
    return context, ids, found.text, (text[first], word[first], times)


def framed(tokens: np.ndarray) -> np.ndarray:
    """A row for each token of a text: itself, then the words on both sides."""
    if not len(tokens):
        return np.zeros((0, 1 + 2 * SIDE), np.uint16)
    padded = np.full(len(tokens) + 2 * SIDE, PAD, np.int64)
    padded[SIDE : SIDE + len(tokens)] = tokens
    seen = np.lib.stride_tricks.sliding_window_view(padded, 2 * SIDE + 1)
    return seen[:, [SIDE, *range(SIDE), *range(SIDE + 1, 2 * SIDE + 1)]].astype(np.uint16)


def framed_texts(blobs: list[bytes]) -> np.ndarray:
    """``framed`` of texts whose tokens are given as bytes, one text after the other."""
    gap = np.full(SIDE, PAD, np.uint16).tobytes()
    seen = np.lib.stride_tricks.sliding_window_view(np.frombuffer(gap + gap.join(blobs) + gap, np.uint16), 2 * SIDE + 1) if blobs else np.zeros((0, 2 * SIDE + 1), np.uint16)
    return seen[seen[:, SIDE] != PAD][:, [SIDE, *range(SIDE), *range(SIDE + 1, 2 * SIDE + 1)]]


def _places(keys: np.ndarray, blobs: list[bytes]) -> np.ndarray:
    """Each text's key and, added to it, the place of each of its tokens."""
    n = np.array([len(b) // 2 for b in blobs])
    return np.repeat(keys - (np.cumsum(n) - n).astype(np.uint64), n) + np.arange(n.sum(), dtype=np.uint64)


def token_texts(docs: DataFrame, words: Vocabulary, parts: int) -> DataFrame:
    """(round, part, key, tokens): the ids of each text's tokens, as bytes; where a text goes depends on it and its doc_id alone."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = batch["key"].to_numpy(np.int64)
            for first, part in chunks(encoded(batch["text"])):
                found = Words(part)
                ids = shared.value.tokens(found.hash)[0].astype(np.uint16)
                held = np.flatnonzero(np.diff(found.first))
                yield pd.DataFrame({"key": keys[first + held], "tokens": [ids[found.first[k] : found.first[k + 1]].tobytes() for k in held]})

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(F.lit("order"), text, F.col("doc_id").cast("string")).alias("key"), text.alias("text"))
    return rows.mapInPandas(packed, "key long, tokens binary").select(
        F.pmod("key", F.lit(ROUNDS)).alias("round"), F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part"), "key", "tokens"
    )


def averaged(nets: DataFrame, parts: int) -> bytes | None:
    """The mean of networks (part, weights, seen) by their tokens, in steps of ``FAN_IN``; sums go by part, so the result is always the same."""

    def mean(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        seen = group["seen"].sum()
        total = sum(np.frombuffer(w, np.float32).astype(np.float64) * (n / seen) for w, n in zip(group["weights"], group["seen"]))
        return pd.DataFrame({"part": [int(key[0])], "weights": [total.astype(np.float32).tobytes()], "seen": [seen]})

    while True:
        nets = cut(nets.groupBy(F.expr(f"cast(part div {FAN_IN} as int)").alias("part_")).applyInPandas(mean, "part int, weights binary, seen double"))
        parts = -(-parts // FAN_IN)
        if parts <= 1:
            found = nets.select("weights").collect()
            return bytes(found[0]["weights"]) if found else None


def train(docs: DataFrame, words: Vocabulary, share: float = 1.0) -> WindowNetwork:
    """A network trained on all documents, the same however ``docs`` is partitioned.

    Every token is predicted from those around it, or with a smaller ``share`` those that a hash of their text and place chooses. Texts
    are dealt by hash to ``ROUNDS`` rounds and to parts of about ``PART_TOKENS`` such tokens; in each round every part's
    network starts from the mean of the round before, learns in the order of the texts' hashes, and all are averaged by tokens.
    """
    spark = docs.sparkSession
    parts = max(1, int(words.counts.sum() * share / ROUNDS / PART_TOKENS))
    folder = scratch(spark, "tokens")
    token_texts(docs, words, parts).write.partitionBy("round").parquet(folder)
    net = WindowNetwork.initial(words.counts)
    for number in range(ROUNDS):
        start = spark.sparkContext.broadcast(net.flat())

        def learned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            part, trainer = None, None
            for batch in batches:
                parts_, keys, blobs = batch["part"].to_numpy(), batch["key"].to_numpy(np.int64).view(np.uint64), batch["tokens"].tolist()
                bounds = [0, *(np.flatnonzero(np.diff(parts_)) + 1).tolist(), len(blobs)]
                for at, end in zip(bounds, bounds[1:]):
                    if parts_[at] != part:
                        if trainer:
                            yield trainer.result(part)
                        part, trainer = int(parts_[at]), _Trainer(start.value)
                    for first, some in chunks(blobs[at:end], TOKEN_BYTES):
                        rows = framed_texts(some)
                        if share < 1:
                            spread = mix(_places(keys[at + first : at + first + len(some)], some)) >> np.uint64(20)
                            rows = rows[spread % np.uint64(1000) < np.uint64(round(1000 * share))]
                        trainer.add(rows)
            if trainer:
                yield trainer.result(part)

        rows = spark.read.schema("part int, key long, tokens binary, round int").parquet(folder).filter(F.col("round") == number)
        sorted_rows = rows.select("part", "key", "tokens").repartition(parts, "part").sortWithinPartitions("part", "key", "tokens")
        mean = averaged(sorted_rows.mapInPandas(learned, "part int, weights binary, seen double"), parts)
        if mean:
            net = WindowNetwork.of(np.frombuffer(mean, np.float32))
    remove(spark, folder)
    return net


class _Trainer:
    """One network that takes examples in any portions and learns from them in steps of the same size."""

    def __init__(self, flat: np.ndarray):
        self.net, self.held, self.size, self.seen = WindowNetwork.of(flat.copy()), [], 0, 0
        self.squares = {k: np.full(s, 1e-4, np.float32) for k, s in WindowNetwork.SHAPES.items()}

    def add(self, rows: np.ndarray) -> None:
        self.held.append(rows)
        self.size += len(rows)
        if self.size >= 8 * STEP:
            self._learn(self.size // STEP * STEP)

    def _learn(self, upto: int) -> None:
        rows = np.concatenate(self.held).astype(np.int64)
        self.net.learn(rows[:upto, 1:], rows[:upto, 0], self.squares, size=STEP)
        self.held, self.size, self.seen = [rows[upto:].astype(np.uint16)], len(rows) - upto, self.seen + upto

    def result(self, part: int) -> pd.DataFrame:
        if self.size:
            self._learn(self.size)
        return pd.DataFrame({"part": [part], "weights": [self.net.flat().astype(np.float32).tobytes()], "seen": [float(self.seen)]})


def _most_frequent(counts: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """Of words with counts ``held``: (hashes, sorted, and the logarithms of their counts) of all that occur at least so often, and that number.

    It is the least power of two that leaves ``LISTED`` words at most.
    """
    sizes = dict(counts.groupBy(F.length(F.bin("held")) - 1).count().collect())
    power, n = max(sizes, default=0) + 1, 0
    while power > 0 and n + sizes.get(power - 1, 0) <= LISTED:
        power -= 1
        n += sizes.get(power, 0)
    rows = counts.filter(F.col("held") >= 1 << power).toPandas()
    words = rows["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    return (words[order], np.log(rows["held"].to_numpy(float))[order]), 1 << power


def score_documents(docs: DataFrame, words: Vocabulary, net: WindowNetwork, counts: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, log_likelihood, mean_log_likelihood.

    log_likelihood sums log P(token | words on both sides) over all tokens of
    the whole text: the network's for the id and, where that is a bucket's, log of
    the word's share of the bucket by ``counts`` (of ``docs`` itself, if not given; a word without count counts as one). Null and
    empty texts, and texts without words, have no tokens, a sum of 0 and a null mean. Rows may repeat; an
    empty table gives no row; other columns are ignored.
    """
    if not words.complete:
        counts = count_words(docs) if counts is None else counts
        several = counts.filter("n > 1").select("word", F.col("n").alias("held"))  # of the others the logarithm is nothing
        listed, least = _most_frequent(several)
    else:
        listed = (np.zeros(0, np.uint64), np.zeros(0))
    shared = docs.sparkSession.sparkContext.broadcast((words, net, listed))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, model, (known, logs) = shared.value
        with np.errstate(divide="ignore"):
            share = np.where(np.isin(np.arange(VOCABULARY), vocabulary.bucket_ids), -np.log(np.maximum(vocabulary.counts, 1)), 0.0)
        for batch in batches:
            texts, row = encoded(batch["text"]), batch["row"].to_numpy(np.int64)
            n, total = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            for first, part in chunks(texts):
                context, target, text, rare = examples_and_rare(part, vocabulary)
                for at in range(0, len(target), SCORE_STEP):
                    now = target[at : at + SCORE_STEP]
                    where = text[at : at + SCORE_STEP] + first
                    n += np.bincount(where, minlength=len(texts))
                    total += np.bincount(where, model.log_probabilities(context[at : at + SCORE_STEP], now) + share[now], minlength=len(texts))
                if len(known):
                    at = np.minimum(np.searchsorted(known, rare[1]), len(known) - 1)
                    on = known[at] == rare[1]
                    total += np.bincount(first + rare[0][on], rare[2][on] * logs[at[on]], minlength=len(texts))
                    rare = tuple(x[~on] for x in rare)
                if len(rare[0]):
                    yield pd.DataFrame({"row": row[first + rare[0]], "word": rare[1].view(np.int64), "times": rare[2], "n": 0, "total": 0.0, "doc_id": None})
            # any word will do for a row's own sum, as it is taken no times
            yield pd.DataFrame({"row": row, "word": mix(row.view(np.uint64)).view(np.int64), "times": 0, "n": n, "total": total, "doc_id": batch["doc_id"]})

    schema = "row long, word long, times long, n long, total double, doc_id string"
    # as numbers: Spark sorts all rows to find the largest of strings
    found = with_long_ids(ids_and_texts(docs, F.monotonically_increasing_id().alias("row")).mapInPandas(scored, schema))
    if not words.complete:
        met = found.join(several.filter(F.col("held") < least), "word", "left")
        found = met.groupBy("row").agg(
            F.sum("n").alias("n"), F.sum(F.col("total") + F.col("times") * F.log(F.coalesce("held", F.lit(1)).cast("double"))).alias("total"), F.max("doc_id").alias("doc_id")
        )
    return found.select(
        "doc_id", F.col("n").alias("n_tokens"), F.col("total").alias("log_likelihood"), F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("mean_log_likelihood")
    )


def score_corpus(docs: DataFrame) -> DataFrame:
    """Count, train and score on ``docs``."""
    counts = cut(count_words(docs))
    words = vocabulary(docs, counts)
    return score_documents(docs, words, train(docs, words), counts)
