"""Spelling variants: words one error apart, found through minimal automata of both directions."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import LOWER, block_tasks, encoded, ids_and_texts, written

#: Distinct words that a task holds before it passes their counts on.
HELD_WORDS = 200_000
#: Rows of words, about, of one pair of automata; each word has up to four.
SHARD = 16_384
_RUN = re.compile(r"[a-zÀ-ÿ]+")


class Automaton:
    """The minimal acyclic automaton of sorted distinct words; a word's number is its place among them.

    A state is (is a word's end, letter -> (state, number of words before those through it)).
    """

    def __init__(self, words: list[str]):
        self.states: list[tuple[bool, dict[str, tuple[int, int]]]] = []
        self.sizes: list[int] = []
        known: dict[tuple, int] = {}
        path: list[tuple[list, list[bool]]] = [([], [False])]  # of the last word: edges (letter, state), end
        letters: list[str] = []

        def settled() -> int:
            edges, end = path.pop()
            key = (end[0], *edges)
            if key not in known:
                total, out = int(end[0]), {}
                for letter, state in edges:
                    out[letter] = (state, total)
                    total += self.sizes[state]
                known[key] = len(self.states)
                self.states.append((end[0], out))
                self.sizes.append(total)
            return known[key]

        for word in words:
            same = 0
            while same < len(letters) and same < len(word) and letters[same] == word[same]:
                same += 1
            while len(letters) > same:
                state = settled()
                path[-1][0].append((letters.pop(), state))
            for letter in word[same:]:
                letters.append(letter)
                path.append(([], [False]))
            path[-1][1][0] = True
        while letters:
            state = settled()
            path[-1][0].append((letters.pop(), state))
        self.top = settled()

    def walk(self, state: int, number: int, text: str) -> tuple[int, int] | None:
        """Where ``text`` leads from a state, and the number of words before that; None if nowhere."""
        states = self.states
        for letter in text:
            step = states[state][1].get(letter)
            if step is None:
                return None
            state, number = step[0], number + step[1]
        return state, number

    def one_error(self, word: str, exact: int) -> Iterator[tuple[int, bool]]:
        """(number, longer) of all words that start with the first ``exact`` letters of ``word`` and have one letter of the rest replaced, or one more there."""
        at = self.walk(self.top, 0, word[:exact])
        if at is None:
            return
        states, (state, number) = self.states, at
        for i in range(exact, len(word) + 1):
            edges = states[state][1]
            here = word[i] if i < len(word) else ""
            for letter, (target, skip) in edges.items():
                if letter == here:
                    continue
                if here:
                    found = self.walk(target, number + skip, word[i + 1 :])
                    if found is not None and states[found[0]][0]:
                        yield found[1], False
                found = self.walk(target, number + skip, word[i:])
                if found is not None and states[found[0]][0]:
                    yield found[1], True
            if here not in edges:
                return
            state, skip = edges[here]
            number += skip


def count_words(docs: DataFrame, min_chars: int = 6, slip: int | None = None) -> DataFrame:
    """(word, n): how often each word of at least ``min_chars`` letters occurs in the whole texts.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. With ``slip`` the words are as if typed with slips: where it divides
    the CRC-32 of `doc_id:word`, the letter at that number modulo the length is missing in the document; the doc_id of a row without one is empty.
    """

    def passed(held: Counter[str]) -> pd.DataFrame:
        return pd.DataFrame({"word": pd.Series(list(held), dtype=object), "n": list(held.values())})

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], encoded(batch["text"])):
                start = zlib.crc32(f"{doc_id or ''}:".encode())
                for word, n in Counter(_RUN.findall(text.translate(LOWER).decode("utf-8", "replace"))).items():
                    if slip:
                        h = zlib.crc32(word.encode(), start)
                        if h % slip == 0:
                            gone = h % len(word)
                            word = word[:gone] + word[gone + 1 :]
                    if len(word) >= min_chars:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield passed(held)
                    held.clear()
        yield passed(held)

    return ids_and_texts(docs).mapInPandas(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _halves(word: Column) -> Column:
    """Rows of a word: (backward, key, asks). Words of a length that have a half in common share a key, and so do those one letter longer, which only answer."""
    length = F.char_length(word)

    def row(backward: bool, asker: Column, asks: bool) -> Column:
        head = F.floor(asker / 2).cast("int")
        half = F.right(word, asker - head) if backward else F.left(word, head)
        return F.struct(F.lit(backward).alias("backward"), F.xxhash64(F.lit(backward), asker, half).alias("key"), F.lit(asks).alias("asks"))

    return F.array(*[row(b, length - int(not asks), asks) for b in (False, True) for asks in (True, False)])


def _shard_links(group: pd.DataFrame) -> pd.DataFrame:
    """Words of one task with near words: how many it found, and the most frequent of them, the smaller of equals."""
    by_key = group.groupby("key")["asks"]
    group = group[(by_key.transform("size") > 1) & by_key.transform("any")]  # the others have nobody to meet
    across = group["block_a"].min() < group["block_b"].max() if len(group) else False
    backward = bool(group["backward"].any())
    turned = (lambda w: w[::-1]) if backward else (lambda w: w)
    rows = dict(zip(group["word"], zip(group["n"].tolist(), group["block"].tolist())))
    spelled = sorted(map(turned, rows))
    automaton = Automaton(spelled)
    found: dict[str, list] = {}

    def note(word: str, near: str) -> None:
        n = rows[near][0]
        have = found.setdefault(word, [0, -1, ""])
        have[0] += 1
        if n > have[1] or n == have[1] and near < have[2]:
            have[1:] = n, near

    for word in dict.fromkeys(group.loc[group["asks"], "word"]):
        head = len(word) // 2
        for number, longer in automaton.one_error(turned(word), len(word) - head if backward else head):
            near = turned(spelled[number])
            if across and rows[word][1] == rows[near][1] or backward and near[:head] == word[:head]:
                continue  # that pair is another task's, or the other direction's
            note(word, near)
            if longer:
                note(near, word)
    columns = {"word": list(found), "n_near": [x[0] for x in found.values()], "near_n": [x[1] for x in found.values()], "near": [x[2] for x in found.values()]}
    return pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in columns.items()})


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, n_near, near_n, near) over distinct ``words`` (word, n) of two letters or more, for those one replaced, missing or added letter from another.

    One error leaves the first or the second half of the shorter word as it
    is. Words are dealt by their halves: by the first to shards with an
    automaton of the words as they are, by the second to shards with one of
    the words spelled backward. There each word follows its half exactly and is completed with one error; the
    words' numbers lead to what is known of them. A pair that both directions find counts in the first. A shard with
    more rows than ``shard`` is split into blocks, of which each two are a task.
    """
    rows = words.count()
    shards = max(1, -(-4 * rows // (2 * shard)))
    members = words.select("word", "n", F.explode(_halves(F.col("word"))).alias("h")).select("word", "n", "h.*")
    members = written(members.withColumn("cell", F.pmod(F.xxhash64(F.lit("shard"), "key"), F.lit(shards))))
    tasks = block_tasks(members, ["backward", "cell"], "word", 2 * shard)
    links = tasks.groupBy("backward", "cell", "block_a", "block_b").applyInPandas(_shard_links, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return links.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("near_n"), "best.near")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form): the last word that each one's forms lead to. Each round doubles the steps."""
    ways = written(forms.select("word", F.col("form").alias("root")))
    while not ways.join(ways.select(F.col("word").alias("root")), "root", "left_semi").isEmpty():
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("last"))
        ways = written(ways.join(further, "root", "left").select("word", F.coalesce("last", "root").alias("root")))
    return ways


def group_spellings(docs: DataFrame, min_chars: int = 6, min_count: int = 5, times: int = 5, slip: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row for each word of the whole texts of ``docs`` that has ``min_chars`` letters and occurs ``min_count`` times.

    Two words are near if one replaced, missing or added letter makes one the other. form is the near word that occurs most (form_n times; of
    equals the smallest by code points), if that is ``times`` its own n or more, else null; root is what following the forms ends at, the word itself without one. As n grows with
    each step, forms make no circles. Null texts have no words, repeated rows count again, an empty table gives no row; words that long texts
    have without a blank are words like any other, and take a state for each letter. Other columns are ignored.
    """
    words = written(count_words(docs, min_chars, slip).filter(F.col("n") >= min_count))
    near = near_words(words)
    fits = F.col("near_n") >= times * F.col("n")
    judged = written(
        words.join(near, "word", "left")
        .select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n"))
    )
    ways = roots(judged.filter("form is not null"))
    return judged.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
