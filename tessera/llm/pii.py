"""Personal data: fixed base patterns, and a semi-Markov conditional random field that adds spans of other forms."""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tessera.llm.shared import ids_and_texts, with_long_ids

KINDS = ("email", "ip", "card", "phone")
#: Tokens an entity may span, words of context around a trigger, and how much surer than "none" an added span must be.
MAX_TOKENS, CONTEXT_WORDS, MARGIN = 20, 4, 2.0

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]  # start, number of the kind, end


def luhn(digits: str) -> bool:
    """Whether the check digit of a number is right."""
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The base patterns' spans, leftmost without overlap in each kind.

    A match of ``email`` has one @, before which it reaches back as far as its
    characters go but not into the match before, so @ is where to start.
    """
    found: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, 0, domain.end()))
            end = domain.end()
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


# --- the semi-Markov field -------------------------------------------------------------------

#: Words near a span that speak for a kind, or for none.
CUES = {
    "phone": "tel phone telephone call fax mobile cell whatsapp telefon telefono teléfono téléphone handy anruf llamar appeler".split(),
    "card": "card visa mastercard amex credit debit carte karte kreditkarte tarjeta crédito cc".split(),
    "ip": "ip ipv4 host server addr gateway dns ping subnet adresse dirección".split(),
    "email": "email mail contact write correo courriel kontakt mailto".split(),
    "none": "order invoice isbn issn version ref id date page room item sku build serial ticket year posted doi rev section".split(),
}
_CUE = {w: kind for kind, words in CUES.items() for w in words}
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")
_MARK = re.compile(r"[\[({<]\s*(?:at|dot|@|\.)\s*[\])}>]|\bdot\s+(?:com|org|net|edu|gov|io|info|de|fr|es)\b", re.IGNORECASE)
_RUN, _BLANK = re.compile(r"\S+"), re.compile(r"\s")
_AT = frozenset(("at", "@"))
_OCTET_SEPS = frozenset(".[]() ")
_KINDS_OF = [[k for k in range(len(KINDS)) if mask >> k & 1] for mask in range(1 << len(KINDS))]


class Window:
    """Tokens of a stretch of text."""

    def __init__(self, text: str, start: int, end: int):
        self.text, self.tokens = text, [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text, start, end)]
        cue = [_CUE.get(t[2].lower()) for t in self.tokens]
        self.cue = [next((c for c in reversed(cue[max(0, i - 4) : i]) if c), None) for i in range(len(cue))]

    def segments(self) -> Iterator[tuple[int, int, int, list[str]]]:
        """(first token, past the last, mask of possible kinds, features) of whatever could be an entity."""
        tokens, n = self.tokens, len(self.tokens)
        for i in range(n):
            word = tokens[i][2]
            numeric = word[0] in "+(" or word[0].isdigit() and word.isascii()
            if not numeric and not word[0].isalnum():
                continue
            digits = at = 0
            letters = False
            numbers: list[str] = []
            left = None
            seps = ""  # characters between the numbers, distinct and sorted
            for j in range(i + 1, min(n, i + MAX_TOKENS) + 1):
                first, _, last = tokens[j - 1]
                if j > i + 1 and first > tokens[j - 2][1]:
                    if first - tokens[j - 2][1] > 1:
                        break
                    if self.text[first - 1] not in seps:
                        seps = "".join(sorted(seps + self.text[first - 1]))
                if last.isdigit() and last.isascii():
                    digits += len(last)
                    numbers.append(last)
                elif last.isalpha():
                    letters = True
                    at += last.lower() == "at"
                else:
                    at += last == "@"
                    if last not in "+().-/[]{}@_%<>":
                        break
                    if last not in seps:
                        seps = "".join(sorted(seps + last))
                if not last.isalnum():
                    continue
                if letters or at:
                    if at == 1 and last.isalpha() and (kinds := self._email(i, j)):
                        yield i, j, kinds, self._address(i, j, digits)
                elif numeric and last.isdigit() and (j - i >= 2 and 4 <= digits <= 19 or 13 <= digits <= 19):
                    left = self._left(i) if left is None else left
                    yield i, j, 0b1110, left + self._right(j, digits) + self._figure(i, digits, numbers, seps)
                if digits > 19 and not at and numeric and not letters:
                    break  # more digits than any number has, and no address starts with so many

    def _email(self, i: int, j: int) -> int:
        """1 if the segment reads like local part, at, domain, dot and a last label."""
        words = [t[2].lower() for t in self.tokens[i:j]]
        k = next(k for k, w in enumerate(words) if w in _AT)
        if words[-1] in ("at", "dot"):
            return 0
        return int(k > 0 and "." in words[k:] or k > 0 and "dot" in words[k:])

    def _address(self, i: int, j: int, digits: int) -> list[str]:
        tokens = self.tokens
        inner = self.text[tokens[i][0] : tokens[j - 1][1]]
        if "@" not in inner and not re.search(r"(?i)[\[({<\s]at[\])}>\s]", inner):
            numbers = re.findall(r"[0-9]+", inner)
            return self._left(i) + self._right(j, digits) + self._figure(i, digits, numbers, "".join(sorted(set(re.sub(r"[0-9]", "", inner)))))
        marked = re.search(r"[\[({<]\s*(?:at|dot|@|\.)\s*[\])}>]", inner, re.IGNORECASE)
        dots = re.search(r"\.\S|(?i:\bdot\b)", inner)
        return [
            *self._left(i), *self._right(j, digits), "email:at", f"email:tld{min(7, len(tokens[j - 1][2]))}",
            "email:marked" if marked else "email:bare", "email:dots" if dots else "email:nodot",
        ]

    def _figure(self, i: int, digits: int, numbers: list[str], seps: str) -> list[str]:
        shape = "-".join([str(len(g)) for g in numbers[:7]])
        found = [f"shape:{shape}", f"seps:{seps}", f"groups:{min(8, len(numbers))}", f"shape:{shape}|{seps}"]
        if 13 <= digits <= 19:
            found.append(f"luhn:{luhn(''.join(numbers))}")
        if len(numbers) == 4:
            found.append(f"octets:{all([int(g) <= 255 for g in numbers])}|{seps if set(seps) <= _OCTET_SEPS else 'other'}")
        if (opening := self.text[self.tokens[i][0]]) in "+(":
            found.append(f"opens:{opening}")
        return found

    def _left(self, i: int) -> list[str]:
        start = self.tokens[i][0]
        before = self.text[start - 1 : start]
        glued = before and (before.isalnum() or before in "-_./@+=:#$€")
        return ["bias", f"cue:{self.cue[i]}", "glued:left"] if glued else ["bias", f"cue:{self.cue[i]}"]

    def _right(self, j: int, digits: int) -> list[str]:
        text, end = self.text, self.tokens[j - 1][1]
        after, size = text[end : end + 1], f"digits:{min(digits, 20)}"
        glued = after and (after.isalnum() or after in "-_/@=:%" or after == "." and text[end + 1 : end + 2].isalnum())
        return [size, "glued:right"] if glued else [size]


class Field:
    """Weights of each feature for each kind; a token outside any entity scores nothing."""

    def __init__(self, index: dict[str, int], weights: np.ndarray):
        self.weights = {name: tuple(weights[k].tolist()) for name, k in index.items()}

    def scored(self, window: Window) -> Iterator[tuple[int, int, int, float]]:
        weights = self.weights
        for i, j, mask, names in window.segments():
            sums = list(map(sum, zip(*[weights[f] for f in names if f in weights])))
            for k in _KINDS_OF[mask]:
                yield i, j, k, sums[k]

    def best(self, window: Window, margin: float = MARGIN) -> list[Span]:
        """Entities of the highest-scoring segmentation, boundaries and kinds together."""
        n = len(window.tokens)
        ending: list[list] = [[] for _ in range(n + 1)]
        for i, j, k, score in self.scored(window):
            if score > margin:
                ending[j].append((i, k, score - margin))
        total, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            total[j] = total[j - 1]
            for i, k, score in ending[j]:
                if total[i] + score > total[j]:
                    total[j], back[j] = total[i] + score, (i, k)
        spans, j = [], n
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                i, k = back[j]
                spans.append((window.tokens[i][0], k, window.tokens[j - 1][1]))
                j = i
        return spans


def _example(rng: random.Random) -> tuple[str, list[Span]]:
    """A made-up sentence with or without an entity, or with a number that is none."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(("the", "an", "ed", "ing", "ion", "st", "re", "on", "te", "la", "en", "che", "os", "ver")) for _ in range(rng.randint(1, 3)))
    kind = rng.choice((*KINDS, *KINDS, "none", "none", "none", "none", "none"))
    if kind == "email":
        at, dot = rng.choice(((" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" at ", " dot "), (" (at) ", "."), ("@", ".")))
        value = word() + rng.choice(("", "." + digits(2), digits(2))) + at + word() + dot + rng.choice(("com", "org", "net", "de", "fr"))
    elif kind == "ip":
        dot = rng.choice(("[.]", "(.)", "[.]", "."))
        value = dot.join(str(rng.randint(0, 255)) for _ in range(4))
    elif kind == "card":
        body = rng.choice("3456") + digits(14)
        number = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        sep = rng.choice((".", "/", "", " ", "-"))
        value = sep.join(number[k : k + 4] for k in range(0, 16, 4))
    elif kind == "phone":
        a, b, c = digits(3), digits(3), digits(4)
        value = rng.choice((f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"+{a[0]} {b} {c}", f"({a}) {b} {c}", f"+{a[0]}/{a}/{b}-{c}"))
    else:
        value = rng.choice((
            f"20{digits(2)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"{rng.randint(1, 28)}/{rng.randint(1, 12)}/20{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(2)}",
            f"{digits(2)}:{digits(2)}", digits(rng.randint(4, 16)), f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", f"{digits(2)}.{digits(2)}", f"{digits(3)} {digits(3)}",
            f"{digits(3)} {digits(3)} {digits(3)}", f"{digits(4)}-{digits(4)}", f"{digits(1)}.{digits(1)}.{digits(2)}.{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(3)}", f"{digits(5)}-{digits(4)}",
            f"{rng.randint(300, 999)}.{rng.randint(1, 255)}.{digits(3)}.{rng.randint(256, 999)}", f"{word()} at {word()}", f"{digits(4)} {digits(4)} {digits(4)} {digits(3)}",
        ))
    cue = rng.choice(CUES[kind]) + rng.choice((" ", ": ", " ")) if rng.random() < (0.5 if kind != "none" else 0.4) else ""
    left = " ".join(word() for _ in range(rng.randint(0, 3)))
    head = f"{left} {cue}" if left else cue
    tail = rng.choice((" ", ", ", ". ")) + " ".join(word() for _ in range(rng.randint(0, 3)))
    spans = [] if kind == "none" else [(len(head), KINDS.index(kind), len(head) + len(value))]
    return head + value + tail, spans


@lru_cache(maxsize=2)
def trained(examples: int = 1_200, rounds: int = 12, seed: int = 7, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """Fitted here by conditional log-likelihood on made-up sentences; the same seed gives the same weights."""
    rng = random.Random(seed)
    data, index = [], {}
    for _ in range(examples):
        text, spans = _example(rng)
        window = Window(text, 0, len(text))
        segments = list(window.segments())
        for s in segments:
            for f in s[3]:
                index.setdefault(f, len(index))
        gold = {(a, b, k) for a, k, b in spans}
        data.append((window, segments, gold))
    weights = np.zeros((len(index), len(KINDS)))
    squares = np.full_like(weights, 1e-6)
    for _ in range(rounds):
        gradient = np.zeros_like(weights)
        for window, segments, gold in data:
            _add_gradient(gradient, weights, index, window, segments, gold)
        gradient = gradient / len(data) - decay * weights
        squares += gradient**2
        weights += rate * gradient / np.sqrt(squares) * 1.0
    return Field(index, weights)


def _add_gradient(gradient, weights, index, window, segments, gold) -> None:
    """Observed less expected features, by forward and backward sums over all segmentations."""
    n = len(window.tokens)
    items = []
    for i, j, mask, names in segments:
        known = [index[f] for f in names]
        scores = weights[known].sum(axis=0)
        items += [(i, j, k, scores[k], known) for k in range(len(KINDS)) if mask >> k & 1]
    starting, ending = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
    for x in items:
        starting[x[0]].append(x)
        ending[x[1]].append(x)
    forward, backward = np.zeros(n + 1), np.zeros(n + 1)
    for j in range(1, n + 1):
        forward[j] = np.logaddexp.reduce([forward[j - 1], *(forward[x[0]] + x[3] for x in ending[j])])
    for i in range(n - 1, -1, -1):
        backward[i] = np.logaddexp.reduce([backward[i + 1], *(backward[x[1]] + x[3] for x in starting[i])])
    for i, j, k, score, known in items:
        seen = (window.tokens[i][0], window.tokens[j - 1][1], k) in gold
        expected = np.exp(forward[i] + score + backward[j] - forward[n])
        for f in known:
            gradient[f, k] += seen - expected


def number_runs(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each run without white space that holds a digit or @; every character is looked at a few times at most."""
    end = 0
    for m in re.finditer("[0-9@]", text):
        if m.start() >= end:
            gap = text[end : m.start()]
            start = m.start() if not gap or gap[-1].isspace() else m.start() - len(gap.rsplit(None, 1)[-1])
            blank = _BLANK.search(text, m.end())
            end = blank.start() if blank else len(text)
            yield start, end


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches around whatever could be part of an entity; outside them no segment is possible. In order, without overlap."""
    marks = sorted([*number_runs(text), *(m.span() for m in _MARK.finditer(text))])
    ends = [m.end() for m in _RUN.finditer(text)] if marks else []  # of the runs without white space, each found once
    found: list[list[int]] = []
    for start, end in marks:
        a, b, low = start, end, found[-1][1] if found else 0
        for _ in range(CONTEXT_WORDS):
            if a <= low:
                break
            a = max(max(text.rfind(c, low, max(low, a - 1)) for c in " \n\t") + 1, low)
        later = bisect.bisect_right(ends, b) + CONTEXT_WORDS - 1
        b = ends[later] if later < len(ends) else len(text)
        if found and a <= low:
            found[-1][1] = max(low, b)
        else:
            found.append([a, b])
    return [(a, b) for a, b in found]


def all_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    """Base spans, and those of the field that touch none of them."""
    added = []
    starts, reach = [s[0] for s in base], list(accumulate((s[2] for s in base), max))
    for a, b in windows(text):
        for start, kind, end in field.best(Window(text, a, b)):
            before = bisect.bisect_left(starts, end)  # spans that start before this one ends, and how far they reach
            if not before or reach[before - 1] <= start:
                added.append((start, kind, end))
    return sorted({*base, *added})


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and base_sha256 are of the base patterns alone. ``spans`` are
    base spans and those the semi-Markov field adds (other spellings of the
    same kinds) where they touch no base span, as kind:start:end in code
    points, end exclusive, by start, then kind, comma-joined. The field
    scores whole segments of at most ``MAX_TOKENS`` tokens near digits, @ and
    spelled-out signs, and picks boundaries and kinds by dynamic
    programming. Null and empty texts hold nothing ("" and its SHA-256).
    Rows may repeat; an empty table gives no row; other columns are ignored.
    """
    field = docs.sparkSession.sparkContext.broadcast(trained())

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            base = [base_spans(t) for t in texts]
            out = {"doc_id": batch["doc_id"]}
            for k, kind in enumerate(KINDS):
                out[f"n_{kind}"] = [sum(s[1] == k for s in spans) for spans in base]
            out["base_sha256"] = [hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base]
            out["spans"] = [joined(all_spans(t, spans, field.value)) for t, spans in zip(texts, base)]
            yield pd.DataFrame(out)

    return with_long_ids(ids_and_texts(docs).mapInPandas(found, "doc_id string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"))
