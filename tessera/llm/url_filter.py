"""URL filter: rules by host and path, and a weighted vocabulary that one automaton looks for."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import LOWER, lower_ascii, unused

# Words that reject a url by themselves, by subject.
STRICT = """
adult: porn porno pornos pornhub xvideos xxx xxxvideos hentai milf camgirl camgirls camsex sexcam sexcams sextape nudes escorts fetish bdsm blowjob
gambling: casino casinos sportsbook sportsbooks bookmaker bookmakers roulette blackjack baccarat 1xbet onlinebetting jackpots
drugs: viagra cialis levitra tramadol xanax phentermine ambien oxycontin buyweed
piracy: warez keygen keygens serialz cracks nulled torrents
fraud: phishing malware botnet carding fullz spamfarm linkfarm cheappills freebets payday paydayloans
"""
# Words that tell something only together with others, by their weight in hundredths.
SOFT = """
70: sex sexy nude naked adult erotic webcam dating bet bets betting poker slots bingo lottery odds pills pharmacy meds steroids drugs weed cannabis replica fake spam hack hacked crack serial torrent loan loans casinobonus bonus seo backlink backlinks escort massage cams clickbait
30: free cheap buy order discount best top online win winner cash money fast instant easy now deal deals sale offer offers click promo coupon bonuses farm download hot live vip secret miracle
"""
#: Points that reject, and what a strict word has.
LIMIT = 100
#: Most rules that one call takes; they are constants that each url is held against.
MAX_RULES = 1_000

_LETTER, _DIGIT, _OTHER = range(3)


def _kind(character: str) -> int:
    return _DIGIT if "0" <= character <= "9" else _LETTER if "a" <= character <= "z" or character >= "\x80" else _OTHER


def vocabulary() -> dict[str, tuple[bool, int]]:
    """term -> (strict, points)."""
    strict = {word: (True, LIMIT) for line in STRICT.split("\n") for word in line.partition(":")[2].split()}
    soft = {word: (False, int(points)) for points, _, words in (line.partition(":") for line in SOFT.split("\n")) for word in words.split()}
    return soft | strict


class Vocabulary:
    """Terms in one Aho-Corasick automaton; a term counts where letters or digits don't go on at its ends."""

    def __init__(self, terms: dict[str, tuple[bool, int]]):
        self.terms, self.automaton = terms, ahocorasick.Automaton()
        for term in terms:
            self.automaton.add_word(term, term)
        if terms:
            self.automaton.make_automaton()

    def hits(self, text: str) -> set[str]:
        """Distinct terms of ``text``, which is lower-cased already; takes time by its length, whatever it holds."""
        found: set[str] = set()
        if not self.terms:
            return found
        for end, term in self.automaton.iter(text):
            start = end - len(term) + 1
            if term not in found and (start == 0 or _kind(text[start - 1]) != _kind(term[0])) and (end + 1 == len(text) or _kind(text[end + 1]) != _kind(term[-1])):
                found.add(term)
        return found


@dataclass(frozen=True)
class Rule:
    """What to do with urls of ``host`` and its subdomains whose path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @classmethod
    def of(cls, text: str, verdict: str) -> Rule:
        """From `example.net/en/`: the path starts at the first slash."""
        host, slash, path = text.partition("/")
        return cls(host, slash + path, verdict)


#: The rules of the registered query.
RULES = (Rule.of("net/", "block"), Rule.of("example.net/en/", "allow"), Rule.of("example.com/de/", "block"), Rule.of("org/fr/", "allow"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Between the first `://` and `/`, `?`, `#` or the end, A-Z lower-cased; and from there to `?`, `#` or the end. Both empty without `://`."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return lower_ascii(part(1)), part(2)


def best_rule(host: Column, path: Column, rules: Iterable[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does; of equal ones blocking comes first."""
    rules = sorted(set(rules), key=lambda r: (-len(r.host + r.path), r.verdict != "block", r.host + r.path, r.verdict))
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules: at most {MAX_RULES}")
    kind = "array<struct<host:string,path:string,verdict:string>>"
    listed = F.array(*[F.struct(F.lit(r.host).alias("host"), F.lit(r.path).alias("path"), F.lit(r.verdict).alias("verdict")) for r in rules]).cast(kind)
    fits = lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"])
    first = F.get(F.filter(listed, fits), F.lit(0))
    return F.when(first.isNotNull(), F.struct(F.concat(first["host"], first["path"]).alias("rule"), first["verdict"].alias("verdict")))


def judge_urls(pages: DataFrame, rules: Iterable[Rule] = RULES, terms: dict[str, tuple[bool, int]] | None = None, limit: int = LIMIT) -> DataFrame:
    """``pages`` (with url) and host, path, rule, verdict, strict, soft, points.

    The longest rule that fits a url's host and path decides. Where none fits
    the vocabulary does: block for one strict term, or for several distinct
    soft ones of at least ``limit`` points together; else allow. strict and
    soft are the distinct terms of the whole url, A-Z lower-cased, sorted and
    comma-joined; points are the sum of theirs, strict ones' included. A
    letter or non-ASCII character next to a term's letter, or a digit next to
    its digit, makes it no hit. A null url and one without `://` have empty
    host and path, a null url no terms. Rows may repeat; an empty table gives
    no row; columns of ``pages`` with a new one's name are replaced by it.
    """
    terms = vocabulary() if terms is None else terms

    @F.pandas_udf("strict array<string>, soft array<string>, points long")
    def looked_up(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known, lower = Vocabulary(terms), str.maketrans({a: b for a, b in enumerate(LOWER) if a != b})
        for batch in batches:
            found = [sorted(known.hits(url.translate(lower))) if isinstance(url, str) else [] for url in batch]
            yield pd.DataFrame({
                "strict": [[t for t in x if terms[t][0]] for x in found], "soft": [[t for t in x if not terms[t][0]] for x in found],
                "points": [sum(terms[t][1] for t in x) for x in found],
            })

    host, path = host_and_path(F.col("url").cast("string"))
    parts = [unused(n, pages.columns) for n in ("_host", "_path", "_rule", "_hits")]
    judged = pages.withColumns({parts[0]: host, parts[1]: path, parts[3]: looked_up(F.col("url").cast("string"))})
    judged = judged.withColumn(parts[2], best_rule(F.col(parts[0]), F.col(parts[1]), rules))
    hits, rule = F.col(parts[3]), F.col(parts[2])
    rejected = (F.size(hits["strict"]) > 0) | ((F.size(hits["soft"]) > 1) & (hits["points"] >= limit))
    return judged.withColumns({
        "host": F.col(parts[0]), "path": F.col(parts[1]), "rule": rule["rule"], "verdict": F.coalesce(rule["verdict"], F.when(rejected, "block").otherwise("allow")),
        "strict": F.array_join(hits["strict"], ","), "soft": F.array_join(hits["soft"], ","), "points": hits["points"],
    }).drop(*parts)


def keep_urls(pages: DataFrame, **how) -> DataFrame:
    """The rows of ``pages`` that ``judge_urls`` allows, with their own columns as they were; a null url is allowed."""
    name = unused("_all", pages.columns)
    judged = judge_urls(pages.select(F.struct("*").alias(name), "url"), **how)
    return judged.filter(F.col("verdict") == "allow").select(f"{name}.*")
