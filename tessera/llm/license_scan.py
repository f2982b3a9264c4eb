"""License scan: base phrases, and ordered signature rules gated by keywords."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tessera.llm.shared import LOWER, Words, chunks, encoded, ids_and_texts, with_long_ids

#: Base phrases, as consecutive words, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
_BREAK, _LETTER = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]", rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
_WORD = re.compile(_LETTER + b"+")


def phrase_pattern(phrase: str) -> re.Pattern:
    """The phrase's words, consecutive and whole, over lower-case bytes."""
    words = (_BREAK + b"+").join(phrase.encode().split())
    return re.compile(b"(?<!" + _LETTER + b")" + words + b"(?!" + _LETTER + b")")


_BASE = [(phrase_pattern(phrase), phrase.split()[0].encode(), label) for phrase, label in BASE]

#: Label, keyword, pattern of the name, SPDX tag and URL; all over lower-case words with one space between.
LICENSES = """
mit | mit | (?:the )?mit(?: x11| expat)? licen[cs]e | mit | opensource org licenses mit
mit-0 | mit | mit no attribution(?: licen[cs]e)? | mit 0 | opensource org licenses mit 0
apache-1.1 | apache | apache (?:software )?licen[cs]e(?: version| v)? 1 1 | apache 1 1 | apache org licenses license 1 1
apache-2 | apache | apache (?:software )?licen[cs]e(?: version| v)? v?2(?: 0)? | apache 2 0 | apache org licenses license 2 0
bsd-2-clause | bsd | (?:simplified|freebsd|2 clause|two clause) bsd(?: licen[cs]e)? | bsd 2 clause | opensource org licenses bsd 2 clause
bsd-3-clause | bsd | (?:new|modified|revised|3 clause|three clause) bsd(?: licen[cs]e)? | bsd 3 clause | opensource org licenses bsd 3 clause
bsd-4-clause | bsd | (?:original|4 clause|four clause) bsd(?: licen[cs]e)? | bsd 4 clause | spdx org licenses bsd 4 clause
bsd | bsd | bsd(?: style)? licen[cs]e | bsd | opensource org licenses bsd license
0bsd | bsd | (?:zero clause bsd|0bsd|bsd zero clause)(?: licen[cs]e)? | 0bsd | opensource org licenses 0bsd
isc | isc | isc licen[cs]e | isc | opensource org licenses isc
gpl-1 | gpl|general public | (?:gnu )?(?:gpl|general public licen[cs]e)(?: version| v)? v?1(?: 0)? | gpl 1 0(?: only| or later)? | gnu org licenses (?:old licenses )?gpl 1 0
gpl-2 | gpl|general public | (?:gnu )?(?:gpl|general public licen[cs]e)(?: version| v)? v?2(?: 0)? | gpl 2 0(?: only| or later)? | gnu org licenses (?:old licenses )?gpl 2 0
gpl-3 | gpl|general public | (?:gnu )?(?:gpl|general public licen[cs]e)(?: version| v)? v?3(?: 0)? | gpl 3 0(?: only| or later)? | gnu org licenses gpl 3 0
gpl | gpl|general public | gnu (?:gpl|general public licen[cs]e) | gpl | gnu org licenses gpl html
lgpl-2 | lgpl|library general|lesser general | (?:gnu )?(?:lgpl|library general public licen[cs]e)(?: version| v)? v?2(?: 0)? | lgpl 2 0(?: only| or later)? | gnu org licenses old licenses lgpl 2 0
lgpl-2.1 | lgpl|lesser general | (?:gnu )?(?:lgpl|lesser general public licen[cs]e)(?: version| v)? v?2 1 | lgpl 2 1(?: only| or later)? | gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3 | lgpl|lesser general | (?:gnu )?(?:lgpl|lesser general public licen[cs]e)(?: version| v)? v?3(?: 0)? | lgpl 3 0(?: only| or later)? | gnu org licenses lgpl 3 0
lgpl | lesser general|library general|lgpl | gnu (?:lgpl|lesser general public licen[cs]e|library general public licen[cs]e) | lgpl | gnu org licenses lgpl html
agpl-3 | agpl|affero | (?:gnu )?(?:agpl|affero general public licen[cs]e)(?:(?: version| v)? v?3(?: 0)?)? | agpl 3 0(?: only| or later)? | gnu org licenses agpl 3 0
gfdl | gfdl|free documentation | (?:gnu )?(?:gfdl|free documentation licen[cs]e) | gfdl 1 [123](?: only| or later)? | gnu org licenses fdl 1 [123]
mpl-1.1 | mozilla|mpl | (?:mozilla public licen[cs]e|mpl)(?: version| v)? v?1 1 | mpl 1 1 | mozilla org mpl 1 1
mpl-2 | mozilla|mpl | (?:mozilla public licen[cs]e|mpl)(?: version| v)? v?2(?: 0)? | mpl 2 0 | mozilla org mpl 2 0
mpl | mozilla | mozilla public licen[cs]e | mpl | mozilla org mpl
epl-1 | eclipse|epl | (?:eclipse public licen[cs]e|epl)(?: version| v)? v?1(?: 0)? | epl 1 0 | eclipse org legal epl v10
epl-2 | eclipse|epl | (?:eclipse public licen[cs]e|epl)(?: version| v)? v?2(?: 0)? | epl 2 0 | eclipse org legal epl 2 0
edl | eclipse | eclipse distribution licen[cs]e(?: v)?(?: 1 0)? | edl 1 0 | eclipse org licenses edl
cddl-1 | cddl|common development | (?:cddl|common development and distribution licen[cs]e)(?:(?: version| v)? 1 [01])? | cddl 1 [01] | opensource org licenses cddl
cpl | common public | common public licen[cs]e(?: version)?(?: 1 0)? | cpl 1 0 | opensource org licenses cpl1 0
ipl | ibm public | ibm public licen[cs]e | ipl 1 0 | opensource org licenses ipl
eupl | eupl|european union | (?:eupl|european union public licen[cs]e)(?:(?: version| v)? 1 [012])? | eupl 1 [012] | joinup ec europa eu collection eupl
cecill | cecill | cecill(?: [abc])?(?: licen[cs]e)? | cecill(?: [abc]| \\d \\d)? | cecill info licences
artistic-1 | artistic | artistic licen[cs]e(?: version)? 1 0 | artistic 1 0 | opensource org licenses artistic license 1 0
artistic-2 | artistic | artistic licen[cs]e(?: version)? 2(?: 0)? | artistic 2 0 | opensource org licenses artistic license 2 0
artistic | artistic | artistic licen[cs]e | artistic | opensource org licenses artistic license
boost | boost|bsl | boost software licen[cs]e(?: version)?(?: 1 0)? | bsl 1 0 | boost org license 1 0
zlib | zlib | zlib(?: libpng)? licen[cs]e | zlib | opensource org licenses zlib
libpng | libpng | libpng licen[cs]e | libpng 2 0 | libpng org pub png src libpng license
openssl | openssl | openssl licen[cs]e | openssl | openssl org source license
php | php | php licen[cs]e(?: version)?(?: 3 0[01]?)? | php 3 0[01]? | php net license
python | python|psf | (?:python software foundation|psf) licen[cs]e(?: version)?(?: 2)? | (?:psf|python) 2 0 | docs python org license
ruby | ruby | ruby licen[cs]e | ruby | ruby lang org en about license
unicode | unicode | unicode licen[cs]e agreement | unicode (?:dfs 201[56]|3 0|tou) | unicode org copyright
postgresql | postgresql | postgresql licen[cs]e | postgresql | opensource org licenses postgresql
ncsa | ncsa | (?:university of illinois )?ncsa(?: open source)? licen[cs]e | ncsa | opensource org licenses ncsa
wtfpl | wtfpl|what the | (?:wtfpl|do what the f\\w+ you want to public licen[cs]e) | wtfpl | wtfpl net
unlicense | unlicense | (?:the )?unlicense | unlicense | unlicense org
beerware | beer | beer ?ware licen[cs]e | beerware | people freebsd org phk
ofl | ofl|open font | (?:sil )?open font licen[cs]e(?:(?: version| v)? 1 [01])? | ofl 1 [01] | scripts sil org ofl
afl | academic free | academic free licen[cs]e(?:(?: version| v)? \\d(?: \\d)?)? | afl \\d \\d | opensource org licenses afl
osl | open software | open software licen[cs]e(?:(?: version| v)? \\d(?: \\d)?)? | osl \\d \\d | opensource org licenses osl
ms-pl | microsoft|ms pl | microsoft public licen[cs]e | ms pl | opensource org licenses ms pl
ms-rl | microsoft|ms rl | microsoft reciprocal licen[cs]e | ms rl | opensource org licenses ms rl
upl | universal permissive | universal permissive licen[cs]e(?:(?: version| v)? 1 0)? | upl 1 0 | oss oracle com licenses upl
mulan | mulan | mulan (?:permissive software licen[cs]e|psl)(?: v2)? | mulanpsl [12] 0 | license coscl org cn mulanpsl2
bsl-1.1 | business source | business source licen[cs]e(?: 1 1)? | busl 1 1 | mariadb com bsl11
sspl | sspl|server side public | (?:sspl|server side public licen[cs]e)(?: v1)? | sspl 1 0 | mongodb com licensing server side public license
elastic-2 | elastic | elastic licen[cs]e(?: v?2(?: 0)?)? | elastic 2 0 | elastic co licensing elastic license
cc0 | cc0|creative commons zero|public domain dedication | (?:cc0(?: 1 0)?(?: universal)?|creative commons zero|public domain dedication) | cc0 1 0 | creativecommons org publicdomain zero
cc-by | cc by|creative | (?:cc by|creative commons attribution)(?: [1234] [05])?(?: international| unported)?(?: licen[cs]e)? | cc by [1234] [05] | creativecommons org licenses by [1234]
cc-by-sa | cc by|share | (?:cc by sa|creative commons attribution share ?alike)(?: [1234] [05])?(?: international| unported)?(?: licen[cs]e)? | cc by sa [1234] [05] | creativecommons org licenses by sa
cc-by-nd | cc by|deriv | (?:cc by nd|creative commons attribution no ?derivs?(?:ative)?s?)(?: [1234] [05])?(?: international| unported)?(?: licen[cs]e)? | cc by nd [1234] [05] | creativecommons org licenses by nd
cc-by-nc | cc by|attribution non | (?:cc by nc|creative commons attribution non ?commercial)(?: [1234] [05])?(?: international| unported)?(?: licen[cs]e)? | cc by nc [1234] [05] | creativecommons org licenses by nc [1234]
cc-by-nc-sa | cc by|share | (?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1234] [05])?(?: international| unported)?(?: licen[cs]e)? | cc by nc sa [1234] [05] | creativecommons org licenses by nc sa
cc-by-nc-nd | cc by|deriv | (?:cc by nc nd|creative commons attribution non ?commercial no ?derivs?(?:ative)?s?)(?: [1234] [05])?(?: international| unported)?(?: licen[cs]e)? | cc by nc nd [1234] [05] | creativecommons org licenses by nc nd
odbl | odbl|open database | (?:odbl|open database licen[cs]e)(?:(?: version| v)? 1 0)? | odbl 1 0 | opendatacommons org licenses odbl
odc-by | open data commons | open data commons attribution(?: licen[cs]e)? | odc by 1 0 | opendatacommons org licenses by
pddl | pddl|public domain dedication | (?:pddl|public domain dedication and licen[cs]e) | pddl 1 0 | opendatacommons org licenses pddl
ogl-uk | open government | open government licen[cs]e(?:(?: version| v)? ?[123](?: 0)?)? | ogl uk [123] 0 | nationalarchives gov uk doc open government licence
etalab | etalab|licence ouverte | (?:licence ouverte|etalab)(?: 2 0)? | etalab 2 0 | etalab gouv fr licence ouverte
gpl-classpath | classpath | (?:gnu )?classpath exception | classpath exception 2 0 | gnu org software classpath license
public-domain | public domain | (?:released|placed|dedicated|is) (?:in(?:to)?|to) the public domain | public domain | creativecommons org publicdomain mark
all-rights-reserved | all rights | all rights reserved | proprietary | wikipedia org wiki all_rights_reserved
"""
#: Sentences that tell a licence by themselves, as label, keyword and pattern.
NOTICES = """
mit | permission is hereby | permission is hereby granted free of charge to any person obtaining a copy of this software
isc | permission to use | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
apache-2 | you may not use | you may not use this file except in compliance with the license
bsd | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
gpl | free software foundation | under the terms of the gnu general public license as published by the free software foundation
lgpl | free software foundation | under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation
agpl-3 | affero | under the terms of the gnu affero general public license as published by the free software foundation
mpl-2 | source code form | this source code form is subject to the terms of the mozilla public license
unlicense | free and unencumbered | this is free and unencumbered software released into the public domain
zlib | as is without | this software is provided as is without any express or implied warranty
boost | person or organization | free of charge to any person or organization obtaining a copy of the software
wtfpl | what the | you just do what the f\\w+ you want to
"""
#: Form of a rule -> (priority, confidence).
FORMS = {"notice": (5, 1.0), "tag": (4, 1.0), "grant": (3, 0.95), "url": (2, 0.9), "field": (2, 0.8), "name": (1, 0.6)}
_GRANT = r"(?:licen[cs]ed|released|distributed|available|provided|published|covered|governed|redistributed|shared|offered)(?: \w+){0,2} (?:under|by|with) (?:the )?(?:terms of )?(?:the )?"
def needed(pattern: str) -> tuple[str, ...]:
    """Pieces of three letters or more that every match of a rule's pattern holds: what stands outside groups, classes and options."""
    while (outer := re.sub(r"\((?:\?:)?[^()]*\)(?:\?|\{[^}]*\})?|\[[^\]]*\]\??", "\0", pattern)) != pattern:
        pattern = outer
    pieces = re.sub(r"\\.[+*?]?|.[?*]|[{}+]", "\0", pattern).split("\0")
    return () if "|" in pattern else tuple(sorted({p for p in pieces if len(p) > 2}, key=len, reverse=True))


@dataclass(frozen=True)
class Rule:
    label: str
    form: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    needs: tuple[str, ...]

    @classmethod
    def of(cls, label: str, form: str, keywords: str, pattern: str) -> Rule:
        return cls(label, form, tuple(keywords.split("|")), re.compile(rf"(?<!\S)(?:{pattern})(?!\S)"), needed(pattern))


def _fields(lines: str, n: int) -> Iterator[list[str]]:
    for line in filter(None, map(str.strip, lines.splitlines())):
        parts = re.split(r" \| ", line)
        assert len(parts) == n, line
        yield [p.strip() for p in parts]


def rules() -> list[Rule]:
    """All rules in order: each licence in five forms, and the notices."""
    found = [Rule.of(label, "notice", word, pattern) for label, word, pattern in _fields(NOTICES, 3)]
    for label, words, name, tag, url in _fields(LICENSES, 5):
        found += [
            Rule.of(label, "tag", "spdx", rf"spdx license identifier {tag}"),
            Rule.of(label, "grant", words, rf"{_GRANT}{name}"),
            Rule.of(label, "url", url.split()[0], rf"(?:https? )?(?:www )?{url}"),
            Rule.of(label, "field", words, rf"licen[cs]e(?:d)?(?: type| name)? {name}"),
            Rule.of(label, "name", words, name),
        ]
    return found


#: All keywords of the rules; words without any of them hold nothing for the rules.
GATE = tuple(sorted({word.encode() for rule in rules() for word in rule.keywords}))


class Scanner:
    """Keyword automaton before the rules; only rules whose keyword and whose needed pieces occur are run."""

    def __init__(self) -> None:
        self.rules = rules()
        by_word: dict[str, list[int]] = {}
        for i, rule in enumerate(self.rules):
            for word in rule.keywords:
                by_word.setdefault(word, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for word in map(bytes.decode, GATE):
            self.automaton.add_word(word, by_word[word])
        self.automaton.make_automaton()

    def detections(self, words: str) -> list[tuple[int, int, Rule]]:
        """(start, end, rule) in characters of ``words``, lower-case words with one space between; overlaps resolved."""
        gated = [i for i in sorted({i for _, which in self.automaton.iter(words) for i in which}) if all(piece in words for piece in self.rules[i].needs)]
        found = [(m.start(), m.end(), i) for i in gated for m in self.rules[i].pattern.finditer(words)]
        return [(a, b, self.rules[i]) for a, b, i in self.resolved(found)]

    def resolved(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Without those that lie inside a better one: of higher priority, or of the same and longer, or as long and of an earlier rule."""
        kept: list[tuple[int, int, int]] = []
        reach: dict[int, list[tuple[int, int]]] = {}  # page of the text -> kept intervals that touch it
        for a, b, i in sorted(found, key=lambda x: (-FORMS[self.rules[x[2]].form][0], x[0] - x[1], x[2])):
            if not any(x <= a and b <= y for x, y in reach.get(a // 256, ())):
                kept.append((a, b, i))
                for page in range(a // 256, b // 256 + 1):
                    reach.setdefault(page, []).append((a, b))
        return sorted(kept)


def scan_text(scanner: Scanner, text: bytes) -> dict | None:
    """What one text holds besides its number of words; None where neither base nor rules can match."""
    lowered = text.translate(LOWER)
    base = {"n_base": 0, "first": None, "last": None, "base": set(), "labels": set(), "score": 0.0, "spans": []}
    starts = None
    for pattern, word, label in _BASE:
        if word not in lowered:
            continue
        for match in pattern.finditer(lowered):
            if starts is None:
                starts = Words([text]).start
            at = int(np.searchsorted(starts, match.start()))
            base["n_base"] += 1
            base["first"] = at if base["first"] is None else min(base["first"], at)
            base["last"] = at if base["last"] is None else max(base["last"], at)
            base["base"].add(label)
    words = b" ".join(_WORD.findall(lowered)).decode("utf-8", "replace")
    detections = scanner.detections(words)
    spaces = np.flatnonzero(np.frombuffer(words.encode("utf-32-le"), np.uint32) == 0x20) if detections else None
    for a, b, rule in detections:
        base["labels"].add(rule.label)
        base["score"] = max(base["score"], FORMS[rule.form][1])
        first, last = np.searchsorted(spaces, (a, b)).tolist()  # words before the detection, and before its last word
        base["spans"].append((first, last + 1, rule.label, rule.form))
    if base["base"]:
        base["score"] = 1.0
    base["labels"] |= base["base"]
    return base


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words are runs of digits, a-z and non-ASCII after A-Z lower-casing. n_base
    counts the places where a base phrase's words are consecutive;
    first_word and last_word are their smallest and largest start, else
    null. ``spans`` are what the rules found, as words (start, end exclusive), label and form: a rule runs only where
    its keyword occurs, and of detections inside one another the better stays, by
    priority of the form, then by length, then by order. labels are base
    and rule labels, distinct, sorted, comma-joined ("" if none); score is
    the confidence of the surest. Null and empty texts have no words and nothing
    else. Rows may repeat; an empty table gives no row; other columns are ignored.
    """

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner()
        for batch in batches:
            texts = encoded(batch["text"])
            n_words = np.concatenate([np.diff(Words(part).first) for _, part in chunks(texts)] or [np.zeros(0, np.int64)])
            found = [scan_text(scanner, t) for t in texts]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "n_words": n_words, "n_base": [x["n_base"] for x in found],
                "first_word": pd.array([x["first"] for x in found], "Int64"), "last_word": pd.array([x["last"] for x in found], "Int64"),
                "base_labels": [",".join(sorted(x["base"])) for x in found], "labels": [",".join(sorted(x["labels"])) for x in found],
                "score": [x["score"] for x in found],
                "spans": [[{"start": a, "end": b, "label": k, "form": f} for a, b, k, f in x["spans"]] for x in found],
            })

    schema = "doc_id string, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:long,end:long,label:string,form:string>>"
    return with_long_ids(ids_and_texts(docs).mapInPandas(scanned, schema))
