"""License mentions of texts, by ordered signature rules.

A rule is a regular expression over a text's words joined by blanks, with a priority, a confidence and the
keywords without which it cannot match. Hand-written names of licenses and hand-written cues (a tag, a grant, a
heading, an address, ...) make up the rules, one for every license and cue; notices that quote a license have rules of their own.

Keywords are looked for first, all in one pass over the text; only rules whose keywords are all there are tried. A
detection that lies within another of equal or higher priority is suppressed by it: ``gpl`` in ``gpl 3``, or a
name within ``not licensed under ...``, which has no label of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialnum.llm.shared import arrow_schema

LICENSE = "licen[sc]e"


def _version(*numbers: str) -> str:
    """A version as it may follow a name: license version 2 0, v2, 2."""
    point = "|".join(n.replace(".", " ") for n in numbers)
    return rf"(?: {LICENSE})?(?: version| ver| v)? ?v?(?:{point})(?: 0)?"


GPL = "(?:gnu )?(?:gpl|general public licen[sc]e)"
LGPL = "(?:gnu )?(?:lgpl|(?:lesser|library)(?: general)? public licen[sc]e|lesser gpl)"
AGPL = "(?:gnu )?(?:agpl|affero (?:gpl|general public licen[sc]e))"
CC = "(?:cc|creative commons)"
BY, NC, ND, SA = "(?:by|attribution)", "(?:nc|non ?commercial)", "(?:nd|no ?deriv(?:ative)?s?(?: works)?)", "(?:sa|share ?alike)"
CC_VERSION = r"(?: (?:[1-4] [05]|international|unported|[1-4] 0 (?:international|unported|igo)))?"

# label, name, keywords of which one must occur, whether the name alone is a mention
LICENSES = [
    ("mit", "mit(?: x11| expat)?", ("mit",), False),
    ("mit-0", "mit (?:0|no attribution)", ("mit",), False),
    ("x11", "x11", ("x11",), False),
    ("isc", "isc", ("isc",), False),
    ("apache", "apache(?: software)?", ("apache",), False),
    ("apache-1", "apache(?: software)?" + _version("1 0", "1 1", "1"), ("apache",), True),
    ("apache-2", "(?:apache(?: software)?|asl|al)" + _version("2"), ("apache", "asl", "al 2"), False),
    ("bsd", "(?:(?:modified|simplified|revised|original|new) )?bsd", ("bsd",), False),
    ("bsd-0-clause", "(?:0bsd|bsd zero clause|zero clause bsd|bsd 0 clause)", ("0bsd", "bsd"), True),
    ("bsd-2-clause", "(?:bsd 2 clause|(?:2|two) clause bsd|simplified bsd|freebsd)", ("bsd",), True),
    ("bsd-3-clause", "(?:bsd 3 clause|(?:3|three) clause bsd|(?:new|modified|revised) bsd)", ("bsd",), True),
    ("bsd-4-clause", "(?:bsd 4 clause|(?:4|four) clause bsd|original bsd)", ("bsd",), True),
    ("gpl", GPL, ("gpl", "general public"), True),
    ("gpl-1", GPL + _version("1"), ("gpl", "general public"), True),
    ("gpl-2", GPL + _version("2"), ("gpl", "general public"), True),
    ("gpl-3", GPL + _version("3"), ("gpl", "general public"), True),
    ("lgpl", LGPL, ("lgpl", "lesser", "library"), True),
    ("lgpl-2", LGPL + _version("2 1", "2"), ("lgpl", "lesser", "library"), True),
    ("lgpl-3", LGPL + _version("3"), ("lgpl", "lesser", "library"), True),
    ("agpl", AGPL, ("agpl", "affero"), True),
    ("agpl-3", AGPL + _version("3"), ("agpl", "affero"), True),
    ("gfdl", "(?:gnu )?(?:gfdl|fdl|free documentation licen[sc]e)", ("fdl", "free documentation"), True),
    ("cc-by", f"{CC} {BY}{CC_VERSION}", ("cc by", "cc attribution", "creative commons"), True),
    ("cc-by-sa", f"{CC} {BY} {SA}{CC_VERSION}", ("cc by", "cc attribution", "creative commons"), True),
    ("cc-by-nd", f"{CC} {BY} {ND}{CC_VERSION}", ("cc by", "cc attribution", "creative commons"), True),
    ("cc-by-nc", f"{CC} {BY} {NC}{CC_VERSION}", ("cc by", "cc attribution", "creative commons"), True),
    ("cc-by-nc-sa", f"{CC} {BY} {NC} {SA}{CC_VERSION}", ("cc by", "cc attribution", "creative commons"), True),
    ("cc-by-nc-nd", f"{CC} {BY} {NC} {ND}{CC_VERSION}", ("cc by", "cc attribution", "creative commons"), True),
    ("cc0", f"(?:cc0|{CC} zero)(?: 1 0)?(?: universal)?", ("cc0", "zero"), True),
    ("cc-pdm", f"{CC} public domain mark", ("public domain mark",), True),
    ("unlicense", "unlicense", ("unlicense",), True),
    ("wtfpl", "(?:wtfpl|do what the fuck you want to public licen[sc]e)", ("wtfpl", "do what the"), True),
    ("mpl", "(?:mpl|mozilla public licen[sc]e)", ("mpl", "mozilla"), False),
    ("mpl-1", "(?:mpl|mozilla public licen[sc]e)" + _version("1 1", "1"), ("mpl", "mozilla"), True),
    ("mpl-2", "(?:mpl|mozilla public licen[sc]e)" + _version("2"), ("mpl", "mozilla"), True),
    ("epl", "(?:epl|eclipse public licen[sc]e)", ("epl", "eclipse"), False),
    ("epl-1", "(?:epl|eclipse public licen[sc]e)" + _version("1"), ("epl", "eclipse"), True),
    ("epl-2", "(?:epl|eclipse public licen[sc]e)" + _version("2"), ("epl", "eclipse"), True),
    ("edl", "(?:eclipse distribution licen[sc]e)", ("eclipse",), True),
    ("cddl", "(?:cddl|common development and distribution licen[sc]e)", ("cddl", "common development"), True),
    ("cpl", "common public licen[sc]e", ("common public",), True),
    ("eupl", "(?:eupl|european union public licen[sc]e)", ("eupl", "european union"), True),
    ("cecill", "cecill(?: [abc])?", ("cecill",), True),
    ("artistic-1", "artistic" + _version("1"), ("artistic",), True),
    ("artistic-2", "artistic" + _version("2"), ("artistic",), True),
    ("boost-1", "(?:bsl|boost(?: software)?)" + _version("1"), ("bsl", "boost"), True),
    ("psf-2", "(?:psf|python software foundation)(?: licen[sc]e)?(?: 2 0)?", ("psf", "python software"), False),
    ("zlib", "zlib(?: libpng)?", ("zlib",), False),
    ("libpng", "libpng", ("libpng",), False),
    ("openssl", "openssl", ("openssl",), False),
    ("postgresql", "postgresql", ("postgresql",), False),
    ("ncsa", "(?:ncsa|university of illinois(?: ncsa)?(?: open source)?)", ("ncsa", "illinois"), False),
    ("php-3", "php" + _version("3 01", "3"), ("php",), False),
    ("ruby", "ruby", ("ruby",), False),
    ("vim", "vim", ("vim",), False),
    ("curl", "curl", ("curl",), False),
    ("ofl-1", "(?:sil )?(?:ofl|open font licen[sc]e)(?: (?:version )?1 [01])?", ("ofl", "open font"), False),
    ("afl-3", "(?:afl|academic free licen[sc]e)" + _version("3"), ("afl", "academic free"), True),
    ("osl-3", "(?:osl|open software licen[sc]e)" + _version("3"), ("osl", "open software"), True),
    ("ecl-2", "(?:ecl|educational community licen[sc]e)" + _version("2"), ("ecl", "educational community"), True),
    ("ms-pl", "(?:ms pl|microsoft public licen[sc]e)", ("ms pl", "microsoft public"), True),
    ("ms-rl", "(?:ms rl|microsoft reciprocal licen[sc]e)", ("ms rl", "microsoft reciprocal"), True),
    ("w3c", "w3c(?: software)?(?: notice)?(?: and)?", ("w3c",), False),
    ("json", "json", ("json",), False),
    ("beerware", "beer ?ware", ("beer",), False),
    ("upl-1", "(?:upl|universal permissive licen[sc]e)" + _version("1"), ("upl", "universal permissive"), True),
    ("zpl-2", "(?:zpl|zope public licen[sc]e)" + _version("2 1", "2"), ("zpl", "zope"), True),
    ("mulan-2", "(?:mulan permissive(?: software)? licen[sc]e|mulanpsl)" + _version("2"), ("mulan",), True),
    ("odbl-1", "(?:odbl|open database licen[sc]e)(?: v?1 0)?", ("odbl", "open database"), True),
    ("odc-by-1", "(?:odc by|open data commons attribution(?: licen[sc]e)?)(?: v?1 0)?", ("odc by", "open data commons"), True),
    ("pddl-1", "(?:pddl|public domain dedication and licen[sc]e)(?: v?1 0)?", ("pddl", "public domain dedication"), True),
    ("ogl-3", "(?:ogl|open government licen[sc]e)" + _version("3"), ("ogl", "open government"), True),
    ("bsl-1.1", "(?:busl|business source licen[sc]e)(?: 1 1)?", ("busl", "business source"), True),
    ("sspl-1", "(?:sspl|server side public licen[sc]e)", ("sspl", "server side public"), True),
    ("elastic-2", "elastic" + _version("2"), ("elastic",), True),
    ("openrail", "(?:creativeml |bigscience )?open ?rail(?: ?\\+?\\+? ?m)?", ("openrail", "open rail"), True),
    ("commons-clause", "commons clause", ("commons clause",), True),
]

# Verbs and things of grants.
GRANTED = "(?:licen[sc]ed|released|distributed|available|provided|published|shared|offered|covered|governed|redistributed|issued|usable)"
TERMS = "(?:(?:the )?(?:terms(?: and conditions)?|conditions) of )?(?:the |an? )?"
# cue, expression around a name, priority, confidence, keywords of which one must occur
CUES = [
    ("tag", "spdx licen[sc]e identifier {name}(?: (?:only|or later))?", 90, 1.0, ("spdx",)),
    ("grant", f"{GRANTED} (?:under|by|with|through|via) {TERMS}{{name}}(?: {LICENSE})?", 80, 0.95, ("under", "by", "with", "through", "via")),
    ("terms", f"(?:under|see|accept|to) (?:the )?(?:terms(?: and conditions)?|conditions) of {TERMS}{{name}}", 75, 0.9, ("terms", "conditions")),
    ("field", f"{LICENSE}(?: type| name| id| expression)?(?: is)? {{name}}", 70, 0.9, ("licen",)),
    ("title", f"(?:the )?{{name}} {LICENSE}", 60, 0.8, ("licen",)),
    ("dual", f"dual licen[sc]ed(?: under)? (?:\\S+ ){{{{0,5}}}}?(?:or|and) {TERMS}{{name}}", 65, 0.9, ("dual",)),
    ("name", "{name}", 40, 0.6, ()),
]
# addresses and notices: label, expression, priority, confidence, keywords
NOTICES = [
    ("mit", "opensource org licenses mit", 85, 0.95, ("opensource",)),
    ("bsd-3-clause", "opensource org licenses bsd 3 clause", 85, 0.95, ("opensource",)),
    ("bsd-2-clause", "opensource org licenses bsd 2 clause", 85, 0.95, ("opensource",)),
    ("apache-2", "apache org licenses license 2 0", 85, 0.95, ("apache",)),
    ("gpl-3", "gnu org licenses (?:old licenses )?gpl 3 0", 85, 0.95, ("gnu",)),
    ("gpl-2", "gnu org licenses (?:old licenses )?gpl 2 0", 85, 0.95, ("gnu",)),
    ("gpl", "gnu org (?:licenses|copyleft) gpl", 84, 0.9, ("gnu",)),
    ("lgpl-3", "gnu org licenses (?:old licenses )?lgpl 3 0", 85, 0.95, ("gnu",)),
    ("agpl-3", "gnu org licenses agpl 3 0", 85, 0.95, ("gnu",)),
    ("mpl-2", "mozilla org (?:en us )?mpl 2 0", 85, 0.95, ("mozilla",)),
    ("cc-by", "creativecommons org licenses by(?: [1-4] [05])?", 85, 0.95, ("creativecommons",)),
    ("cc-by-sa", "creativecommons org licenses by sa(?: [1-4] [05])?", 85, 0.95, ("creativecommons",)),
    ("cc-by-nd", "creativecommons org licenses by nd(?: [1-4] [05])?", 85, 0.95, ("creativecommons",)),
    ("cc-by-nc", "creativecommons org licenses by nc(?: [1-4] [05])?", 85, 0.95, ("creativecommons",)),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa(?: [1-4] [05])?", 85, 0.95, ("creativecommons",)),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd(?: [1-4] [05])?", 85, 0.95, ("creativecommons",)),
    ("cc0", "creativecommons org publicdomain zero 1 0", 85, 0.95, ("creativecommons",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", 88, 0.9, ("hereby granted",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 88, 0.9, ("hereby granted",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 87, 0.8, ("redistribution and use",)),
    ("bsd-3-clause", "neither the name of .{1,80}? may be used to endorse or promote products derived", 88, 0.9, ("neither the name",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", 88, 0.9, ("held liable",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", 88, 0.95, ("unencumbered",)),
    ("public-domain", "(?:released into|dedicated to|placed in|in) the public domain", 50, 0.7, ("public domain",)),
    ("all-rights-reserved", "all rights reserved", 50, 0.5, ("rights reserved",)),
    ("", f"(?:not|never|no longer) (?:be )?{GRANTED} (?:under|by|with) (?:\\S+ ){{1,7}}?{LICENSE}(?: version)?(?: v?[0-9]+(?: [0-9]+)?)?", 95, 0.0, ("not", "never", "no longer")),
]
BASE_PRIORITY = 1000
FOUND = (
    "id {id}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "detections array<struct<label: string, rule: string, start: long, length: long>>"
)


@dataclass(frozen=True)
class Rule:
    name: str
    label: str  # none: it only suppresses
    pattern: str
    priority: int
    confidence: float
    keywords: tuple[tuple[str, ...], ...]  # one of each must occur in the text
    base: bool = False


def rules(base: dict[str, str]) -> list[Rule]:
    """All rules, in order: phrases of ``base`` (phrase -> label), then notices, then every cue with every license."""
    found = [Rule(f"base:{p}", label, re.escape(p), BASE_PRIORITY, 1.0, ((p,),), True) for p, label in base.items()]
    found += [Rule(f"notice:{k}", label, p, rank, sure, (keys,)) for k, (label, p, rank, sure, keys) in enumerate(NOTICES)]
    for cue, around, rank, sure, cue_keys in CUES:
        for label, name, keys, alone in LICENSES:
            if alone or cue != "name":
                gates = (keys, cue_keys) if cue_keys else (keys,)
                found.append(Rule(f"{cue}:{label}", label, around.format(name=f"(?:{name})"), rank, sure, gates))
    return found


class Scanner:
    """The rules with their expressions and the automaton of their keywords."""

    def __init__(self, ordered: list[Rule]) -> None:
        self.rules = ordered
        # whole words only; a base phrase may overlap itself, so only its place is consumed
        self.expressions = [re.compile(f"(?= {r.pattern} )" if r.base else f" (?:{r.pattern})(?= )") for r in ordered]
        self.lengths = [len(r.name) - len("base:") + 1 for r in ordered]
        self.keywords = ahocorasick.Automaton()
        for rule in ordered:
            for keys in rule.keywords:
                for key in keys:
                    self.keywords.add_word(key, key)
        self.keywords.make_automaton()

    def detections(self, padded: str) -> list[tuple[int, int, int]]:
        """(start, end, rule) in a text whose words stand between blanks; those not suppressed, in order."""
        present = {key for _, key in self.keywords.iter(padded)}
        spans = []
        for k, rule in enumerate(self.rules):
            if all(any(key in present for key in keys) for keys in rule.keywords):
                for m in self.expressions[k].finditer(padded):
                    spans.append((m.start(), m.start() + self.lengths[k] if rule.base else m.end(), k))
        # whatever contains a span stands before it in this order
        spans.sort(key=lambda s: (s[0], -s[1], -self.rules[s[2]].priority, s[2]))
        reach: dict[int, int] = {}
        kept = []
        for start, end, k in spans:
            rank = self.rules[k].priority
            covered = any(end <= to for other, to in reach.items() if other >= rank)
            if self.rules[k].base or not covered:
                kept.append((start, end, k))
            reach[rank] = max(reach.get(rank, -1), end)
        return kept

    def scan(self, text: str | None) -> dict:
        words = normal_words(text)
        padded = f" {' '.join(words)} "
        found, at, seen = [], 0, 0
        for start, end, k in self.detections(padded):
            seen, at = seen + padded.count(" ", at, start), start
            rule = self.rules[k]
            found.append({"label": rule.label, "rule": rule.name, "start": seen, "length": padded.count(" ", start + 1, end) + 1})
        base = [f for f in found if f["rule"].startswith("base:")]
        labelled = [f for f in found if f["label"]]
        sure = {r.name: r.confidence for r in self.rules}
        return {
            "n_words": len(words), "n_base": len(base),
            "first_word": min((f["start"] for f in base), default=None), "last_word": max((f["start"] for f in base), default=None),
            "base_labels": ",".join(sorted({f["label"] for f in base})), "labels": ",".join(sorted({f["label"] for f in labelled})),
            "score": max((sure[f["rule"]] for f in labelled), default=0.0), "detections": labelled,
        }


# What parts words, and A-Z to a-z; bytes beyond ASCII belong to words.
_PARTS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def normal_words(text: str | None) -> list[str]:
    """Lower-cased (A-Z) words of ASCII letters, digits and all characters beyond ASCII; null has none."""
    plain = (text or "").encode("utf-8", "surrogatepass").translate(_PARTS)
    return [w.decode("utf-8", "surrogatepass") for w in plain.split(b" ") if w]


def scan_licenses(docs: DataFrame, base: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, places of base phrases, labels, score and all detections.

    ``base`` maps phrases (words joined by blanks) to labels; they have the highest priority and are never
    suppressed, ``n_base`` counts all their places, also overlapping ones, and ``first_word`` and ``last_word`` are the smallest
    and largest start in words from 0. ``labels`` are those of all detections left, sorted and joined by commas, ``score`` the
    highest confidence among them (0 if none). Null and empty text have no words and no label. Every document
    is scanned whole and by itself: no shuffle, repeated ids give repeated rows, an empty table gives none.
    """
    schema = FOUND.format(id=docs.schema[id_col].dataType.simpleString())
    ordered, arrow = rules(base), arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(ordered)
        for batch in batches:
            found = [{"id": i.as_py(), **scanner.scan(t.as_py())} for i, t in zip(batch["id"], batch["text"])]
            yield pa.RecordBatch.from_pylist(found, arrow)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
