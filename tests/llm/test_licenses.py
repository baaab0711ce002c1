import random
import re

import pytest

from trialnum.llm.licenses import Scanner, normal_words, rules, scan_licenses
from trialnum.llm.queries import BASE_PHRASES, QUERIES

SCANNER = Scanner(rules(BASE_PHRASES))


def plain_words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", text)


def base_places(words):
    return sorted(
        (i, label) for phrase, label in BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()
    )


def all_pairs(padded):
    """Every rule is tried on the text, and every detection is compared with every other."""
    spans = []
    for k, (rule, expression) in enumerate(zip(SCANNER.rules, SCANNER.expressions)):
        for m in expression.finditer(padded):
            spans.append((m.start(), m.start() + 1 + len(rule.name[5:]) if rule.base else m.end(), k))
    rank = lambda s: SCANNER.rules[s[2]].priority
    size = lambda s: s[1] - s[0]
    covers = lambda a, b: (
        a != b and a[0] <= b[0] and b[1] <= a[1] and rank(a) >= rank(b) and (size(a), rank(a), -a[2]) > (size(b), rank(b), -b[2])
    )
    return {s for s in spans if SCANNER.rules[s[2]].base or not any(covers(other, s) for other in spans)}


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Released under the MIT License.", "mit"),
        ("Licensed under the Apache License, Version 2.0.", "apache-2"),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
        ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2"),
        ("CC BY-NC-SA 4.0", "cc-by-nc,cc-by-nc-sa"),
        ("CC-BY-SA", "cc-by-sa"),
        ("License: BSD-3-Clause", "bsd-3-clause"),
        ("dual licensed under MIT or Apache-2.0", "apache-2,mit"),
        ("https://www.gnu.org/licenses/lgpl-3.0.html, https://creativecommons.org/licenses/by/4.0/", "cc-by,lgpl-3"),
        ("It is not licensed under the Mozilla Public License 2.0", ""),
        ("This is not licensed under the MIT License", "mit"),  # a base phrase always stays
        ("wir fahren mit dem bus by the elastic band with vim and ruby under json", ""),
        ("Mozilla Public License Version 2.0 and LGPL v2.1, AGPL-3.0", "agpl-3,lgpl-2,mpl-2"),
        (None, ""),
    ],
)
def test_labels(text, labels):
    assert SCANNER.scan(text)["labels"] == labels


def test_there_are_hundreds_of_rules_and_each_name_is_found_by_its_cues():
    assert len(SCANNER.rules) > 300 and len({r.name for r in SCANNER.rules}) == len(SCANNER.rules)
    names = {"mit": "MIT", "gpl-3": "GPL 3", "cc0": "CC0", "epl-2": "EPL-2.0", "zlib": "zlib", "ofl-1": "SIL Open Font License 1.1"}
    for label, name in names.items():
        for text in (f"SPDX-License-Identifier: {name}", f"distributed under the terms of the {name}", f"License: {name}"):
            assert label in SCANNER.scan(text)["labels"].split(","), text


def test_gates_and_suppression_equal_a_plain_scan():
    rng = random.Random(3)
    parts = ["under the mit license", "licensed under", "the", "gpl", "version 3", "apache license version 2 0", "cc by nc", "sa", "nd", "not licensed under the",
             "spdx license identifier", "bsd 3 clause", "new bsd", "license", "gnu general public license", "v3", "or", "dual licensed under", "and", "agpl", "2 0",
             "mozilla public license", "all rights reserved", "terms of the", "lesser general public license", "epl", "1 0"]
    labels = set()
    for _ in range(400):
        padded = f" {' '.join(normal_words(' '.join(rng.choices(parts, k=rng.randint(1, 25)))))} "
        got = SCANNER.detections(padded)
        assert set(got) == all_pairs(padded) and len(got) == len(set(got))
        labels |= {SCANNER.rules[k].label for _, _, k in got}
    assert len(labels) > 15


def test_base_columns_equal_plain_word_lists(spark):
    rng = random.Random(4)
    parts = ["under", "the MIT", "license", "CC-BY", "by", "nc", "\u00e9", "Apache License,", "version", "2", "2.0", "x\u2019y", "\u212a", "  \n", "under the mit license", "cc by nc", "\U0001f600"]
    docs = [(i, "/".join(rng.choices(parts, k=rng.randint(0, 40)))) for i in range(300)]
    docs += [(300, None), (301, ""), (None, "cc by nc"), (302, "cc by nc"), (302, "cc by nc"), (303, "word " * 300_000 + "CC BY NC"), (304, "cc by nc " * 50_000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, labels string, id long")
    got = scan_licenses(df, BASE_PHRASES).collect()
    assert sorted(str(r["id"]) for r in got) == sorted(str(i) for i, _ in docs)
    want = []
    for i, text in docs:
        words = plain_words(text)
        places = base_places(words)
        at = [p for p, _ in places]
        want.append((i, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places}))))
    names = ("id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert sorted(map(str, want)) == sorted(str(tuple(r[n] for n in names)) for r in got)
    for r in got:
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert r["score"] == (1.0 if r["n_base"] else r["score"]) and 0 <= r["score"] <= 1
        assert all(0 <= d["start"] and d["start"] + d["length"] <= r["n_words"] for d in r["detections"])


def test_empty_table_and_query(spark, small):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert scan_licenses(empty, BASE_PHRASES).count() == 0
    got = {r["doc_id"]: r for r in QUERIES["op13_licenses"](spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        places = base_places(plain_words(d["text"]))
        assert got[d["doc_id"]]["n_base"] == len(places) and got[d["doc_id"]]["n_words"] == len(plain_words(d["text"]))
