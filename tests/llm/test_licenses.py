"""License rules: each rule is found where its words stand, and whole texts follow a plain search without gates."""

import random
import re
from re import _parser as parser

import pytest

from curatum.llm import licenses
from curatum.llm.queries import QUERIES

RULES = licenses.rules()
SCHEMA = "doc_id long, text string, n_words string, licenses string, words int"


def sample(tree, rng):
    """A string that the parsed pattern matches."""
    out = ""
    for kind, value in tree:
        kind = str(kind)
        if kind == "LITERAL":
            out += chr(value)
        elif kind == "NOT_LITERAL":
            out += "q"
        elif kind == "IN":
            out += rng.choice([chr(c) for k, v in value for c in ([v] if str(k) == "LITERAL" else range(v[0], v[1] + 1) if str(k) == "RANGE" else [ord("q")])])
        elif kind == "BRANCH":
            out += sample(rng.choice(value[1]), rng)
        elif kind == "SUBPATTERN":
            out += sample(value[3], rng)
        else:
            low, high, inner = value
            out += "".join(sample(inner, rng) for _ in range(rng.randint(low, min(high, low + 3))))
    return out


def brute(text):
    """(start, end, level, rule) of all matches, and of those that are not suppressed."""
    words = re.findall(licenses.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    line = " ".join(words)
    at, places = {}, 0
    for n, w in enumerate(words):
        at[places] = n
        places += len(w) + 1
    found = []
    for n, r in enumerate(RULES):
        for m in re.finditer(rf"(?:(?<= )|^)(?:{r.pattern})(?= |$)", line):
            found.append((at[m.start()], at[m.start()] + m[0].count(" "), r.level, n))
    order = lambda d: (d[0], -d[1], d[2], d[3])
    found.sort(key=order)
    kept = [d for d in found if not any(e[2] <= d[2] and e[0] <= d[0] and e[1] >= d[1] and order(e) < order(d) for e in found)]
    return words, found, kept


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    parts = [sample(parser.parse(r.pattern), rng) for r in RULES for _ in range(2)]
    filler = ["the", "GNU", "license", "version", "2", "0", "or", "later", "cc", "by", "éa", "x1", "rights", "all", "reserved"]
    mixed = []
    for _ in range(250):
        words = [rng.choice(parts) if rng.random() < 0.3 else rng.choice(filler) for _ in range(rng.randint(1, 14))]
        mixed.append(rng.choice([" ", "-", "\n", " (c) "]).join(words).title())
    long = " ".join(rng.choice(parts) if i % 3 == 0 else rng.choice(filler) for i in range(900))
    return [None, "", " ,;\n", "cc by", "CC-BY CC BY", "ccc by", "cc byé", "All Rights\x00Reserved", "Key MIT License", "İ general public license", "all rights reserved " * 700, long, *mixed]


def test_every_rule_is_found(spark):
    rng = random.Random(8)
    rows = [(n, sample(parser.parse(r.pattern), rng), "", "", 0) for n, r in enumerate(RULES) for _ in range(4)]
    found = licenses.detect(spark.createDataFrame(rows, SCHEMA).repartition(4)).selectExpr("doc_id", "text", "transform(licenses, d -> d.rule) as found").collect()
    assert [(r["doc_id"], r["text"]) for r in found if r["doc_id"] not in r["found"]] == []


def test_spans_equal_plain_search(spark, texts):
    rows = [(n, t, "", "", 0) for n, t in enumerate(texts)]
    got = licenses.detect(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert got.columns == ["doc_id", "text", "n_words", "licenses", "words"]
    for r in got.collect():
        words, found, kept = brute(r["text"])
        assert r["n_words"] == len(words)
        assert [(d["start"], d["end"], d["level"], d["rule"]) for d in r["licenses"]] == found, r["text"][:200]
        assert [tuple(d)[:4] for d in r["licenses"] if d["kept"]] == kept, r["text"][:200]


def test_report(spark, texts):
    rows = [(None if n % 5 == 0 else n % 7, t, "", "", 0) for n, t in enumerate(texts)]
    got = sorted(map(tuple, licenses.license_report(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    want = []
    for i, t, *_ in rows:
        words, found, kept = brute(t)
        base = [d for d in found if d[3] < len(licenses.BASE)]
        names = lambda spans: {RULES[d[3]].label for d in spans}
        score = max((licenses.WEIGHTS[d[2] - 1] for d in kept), default=0.0)
        want.append((i, len(words), len(base), min((d[0] for d in base), default=None), max((d[0] for d in base), default=None), ",".join(sorted(names(base))), ",".join(sorted(names(base) | names(kept))), score))
    assert got == sorted(want, key=repr)


def test_suppression():
    label = lambda t: {RULES[d[3]].label for d in brute(t)[2]}
    assert label("Licensed under the GNU General Public License, version 3 or later") == {"gpl-3.0-or-later"}
    assert label("SPDX-License-Identifier: Apache-2.0") == {"apache-2.0"}
    assert label("released under the CC BY-NC-SA 4.0") == {"cc-by-nc-sa-4.0"}
    assert label("the MIT License and the GPL v2") == {"mit", "gpl-2.0"}


def test_no_python_and_no_shuffle(spark, sf):
    plan = QUERIES["op12_license_scan"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_empty(spark):
    assert licenses.license_report(spark.createDataFrame([], SCHEMA)).collect() == []
