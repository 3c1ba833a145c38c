import random
import re

from helpers import by_id, docs, odd_docs, with_clashes

from hunkledger.llm import licences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts, labels = [], set()
    for phrase, label in licences.BASE.items():
        own = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(own)] == own:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


TEXTS = [
    "Licensed under the Apache License, Version 2.0.", "mit license MIT-License mit\nlicense", "xmit license mit licenses",
    "GNU General Public License v3 cc by cc  by-nc 4.0", "é mit licenseé", "cc by cc by", "", None,
    "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\nrest",
]


def test_base_equals_brute_force(spark):
    df = docs(spark, list(enumerate(TEXTS)))
    got = by_id(licences.scan_licences(df), "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == {i: base(t) for i, t in enumerate(TEXTS)}


def test_labels(spark):
    got = by_id(licences.scan_licences(docs(spark, list(enumerate(TEXTS)))), "labels", "score")
    assert got[0][0] == "apache,apache-2.0" and got[0][1] > 0.9
    assert got[3][0] == "cc-by,cc-by-nc,gpl"
    assert got[8][0] == "apache-2.0,gpl-2.0-only with classpath-exception-2.0,mit" and got[8][1] == 1.0
    assert got[6] == got[7] == ("", 0.0)


def ways(expression):
    """Every way to satisfy a well-formed expression, as sets of licences, by plain enumeration."""
    stack = []
    for token in licences.postfix(expression):
        if token not in ("or", "and", "with"):
            stack.append({frozenset([token])})
            continue
        right, left = stack.pop(), stack.pop()
        if token == "or":
            stack.append(left | right)
        elif token == "and":
            stack.append({a | b for a in left for b in right})
        else:
            stack.append({frozenset(f"{x} with {y}" for x in a for y in b) for a in left for b in right})
    return stack[-1] if stack else set()


def test_expressions():
    def brute_force(expression):
        found = ways(expression)
        return set.intersection(*map(set, found)) if found else set(), {name for way in found for name in way}

    assert licences.evaluate("MIT OR GPL") == (set(), {"mit", "gpl"})
    assert licences.evaluate("MIT AND GPL") == ({"mit", "gpl"}, {"mit", "gpl"})
    assert licences.evaluate("(MIT OR A) AND B") == ({"b"}, {"mit", "a", "b"})
    assert licences.evaluate("(MIT OR A AND MIT) WITH e") == ({"mit with e"}, {"mit with e", "a with e"})
    for text in ("MIT AND", "MIT */", "(MIT", "MIT"):
        assert licences.evaluate(text) == ({"mit"}, {"mit"})
    for text in ("", "AND", ")"):
        assert licences.evaluate(text) == (set(), set())
    pick = random.Random(3)

    def any_expression(depth):
        if not depth or pick.random() < 0.2:
            # names that take an exception always take the same one
            return pick.choice(["A", "B", "C", "D WITH x", "E WITH y"])
        return "(" + any_expression(depth - 1) + pick.choice([" OR ", " AND "]) + any_expression(depth - 1) + ")"

    simple = [any_expression(4) for _ in range(300)]
    for text in simple:
        required, allowed = licences.evaluate(text)
        want, may = brute_force(text)
        assert allowed == may and required == want, text


def test_a_hostile_expression_takes_linear_time():
    clauses = " AND ".join(f"(a{i} OR b{i})" for i in range(20_000))
    required, allowed = licences.evaluate(clauses)
    assert required == set() and len(allowed) == 40_000
    chain = " WITH ".join(f"e{i}" for i in range(20_000))  # every second one counts as AND
    assert len(licences.evaluate(chain)[0]) == 10_000


def test_required_depends_on_the_operators(spark):
    texts = [(i, f"x\nSPDX-License-Identifier: {e}\ny") for i, e in enumerate(["MIT OR GPL", "MIT AND GPL", "MIT"])]
    got = by_id(licences.scan_licences(docs(spark, texts)), "labels", "required")
    assert got == {0: ("gpl,mit", ""), 1: ("gpl,mit", "gpl,mit"), 2: ("mit", "mit")}


def test_odd_rows(spark):
    out = licences.scan_licences(with_clashes(odd_docs(spark), "score", "labels"))
    assert out.count() == 8 and out.columns.count("labels") == 1
    assert licences.scan_licences(odd_docs(spark).limit(0)).count() == 0
