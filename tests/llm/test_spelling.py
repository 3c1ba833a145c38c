import random
import re
import zlib
from collections import Counter
from itertools import combinations

from compare import compare, connect
from helpers import docs, odd_docs, with_clashes

from hunkledger.llm import spelling

SF = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-z\u00c0-\u00ff]+")


def counted(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = 1 if doc_id is None else zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute(rows):
    counts = counted(rows)
    nears = {w: [v for v in counts if v != w and near(w, v)] for w in counts}
    forms = {}
    for w, vs in nears.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best and counts[best] >= 5 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while forms[root]:
            root = forms[root]
        out.add((w, forms[w], root, counts[w], len(nears[w]), counts[forms[w]] if forms[w] else None))
    return out


def found(df, **options):
    rows = [tuple(r) for r in spelling.variants(df, **options).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def edited(chance, word, letters):
    at = chance.randrange(len(word))
    return chance.choice((word[:at] + word[at + 1 :], word[:at] + chance.choice(letters) + word[at:], word[:at] + chance.choice(letters) + word[at + 1 :]))


def test_oracle(spark):
    ok, n, message = compare(spelling.op11_spelling(spark, SF), connect(SF), spelling.ORACLE)
    assert ok and n > 0, message


def test_chains_ties_and_blocks(spark):
    chance = random.Random(11)
    letters = "abé\u00ffn"
    words = {"".join(chance.choice(letters) for _ in range(chance.randrange(6, 11))) for _ in range(60)}
    times = {w: 5 for w in words}
    for w in list(words):
        v = w
        for n in (5, 26, 140)[: chance.randrange(1, 4)]:
            times[v] = max(times.get(v, 0), n)
            v = edited(chance, v, letters)
            times.setdefault(v, 5)
    pool = [w for w, n in times.items() for _ in range(n)]
    chance.shuffle(pool)
    rows = [(i, " ".join(pool[i * 40 : i * 40 + 40])) for i in range(-(-len(pool) // 40))]
    want = brute(rows)
    assert any(r[2] not in (r[0], r[1]) for r in want)  # a chain of two forms at least
    assert found(docs(spark, rows)) == want
    assert found(docs(spark, rows), block=3) == want  # every key cut into blocks


def test_words_of_few_letters_share_all_grams(spark):
    words = ["aaaaaa", "aaaaaaa", "aaaaaaaa", "aaabaa", "aabaaa", "ababab", "bababa", "abababa", "babababa", "bbbbbb", "bbbbbba"]
    rows = [(i, " ".join(words)) for i in range(5)] + [(9, "aaaaaa " * 30)]
    assert found(docs(spark, rows)) == brute(rows)


def test_odd_rows_long_text_and_clashing_columns(spark):
    long = ("Spelling spélling spellingg " * 40_000) + "x" * 50_000
    rows = [(70, long), (71, "spelling," * 7), (None, "without an identity " * 5), (72, "\u00d7\u00f7\u00d7\u00f7\u00d7\u00f7 " * 6)]
    df = odd_docs(spark).unionByName(docs(spark, rows))
    plain = [tuple(r) for r in df.select("doc_id", "text").collect()]
    want = brute(plain)
    assert found(with_clashes(df, "word", "n", "key", "h", "run", "id", "form")) == found(df) == want


def test_empty_table_and_no_words(spark):
    assert found(docs(spark, [])) == set()
    assert found(docs(spark, [(1, "a bb ccc"), (2, None)])) == set()


def test_pivots_are_disjoint_and_cheapest():
    chance = random.Random(5)
    for _ in range(300):
        places = sorted(chance.sample(range(12), chance.randrange(3, 7)))
        costs = [chance.randrange(1, 9) for _ in places]
        got = spelling.pivots_of(places, costs)
        cost = dict(zip(places, costs))
        fits = [c for c in combinations(places, 2) if c[1] - c[0] >= 2]
        assert tuple(got) in fits and sum(map(cost.get, got)) == min(sum(map(cost.get, c)) for c in fits)
