import random

import numpy as np
from helpers import docs, odd_docs, with_clashes

from hunkledger.llm import decontaminate as dec

ITEM = "What is the tallest mountain on earth, and in which country does it stand today? Answer: Everest."


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def found(df):
    return {(r["doc_id"], m["item_id"]): (m["edits"], m["start"], m["end"]) for r in df.collect() for m in r["matches"]}


def test_places_and_edits(spark):
    changed = ITEM.replace("tallest", "tallezt").replace("which", "wich")
    noisy = "".join(f"{w}%%% " for w in ITEM.upper().split())
    rows = [(1, f"pre \U0001f600 {ITEM} post"), (2, changed), (3, noisy), (4, ITEM[: len(ITEM) // 2]), (5, ITEM * 2), (6, "the the the " * 400), (7, "clean text"), (7, ITEM)]
    out = dec.match(docs(spark, rows), bench(spark, [(10, ITEM), (10, ITEM), (11, "short"), (12, None), (None, "another item that is long enough to be evidence 123")]))
    got = found(out)
    assert set(got) == {(1, 10), (2, 10), (3, 10), (5, 10), (7, 10)}
    at = rows[0][1].index(ITEM)
    assert got[1, 10] == (0, at, at + len(ITEM) - 1)  # the last full stop is no letter or digit
    assert got[2, 10][0] == 2 and got[3, 10][0] == 0 and got[5, 10][1] == 0
    assert sorted(len(r["matches"]) for r in out.filter("doc_id = 1").collect()) == [2]  # repeated items


def test_no_edited_copy_is_missed():
    chance = random.Random(2)
    letters = "abcdefgh"
    items = ["".join(chance.choice(letters) for _ in range(chance.randrange(50, 200))) for _ in range(20)]
    index = dec.Index(list(enumerate(items)))
    for trial in range(120):
        i = chance.randrange(len(index.ids))
        own = list("".join(map(chr, index.codes[i])))
        for _ in range(int(index.budget[i])):
            at, kind = chance.randrange(len(own)), chance.randrange(3)
            if kind == 0:
                own[at] = chance.choice("xyz")
            elif kind == 1:
                del own[at]
            else:
                own.insert(at, chance.choice("xyz"))
        pad = "".join(chance.choice(letters) for _ in range(chance.randrange(60)))
        matches = dec.find([pad, f"{pad} {''.join(own)} {pad}"], index)[1]
        assert index.ids[i] in {m[0] for m in matches}
        assert all(m[1] <= index.budget[m[0]] for m in matches)


def test_alignment_equals_the_full_table():
    chance = random.Random(5)

    def full(item, text):
        row = [0] * (len(text) + 1)
        for a in item:
            last, row = row, [row[0] + 1]
            for j, b in enumerate(text):
                row.append(min(last[j] + (a != b), last[j + 1] + 1, row[j] + 1))
        return min(row)

    code = lambda s: np.array(list(map(ord, s)), dtype=np.uint32)
    for _ in range(150):
        item = "".join(chance.choice("abc") for _ in range(30))
        text = item[: chance.randrange(31)] + "".join(chance.choice("abc") for _ in range(4)) + item[chance.randrange(31) :]
        match, want = dec.aligned(code(item), code(text), -40, 70, 6), full(item, text)
        assert (match[0] if match else None) == (want if want <= 6 else None)


def test_blocks_give_the_same(spark):
    rows = [(i, f"{ITEM} number {i} of the benchmark items") for i in range(6)]
    df = docs(spark, [(i, f"x {t} y") for i, t in rows] + [(99, "clean")])
    one, many = (found(dec.match(df, bench(spark, rows), block_chars=c)) for c in (1 << 20, 150))
    assert one == many and len(one) >= 6


def test_odd_rows(spark):
    items = bench(spark, [(1, ITEM)])
    assert dec.match(with_clashes(odd_docs(spark), "matches"), items).filter("size(matches) > 0").count() == 0
    assert dec.match(odd_docs(spark), items.limit(0)).filter("size(matches) = 0").count() == 8
    assert dec.match(odd_docs(spark).limit(0), items).count() == 0


def test_short_items_match_verbatim_at_word_boundaries():
    """Equal to a search in the normalised texts, for items of every length below the limit."""
    import random
    import re

    pick = random.Random(11)
    words = ["a", "bc", "cat", "dogs", "é", "x1", "cat's"]
    texts = [" ".join(pick.choice(words) for _ in range(pick.randrange(12))) for _ in range(150)] + ["", "Cat,\n DOGS!", "concat dogsled"]
    items = list({" ".join(pick.choice(words) for _ in range(n)) for n in (1, 1, 2, 2, 3, 3, 4, 5) for _ in range(4)}) + ["!?", ""]
    index = dec.Index([(i, t) for i, t in enumerate(items)] + [(100, items[0])])
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    some = 0
    for text, found in zip(texts, dec.find(texts, index)):
        want = {i for i, t in enumerate(items) if plain(t) and f" {plain(t)} " in f" {plain(text)} "}
        if 0 in want:
            want.add(100)
        assert sorted(m[0] for m in found) == sorted(want)
        for item, edits, start, end in found:
            assert edits == 0 and plain(text[start:end]) == plain(items[item % 100])
        some += len(found)
    assert some > 100


def test_short_and_long_items_together(spark):
    long = "the quick brown fox jumps over the lazy dog and runs far away"
    rows = [(1, f"well, {long}. Yes: 42 is it!"), (2, "42 is  IT"), (3, "142 is it"), (4, None), (5, "")]
    out = dec.match(docs(spark, rows), bench(spark, [(1, long), (2, "42 is it"), (3, "  "), (4, None)]))
    got = {r.doc_id: sorted(m.item_id for m in r.matches) for r in out.collect()}
    assert got == {1: [1, 2], 2: [2], 3: [], 4: [], 5: []}
