import random

import pytest

from gaugeworks.llm import leaks as L

rnd = random.Random(11)
VOCAB = [f"{a}{b}" for a in ("load", "merge", "sort", "scan", "trim", "fold") for b in ("queue", "table", "route", "meter", "batch", "grid", "shelf", "crop")]


def sentence(n):
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


ITEMS = [(i, f"{sentence(14)}?\nA. {sentence(13)}.\nB. {sentence(15)}.\nReason: {sentence(12)}.") for i in range(25)]


def brute(item, doc):
    """Whether a window of twelve or more words of the item is in the document with one change in eight at most: every
    window against every place, by edit distance."""
    placed = [(p, w) for p, w in enumerate(L.words(item)) if w not in L._MARKERS]
    a, place = [w for _, w in placed], [p for p, _ in placed]
    b = [w for w in L.words(doc) if w not in L._MARKERS]
    inf = 10**6
    for start in range(len(a)):
        # a window begins and ends with words that are there; between them words may be changed, left out or put in
        row = [inf] * (len(b) + 1)
        for n in range(1, len(a) - start + 1):
            w, new, ends = a[start + n - 1], [inf], inf
            for j in range(1, len(b) + 1):
                same = w == b[j - 1]
                if n == 1:
                    # words may be put in behind the first one
                    new.append(0 if same else new[j - 1] + 1)
                    continue
                new.append(min(row[j - 1] + (not same), row[j] + 1, new[j - 1] + 1))
                if same:
                    ends = min(ends, row[j - 1])
            row = new
            if min(row) * 8 > len(a):
                break
            # option marks count as words of the item
            words = place[start + n - 1] - place[start] + 1
            if words >= 12 and ends * 8 <= words:
                return True
    return False


def changed(words, every):
    return [("maybe" if i % every == every - 1 and i else w) for i, w in enumerate(words)]


def test_against_brute_force():
    s = L.Searcher(ITEMS)
    docs = []
    for i, text in rnd.sample(ITEMS, 8):
        w = text.split()
        a = rnd.randrange(len(w) - 30)
        docs += [" ".join(w[a : a + n]) for n in (5, 9, 11, 14, 30)]
        docs += [sentence(20) + " " + " ".join(changed(w[a : a + 30], k)) + " " + sentence(9) for k in (4, 9, 12)]
        left_out = [x for j, x in enumerate(w[a : a + 26]) if j % 9 != 8]
        docs.append(" ".join(left_out))
    for doc in docs:
        assert set(s.leaked(doc)) == {i for i, t in ITEMS if brute(t, doc)}, doc


def test_changed_blocks_against_brute_force():
    """Blocks of an item replaced, left out or filled up at random places, in items with marks close together too."""
    close = [(100 + i, " ".join(f"{m} {sentence(rnd.randrange(1, 5))}" for m in "ABCDEFGH") + " " + sentence(9)) for i in range(6)]
    for items in (ITEMS, close):
        s = L.Searcher(items)
        for i, text in items * (40 // len(items) + 1):
            w = text.split()
            for _ in range(rnd.randrange(1, 8)):
                a, n = rnd.randrange(len(w)), rnd.choice((1, 1, 1, 2, 3, 5, 8))
                w[a : a + n] = rnd.choice(([], ["maybe"] * n, [w[a], "maybe"]))
            a = rnd.randrange(max(1, len(w) - 12))
            doc = " ".join(w[a : a + rnd.randrange(10, 60)])
            assert (i in s.leaked(doc)) == brute(text, doc), doc


def test_a_changed_middle_hides_no_leak():
    s = L.Searcher(ITEMS)
    for i, text in ITEMS:
        w = text.split()
        for kept in (5, 6, 7, 8):
            for other in (4, 6, 8):
                assert i in s.leaked(" ".join([*w[:kept], *["maybe"] * other, *w[kept + other :]]))


def test_layout_and_markup():
    s = L.Searcher(ITEMS)
    text = ITEMS[3][1]
    w = text.replace("\n", " ").split()
    assert s.leaked(text.upper()) == [3]
    assert s.leaked("> " + "\n> ".join(" ".join(w[i : i + 5]) for i in range(0, len(w), 5))) == [3]
    assert s.leaked("<p>" + "</b> <b>".join(w) + "</p>") == [3]
    assert s.leaked(" ".join(f"**{x}**" for x in w)) == [3]
    assert s.leaked("​".join(text)) == [3]
    link = f'<a\n  href="https://example.invalid/{"x" * 900}"\n  title=\'{"y " * 200}\'>'
    assert s.leaked(f"<!-- {'z - ' * 300}-->".join(w)) == [3] and s.leaked(link.join(f"{x} " for x in w)) == [3]
    assert s.leaked(f"<a href={'x' * 900} {'y ' * 90}>".join(w)) == [3]
    assert L.words("if a <b then c\nand d> e") == "if a b then c and d e".split()
    assert s.leaked(" ".join(w[:8])) == [] and s.leaked("") == [] and s.leaked(None) == []


def test_shifts_skip_nothing():
    s = L.Searcher(ITEMS)
    for _ in range(200):
        doc = s.encode(" ".join(rnd.choice(ITEMS)[1].split()[rnd.randrange(10) :]) + " " + sentence(rnd.randrange(30)))
        got = {(k, a, b) for k, a, b in s.seeds(doc)}
        want = {(k, a, b) for k, item in enumerate(s.items) for a in range(len(item) - s.seed + 1) for b in range(len(doc) - s.seed + 1) if item[a : a + s.seed] == doc[b : b + s.seed]}
        assert got == want


@pytest.mark.parametrize("limit", [L.PASS_CHARS, 900])
def test_frame(spark, monkeypatch, limit):
    monkeypatch.setattr(L, "PASS_CHARS", limit)
    docs = [(1, ITEMS[0][1], "x"), (1, ITEMS[0][1], "x"), (2, sentence(40), "x"), (3, None, "x"), (4, "", "x"), (5, ITEMS[1][1] + " " + ITEMS[2][1], "x"), (6, "word " * 400_000, "x")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame([*ITEMS, (77, ITEMS[0][1]), (78, None), (79, "short"), (None, ITEMS[0][1])], "item_id bigint, text string")
    assert sorted(map(tuple, L.find_leaks(d, i).collect())) == [(1, 0), (1, 77), (5, 1), (5, 2)]
    assert L.find_leaks(d.limit(0), i).count() == 0 and L.find_leaks(d, i.limit(0)).count() == 0


def test_every_exact_run_of_a_diagonal_is_extended():
    s = L.Searcher(ITEMS)
    w = " ".join(L.words(ITEMS[7][1])).split()
    w = [x for x in w if x not in L._MARKERS]
    for n, gap in ((8, 3), (5, 4), (11, 6), (6, 12)):
        doc = w[:n] + ["maybe"] * gap + w[n + gap : n + gap + 12]
        assert brute(ITEMS[7][1], " ".join(doc)), (n, gap)
        assert s.leaked(" ".join(doc)) == [7], (n, gap)
        # and the other way round, and with a third run
        doc = w[:6] + ["maybe"] * 4 + w[10:16] + ["maybe"] * 4 + w[20:32]
        assert s.leaked(" ".join(doc)) == [7]
    # a run with more changes than allowed is none
    assert s.leaked(" ".join(w[:8] + ["maybe"] * 3 + w[11:18])) == []
