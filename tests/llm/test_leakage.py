import random

import pytest

from ledgerloom.llm.leakage import build_automaton, leaked_items, remove_leaks, scan_leaks


def letters(text):
    return "".join(c.lower()[0] for c in text if c.isalnum())


def brute(documents, items, run):
    runs = {}
    for item, text in items:
        s = letters(text)
        for i in range(len(s) - run + 1):
            runs.setdefault(s[i : i + run], set()).add(item)
    return {(d, item) for d, text in documents for i in range(len(letters(text)) - run + 1) for item in runs.get(letters(text)[i : i + run], ())}


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh 한글"])
def test_agrees_with_brute_force(spark, alphabet):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    items = [(i, text(rng.randint(0, 60)), text(rng.randint(0, 60))) for i in range(40)]
    documents = [(i, text(rng.randint(0, 80))) for i in range(150)]
    documents += [(1000 + i, text(20) + items[i][1].upper().replace("A", "A-\n") + text(20)) for i in range(40)]
    df, tests = spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, query string, passage string")
    for run in (8, 14):
        got = [tuple(r) for r in leaked_items(df, tests, run).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(documents, [(i, t) for i, q, p in items for t in (q, p)], run)


def test_automaton_recognises_exactly_the_substrings():
    a = build_automaton([(1, "abcbc"), (2, "bcbcd")], 2)
    step = dict(zip(a.keys.tolist(), a.targets.tolist(), strict=True))

    def known(s):
        state = 0
        for c in s:
            state = step.get((state << 21) | ord(c))
            if state is None:
                return False
        return True

    every = {s[i:j] for s in ("abcbc", "bcbcd") for i in range(5) for j in range(i, 6)}
    assert all(known(s) for s in every) and not known("abd") and not known("cbcbc")


def test_removal_and_edges(spark):
    passage = "The quick brown fox jumps over the lazy dog while nine wizards watch from afar 1234567890"
    tests = spark.createDataFrame([(1, None, passage), (2, "short", ""), (3, passage, None)], "item_id long, query string, passage string")
    filler = "Entirely different words about the weather and the sea, again and again. " * 10
    rows = [(1, filler + passage + filler, "x"), (2, passage.upper(), "x"), (3, None, "x"), (4, "", "x"), (5, filler * 300 + passage, "x"), (6, filler, None), (1, filler + passage + filler, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, items string")
    assert {tuple(r) for r in leaked_items(df, tests).collect()} == {(d, i) for d in (1, 2, 5) for i in (1, 3)}
    out = {r.doc_id: r for r in remove_leaks(df, tests).collect()}
    assert out[2].action == "drop" and out[2].text is None
    assert out[1].action == "cut" and "wizards" not in out[1].text and out[1].text.startswith(filler[:700]) and out[1].text.endswith(filler)
    assert scan_leaks(df.limit(0), tests).collect() == [] and leaked_items(df, tests.limit(0)).collect() == []


def test_sets_of_items_make_no_difference(spark):
    """Items beyond one automaton are scanned in sets: same items, spans, letters and cut texts."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcde F-한") for _ in range(n))
    items = [(i, text(rng.randint(0, 90)), text(rng.randint(0, 400))) for i in range(30)]
    documents = [(i, text(30) + items[i % 30][2][: rng.randint(20, 400)].upper() + text(30) + items[(i + 1) % 30][2]) for i in range(60)]
    df, tests = spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, query string, passage string")
    one, many = ({r.doc_id: r for r in scan_leaks(df, tests, 12, n).collect()} for n in (10**6, 900))
    assert one.keys() == many.keys() and len(one) > 50
    for k, r in one.items():
        assert (sorted(r["items"]), r.spans, r.matched, r.letters) == (many[k]["items"], many[k].spans, many[k].matched, many[k].letters), k
