import random

import pytest

from ledgerloom.llm.labels import Reference, _joined_tokens, abbreviates, distances, edits, map_labels, mapped_candidates, prefix_keys, token_similarity, tokens, unmatched_labels

LABELS = [("Net shipment weight", "mass"), ("M5 net mass", "m5"), ("M12 net mass", "m12"), ("Certificate price", "price"), ("M5 process direct emissions", "direct"), ("M5 process indirect emissions", "indirect"), ("출하 순중량 합계", "mass"), ("전력 소비 총량", "energy"), ("CN heading", "cn")]


@pytest.fixture(scope="module")
def reference(spark):
    return spark.createDataFrame(LABELS, "label string, field string")


def slow_edits(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_edit_distance():
    rng = random.Random(5)
    for _ in range(800):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 8))) for _ in "ab")
        most = rng.randint(0, 5)
        assert edits(a, b, most) == min(slow_edits(a, b), most + 1)


def test_tokens_and_abbreviations():
    assert tokens("1) Ｍ12/net_mass (final)") == ["m12", "net", "mass", "final"]
    assert abbreviates("emiss", "emissions") > abbreviates("shpt", "shipment") > abbreviates("inddir", "indirect") > 0 == abbreviates("gross", "net")


CASES = {
    "net shipment weight": "mass", "Nct-shipment-weight": "mass", "weight net shipment": "mass", "Net shpt wt.": "mass", "M5 proc. dir. emiss.": "direct", "M5 proc. indir. em.": "indirect",
    "No.3 M12 net rnass (합계)": "m12", "ＣＮ ｈeading": "cn", "Certifіcate​ price": "price", "출하순중량합계": "mass", "전력 스비 총양": "energy", "CN h3ading": "cn",
    "M7 net mass": None, "Gross weight": None, "Certificate holder": None, "용수 소비 총량": None, "": None, "- * -": None, "x" * 20_000: None,
}


def test_labels_by_meaning(candidates, reference):
    rows = [{"cand_id": i, "raw_label": label} for i, label in enumerate(CASES)]
    got = {r.cand_id: r.field for r in mapped_candidates(candidates(*rows, *rows), reference).collect()}
    assert got == {i: f for i, f in enumerate(CASES.values()) if f}
    left = {r.raw_label: r.records for r in unmatched_labels(candidates(*rows, *rows), reference).collect()}
    assert left == {label: 1 for label, f in CASES.items() if f is None}


def test_held_out_accuracy():
    """Mistyped labels find their entry: characters dropped, doubled, swapped or replaced, words shuffled."""
    ref, rng, right, count = Reference(sorted(LABELS)), random.Random(11), 0, 0
    for label, field in LABELS * 40:
        words = label.split()
        if rng.random() < 0.3:
            rng.shuffle(words)
        k = rng.randrange(len(words))
        w, i = words[k], rng.randrange(len(words[k]))
        if not w.isalpha() or len(w) < 4 and w.isascii():
            continue
        words[k] = rng.choice([w[:i] + w[i + 1 :], w[:i] + w[i] * 2 + w[i + 1 :], w[:i] + rng.choice("eiou") + w[i + 1 :]])
        ranked = ref.rank([(t, ref.repair(t)) for t in tokens(" ".join(words))])
        right += bool(ranked) and ref.entries[ranked[0][1]][1] == field
        count += 1
    assert count > 200 and right / count > 0.97


def test_edges(candidates, reference):
    assert map_labels(candidates(), reference).collect() == []
    rows = candidates({"cand_id": 1}, {"cand_id": 2, "raw_label": "CN heading", "field": "cn"}, {"cand_id": 3, "raw_label": "CN heading"}, extra="token string, position int, label string")
    assert [tuple(r) for r in mapped_candidates(rows, reference).collect()] == [(3, "cn")]
    assert mapped_candidates(rows, reference.limit(0)).collect() == []
    assert {r.raw_label for r in unmatched_labels(rows, reference).collect()} == {None}


def test_distances_of_batches():
    rng = random.Random(9)
    pairs = [["".join(rng.choice("abcd한") for _ in range(rng.choice([0, 1, 3, 6, 9]))) for _ in "ab"] for _ in range(600)]
    assert distances(*zip(*pairs, strict=True)).tolist() == [slow_edits(a, b) for a, b in pairs]
    assert distances([], []).tolist() == []


def test_prefix_keys_lose_no_pair():
    rng = random.Random(10)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 12))) for _ in range(250)]
    for least in (0.6, 0.74):
        for a in words:
            for b in words[:60]:
                size = max(len(a), len(b))
                if slow_edits(a, b) <= int((1 - least) * size):
                    assert set(prefix_keys(a, least)) & set(prefix_keys(b, least)), (a, b)


def test_joined_tokens_agree_with_the_plain_form(spark):
    rng = random.Random(12)
    words = sorted({w for label, _ in LABELS for w in tokens(label)} | {"emission", "emitted", "m55", "mass5"})
    unknown = {"".join(rng.choice(w) if rng.random() < 0.2 else c for c in w) + rng.choice(["", "", "s", "5"]) for w in words * 6} | {"emiss", "rnass", "we1ght", "m1122", "inddir", "prc"}
    unknown = sorted(t for t in unknown if t not in words)
    frames = [spark.createDataFrame([(x,) for x in xs], f"{name} string") for xs, name in ((unknown, "token"), (words, "word"))]
    got = {(r.token, r.word): round(r.similarity, 9) for r in _joined_tokens(*frames).collect()}
    assert got == {(t, w): round(s, 9) for t in unknown for w in words if (s := token_similarity(t, w))} and len(got) > 50


def test_blocks_make_no_difference(candidates, reference):
    df = candidates(*({"cand_id": i, "raw_label": label} for i, label in enumerate(CASES)))
    one, many = (sorted((tuple(r) for r in map_labels(df, reference, n).collect()), key=str) for n in (1000, 2))
    assert one == many


def test_decorations_are_learnt(spark, candidates):
    listed = [(f"{w} amount", w) for w in ("steel", "copper", "timber", "cement", "glass", "paper")]
    reference = spark.createDataFrame(listed, "label string, field string")
    labels = [f"{label} zwischenstand" for label, _ in listed[:5]] + ["PAPER-amount zwischenstnd", "paper amount lorry", "paper lorry"]
    df = candidates(*({"cand_id": i, "raw_label": label} for i, label in enumerate(labels)))
    got = {r.raw_label: r.score for r in map_labels(df, reference).collect()}
    assert all(got[x] > 0.999 for x in labels[:6]) and got["paper amount lorry"] < 0.9 and got["paper lorry"] < 0.6
