import numpy as np
import pytest

from ledgerloom.llm.mixing import RANKS, TOKENIZER, Plan, _encoder, draw_parts, mix, permute, shard_counts


@pytest.mark.parametrize("size", [1, 2, 3, 5, 17, 100, 4097])
def test_permutation(size):
    a, b = permute(np.arange(size), size, 1), permute(np.arange(size), size, 2)
    assert sorted(a.tolist()) == list(range(size)) == sorted(b.tolist())
    assert size < 17 or (a != b).any() and (a != np.arange(size)).any()


def test_shares_caps_and_round_trip(spark):
    from tokenizers import Tokenizer

    texts = [(i, ("big", "mid", "tiny")[0 if i % 10 < 7 else 1 if i % 10 < 9 else 2], f"text {i} " + "lorem ipsum dolor " * (i % 13)) for i in range(600)]
    texts += [(1000, "big", texts[0][2]), (1001, "other", "no target"), (1002, None, "x"), (1003, "big", None), (1004, "big", ""), (1005, "tiny", "long " * 30_000)]
    documents = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, source string, text string, tokens int")
    targets = spark.createDataFrame([("big", 0.5, 1, "x"), ("mid", 0.4, 2, "x"), ("tiny", 0.05, 1, "x"), ("absent", 0.05, 3, "x")], "source string, target_share double, max_repeats int, block string")
    plan = Plan(block=16, shard_slots=100, chunk=50)
    mixture, report = mix(documents, targets, plan)
    rows = mixture.collect()
    facts = {r.source: r for r in report.collect()}
    used = {}
    for r in rows:
        used.setdefault((r.source, r.block), []).append(r.repeat)
        assert r.n_tokens == len(r.tokens) <= 16
    assert all(len(v) == len(set(v)) <= facts[s].max_repeats for (s, _), v in used.items())
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)
    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.encode_special_tokens = True
    for source, extra in (("big", 1), ("mid", 0), ("tiny", 0)):
        whole = sorted({t for _, s, t in texts if s == source and t})
        blocks = sorted({(r.block, tuple(r.tokens)) for r in rows if r.source == source})
        total = sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in whole)
        assert facts[source].tokens_available == total and len({b for b, _ in blocks}) == len(blocks)
        assert facts[source].tokens_reached == sum(r.n_tokens for r in rows if r.source == source)
    assert facts["absent"].tokens_reached == 0 and facts["absent"].shortfall == facts["absent"].tokens_wanted > 0
    assert "other" not in facts
    again = mix(documents.repartition(7), targets, plan)[0].select("shard", "slot", "source", "block", "tokens")
    assert again.exceptAll(mixture.select("shard", "slot", "source", "block", "tokens")).count() == 0


def test_all_tokens_come_back(spark):
    from tokenizers import Tokenizer

    texts = [(i, "a", f"{i} some words {i * i}") for i in range(50)]
    documents = spark.createDataFrame(texts, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    rows = mix(documents, targets, Plan(block=8, chunk=1000))[0].orderBy("block").collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    end = tokenizer.token_to_id("<|endoftext|>")
    want = [x for i, _, t in sorted(texts) for x in [*tokenizer.encode(t, add_special_tokens=False).ids, end]]
    assert [x for r in rows for x in r.tokens] == want


def test_empty(spark):
    documents = spark.createDataFrame([], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, None), (None, 0.5, 1), ("b", None, 2)], "source string, target_share double, max_repeats int")
    mixture, report = mix(documents, targets)
    assert mixture.collect() == [] and {r.source for r in report.collect()} == {"a", "b"}
    assert mix(documents, targets.limit(0))[1].collect() == []


def test_shares_reached(spark):
    """Sources that have enough come within the error of the draw; one that runs out leaves its share to the others."""
    texts = [(i, "abcd"[i % 4], f"{i} " + "some words of a text " * 10) for i in range(2400)]
    documents = spark.createDataFrame(texts, "doc_id long, source string, text string")
    targets = [("a", 0.4, 9), ("b", 0.3, 9), ("c", 0.2, 9), ("d", 0.1, 9)]
    schema = "source string, target_share double, max_repeats int"
    plan = Plan(block=16, shard_slots=50, parts=7)
    for r in mix(documents, spark.createDataFrame(targets, schema), plan)[1].collect():
        assert abs(r.share_reached - r.target_share) < 0.015 and abs(r.tokens_reached - r.tokens_wanted) < 0.05 * r.tokens_wanted + 1, r
        assert r.shortfall == pytest.approx(max(0.0, r.tokens_wanted - r.tokens_reached))
    short = {r.source: r for r in mix(documents, spark.createDataFrame([("a", 0.4, 1), *targets[1:]], schema), plan)[1].collect()}
    assert short["a"].tokens_reached == short["a"].tokens_available and short["a"].shortfall > 0
    rest = sum(short[s].tokens_reached for s in "bcd")
    assert all(abs(short[s].tokens_reached / rest - short[s].target_share / 0.6) < 0.02 for s in "bcd")


@pytest.mark.parametrize(("slots", "parts"), [(0, 4), (1, 4), (10_007, 4), (10_007, 1), (10_007, 5000)])
def test_shards_add_up(slots, parts):
    """Shards have as many slots as the plan says, and parts as many of each source as were drawn for them."""
    plan, shares = Plan(shard_slots=10, parts=parts), np.array([0.5, 0.3, 0.2])
    starts, first, drawn = draw_parts(slots, shares, plan)
    sizes = []
    for p in range(len(starts) - 1):
        counts = list(shard_counts(drawn[p], int(starts[p + 1] - starts[p]), plan, p))
        assert (sum(counts) == drawn[p]).all() and (first[p] == drawn[:p].sum(axis=0)).all()
        sizes += [int(c.sum()) for c in counts]
    assert sum(sizes) == slots and all(n == 10 for n in sizes[:-1]) and len(sizes) == max(1, -(-slots // 10))
    assert slots < 1000 or abs(drawn.sum(axis=0) / slots - shares).max() < 0.02


def test_both_forms_of_the_vocabulary_give_the_same_ids():
    texts = ["", " plain text, it's 12%", "순중량 190 톤\n\n  §", "<|endoftext|> in a text", "x" * 30_000, " \t " * 5_000, "a\x00é́\u200b가나다"]
    (one, end), (two, last) = _encoder(TOKENIZER, "<|endoftext|>"), _encoder(RANKS, "<|endoftext|>")
    assert [list(x) for x in one(texts)] == [list(x) for x in two(texts)] and end == last == [50256]
    assert _encoder(RANKS, None)[1] == [] == _encoder(TOKENIZER, None)[1]
