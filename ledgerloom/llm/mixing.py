"""Mixing sources to target weights.

Tokens of each source are packed into fixed-length blocks; source counts per output shard are drawn from a multinomial;
slots are mapped to blocks through a pseudorandom permutation of each source's block indexes, a new one for each
repetition; blocks are joined by index. Shares reached and shortfalls are reported.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import materialise

#: One vocabulary in two forms, with the same ids: as a tokenizer's file, and as ranks, which are encoded several times faster.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary cuts a text before its bytes are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MOST_SOURCES = 10_000
ENCODED_CHARACTERS = 200_000
#: Counts that the driver draws and broadcasts at most (parts of the mixture x sources); shards are drawn within parts.
DRAWN_COUNTS = 500_000


@dataclass(frozen=True)
class Plan:
    """Settings: tokens of a block, slots of a shard at most, seed, and the tokens wanted (None: all there are)."""

    block: int = 512
    shard_slots: int = 1000
    #: Parts of the mixture, each a run of shards that one task draws; there are as many shards as the slots need.
    parts: int = 4096
    seed: int = 7
    #: The token that ends every text, so that no packed text runs into the next (None: none).
    separator: str | None = "<|endoftext|>"
    tokens: int | None = None
    #: Texts of a chunk, within which running sums are taken.
    chunk: int = 20_000
    tokenizer: str = RANKS


def tokenise(documents: DataFrame, path: str, separator: str | None = None) -> DataFrame:
    """source, doc_id, tokens of every distinct text of a source: a text under several ids or sources counts once.

    path is a tokenizer's file, or ranks of byte pairs (.tiktoken). Where separator names a token of the vocabulary (the
    first free id of ranks, which have no such tokens), it ends every text.
    """
    rows = documents.select("doc_id", "source", "text").filter("text IS NOT NULL AND text <> '' AND source IS NOT NULL")
    first = rows.groupBy(F.sha2("text", 256).alias("#key")).agg(F.min_by(F.struct("source", "doc_id", "text"), F.struct("doc_id", "source")).alias("r"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of, last = _encoder(path, separator)
        for b in batches:
            # Encodings hold much more than ids, so only some texts are encoded at a time.
            group = b["text"].str.len().cumsum().floordiv(ENCODED_CHARACTERS)
            for _, part in b.groupby(group, sort=False):
                ids = [np.array(x + last, dtype=np.int32) for x in ids_of(part["text"].tolist())]
                yield pd.DataFrame({"source": part["source"], "doc_id": part["doc_id"], "tokens": ids})

    return first.select("r.*").mapInPandas(encode, "source string, doc_id long, tokens array<int>")


def _encoder(path: str, separator: str | None) -> tuple[Callable[[list[str]], Iterable[list[int]]], list[int]]:
    """(ids of texts, ids that end a text)."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: map(encoding.encode_ordinary, texts), [] if separator is None else [max(ranks.values()) + 1]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    last = [] if separator is None else [tokenizer.token_to_id(separator)]
    if None in last:
        raise ValueError(f"the tokenizer has no token {separator}")
    return lambda texts: (e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)), last


def pack(tokenised: DataFrame, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """(source, block, n_tokens, tokens) of every block, and (source, texts, tokens, blocks) of every source.

    A source's stream is ordered by chunk and doc_id. Running sums are taken within chunks and over the sums of chunks,
    so no task holds a whole source. Only the last block of a source may be shorter.
    """
    count = tokenised.count()
    chunks = max(1, -(-count // plan.chunk))
    rows = tokenised.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks))).withColumn("n", F.size("tokens").cast("long"))
    sums = rows.groupBy("source", "chunk").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("source", "chunk").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("offset", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(starts, ["source", "chunk"])
    begin = F.col("base") + F.col("offset")
    size = F.lit(plan.block)
    pieces = (
        placed.filter("n > 0")
        .select("source", begin.alias("begin"), "n", "tokens")
        .withColumn("block", F.explode(F.sequence(F.expr(f"begin div {plan.block}"), F.expr(f"(begin + n - 1) div {plan.block}"))))
        .withColumn("low", F.greatest(F.col("begin"), F.col("block") * size))
        .withColumn("high", F.least(F.col("begin") + F.col("n"), (F.col("block") + 1) * size))
        .select("source", "block", "low", F.slice("tokens", (F.col("low") - F.col("begin") + 1).cast("int"), (F.col("high") - F.col("low")).cast("int")).alias("part"))
    )
    # At most block pieces come together, as each holds a token at least.
    blocks = (
        pieces.groupBy("source", "block")
        .agg(F.array_sort(F.collect_list(F.struct("low", "part"))).alias("parts"))
        .select("source", "block", F.flatten("parts.part").alias("tokens"))
        .select("source", "block", F.size("tokens").alias("n_tokens"), "tokens")
    )
    sizes = rows.groupBy("source").agg(F.count("*").alias("texts"), F.sum("n").alias("tokens"))
    return blocks, sizes.withColumn("blocks", F.ceil(F.col("tokens") / plan.block))


def permute(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(size): four rounds over a near-square grid, walking on while outside."""
    side = int(np.ceil(np.sqrt(size)))
    other = -(-size // side)

    def mix(x: np.ndarray, salt: int) -> np.ndarray:
        z = (x.astype(np.uint64) + np.uint64((key * 0x9E3779B97F4A7C15 + salt * 0xBF58476D1CE4E5B9) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(31)
        z *= np.uint64(0x94D049BB133111EB)
        return (z ^ (z >> np.uint64(29))) >> np.uint64(1)

    out = index.astype(np.int64).copy()
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = out[todo] // other, out[todo] % other
            for salt in range(4):
                if salt % 2:
                    right = (right + (mix(left, salt) % np.uint64(other)).astype(np.int64)) % other
                else:
                    left = (left + (mix(right, salt) % np.uint64(side)).astype(np.int64)) % side
            out[todo] = left * other + right
            todo = todo[out[todo] >= size]
    return out


def draw_parts(slots: int, shares: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first shard of each part and the end, slots of each source before each part, slots of each source in it).

    Every part is a multinomial draw; their number is bounded by the plan and by DRAWN_COUNTS, not their length.
    """
    shards = max(1, -(-slots // plan.shard_slots))
    parts = int(max(1, min(plan.parts, shards, DRAWN_COUNTS // max(1, len(shares)))))
    starts = np.array([shards * p // parts for p in range(parts + 1)], dtype=np.int64)
    edges = np.minimum(starts * plan.shard_slots, slots)
    rng = np.random.default_rng(plan.seed)
    if len(shares) and shares.sum():
        drawn = np.array([rng.multinomial(n, shares) for n in np.diff(edges)], dtype=np.int64)
    else:
        drawn = np.zeros((parts, len(shares)), dtype=np.int64)
    return starts, np.cumsum(drawn, axis=0) - drawn, drawn


def shard_counts(drawn: np.ndarray, shards: int, plan: Plan, part: int) -> Iterator[np.ndarray]:
    """Slots of each source in each shard of a part: drawn without replacement from the part's slots.

    Given the counts of a part, this is how a multinomial per shard is distributed, so no task needs to know the shards
    of any other part.
    """
    rng = np.random.default_rng([plan.seed, 1, part])
    left = drawn.copy()
    for k in range(shards):
        n = int(min(plan.shard_slots, left.sum()))
        taken = left.copy() if k == shards - 1 or not n else rng.multivariate_hypergeometric(left, n, method="marginals")
        left -= taken
        yield taken


def mix(documents: DataFrame, targets: DataFrame, plan: Plan = Plan()) -> tuple[DataFrame, DataFrame]:
    """(the mixture, the report).

    Mixture: shard, slot, source, repeat, block, n_tokens, tokens. Report: source, target_share, max_repeats, texts,
    tokens_available, tokens_wanted, tokens_reached, share_reached, most_uses, shortfall, for every source with a target.
    Tokens count the separators. No block, and so no text, is used more than max_repeats times; slots beyond that stay
    empty and are reported as shortfall. The report follows from sizes alone and reads no tokens. Defined results: null
    and empty texts, and sources without a target, are left out; a target whose source has no text falls short as a
    whole; null shares or repeats count as 0; shares are taken in relation to their sum; equal texts count once, under
    the smallest doc_id; other columns are ignored; empty inputs give an empty mixture.
    """
    spark = documents.sparkSession
    wanted = targets.groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("most")).filter("source IS NOT NULL")
    goal = [(r.source, float(r.share or 0.0), int(r.most or 0)) for r in wanted.orderBy("source").limit(MOST_SOURCES + 1).collect()]
    if len(goal) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources have a target")
    names = [g[0] for g in goal]
    tokenised = materialise(tokenise(documents.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi"), plan.tokenizer, plan.separator), "tokens")
    blocks, sizes = pack(tokenised, plan)
    have = {r.source: r for r in sizes.collect()}  # bounded by the targets
    tokens = [int(have[s].tokens or 0) if s in have else 0 for s in names]
    total = plan.tokens if plan.tokens is not None else sum(tokens)
    slots = -(-total // plan.block)
    shares = np.array([max(0.0, g[1]) for g in goal])
    shares = shares / shares.sum() if shares.sum() else shares
    starts, first, drawn = draw_parts(slots, shares, plan)
    room = [int(have[s].blocks) if s in have else 0 for s in names]
    most = [g[2] for g in goal]
    shared = spark.sparkContext.broadcast((starts, first, drawn))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts, first, drawn = shared.value
        for b in batches:
            for part in b["id"].tolist():
                at = first[part].copy()
                shards = range(int(starts[part]), int(starts[part + 1]))
                for shard, counts in zip(shards, shard_counts(drawn[part], len(shards), plan, part), strict=True):
                    if len(out := _slots(shard, at, counts, names, room, most, tokens, plan)):
                        yield out
                    at += counts

    parts = len(starts) - 1
    slot_rows = spark.range(parts, numPartitions=min(parts, max(1, 4 * spark.sparkContext.defaultParallelism))).mapInPandas(
        fill, "shard long, slot int, source string, repeat int, block long, n_tokens int"
    )
    mixture = slot_rows.drop("n_tokens").join(blocks, ["source", "block"]).select("shard", "slot", "source", "repeat", "block", "n_tokens", "tokens")
    used = slot_rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens_reached"), (F.max("repeat") + 1).alias("most_uses"))
    facts = spark.createDataFrame(
        [(s, float(p), m, int(have[s].texts) if s in have else 0, n, float(p * total)) for (s, _, m), p, n in zip(goal, shares.tolist(), tokens, strict=True)],
        "source string, target_share double, max_repeats int, texts long, tokens_available long, tokens_wanted double",
    )
    reached = F.coalesce("tokens_reached", F.lit(0)).cast("long")
    report = facts.join(F.broadcast(used), "source", "left")  # one row per source with a target
    whole = Window.partitionBy(F.lit(1))  # as above
    report = report.select(
        "source", "target_share", "max_repeats", "texts", "tokens_available", "tokens_wanted", reached.alias("tokens_reached"),
        F.coalesce(reached / F.nullif(F.sum(reached).over(whole), F.lit(0)), F.lit(0.0)).alias("share_reached"),
        F.coalesce("most_uses", F.lit(0)).cast("int").alias("most_uses"),
        F.greatest(F.lit(0.0), F.col("tokens_wanted") - reached).alias("shortfall"),
    )
    return mixture, report


def _slots(shard: int, first: np.ndarray, counts: np.ndarray, names: list[str], room: list[int], most: list[int], tokens: list[int], plan: Plan) -> pd.DataFrame:
    """The slots of one shard, in a random order: source, repetition, block and the tokens of the block."""
    parts = []
    for k, source in enumerate(names):
        j = first[k] + np.arange(counts[k])
        j = j[j < room[k] * most[k]]
        if not len(j):
            continue
        repeat = j // room[k]
        block = np.empty(len(j), dtype=np.int64)
        for e in np.unique(repeat).tolist():
            at = repeat == e
            block[at] = permute(j[at] % room[k], room[k], plan.seed * 1_000_003 + k * 1009 + e)
        n = np.where(block == room[k] - 1, tokens[k] - (room[k] - 1) * plan.block, plan.block)
        parts.append(pd.DataFrame({"source": source, "repeat": repeat.astype(np.int32), "block": block, "n_tokens": n.astype(np.int32)}))
    if not parts:
        return pd.DataFrame()
    out = pd.concat(parts, ignore_index=True)
    out.insert(0, "shard", np.int64(shard))
    out.insert(1, "slot", np.random.default_rng([plan.seed, 2, shard]).permutation(len(out)).astype(np.int32))
    return out
