"""Mapping of freely typed labels to a canonical list, with unmatched labels reported.

Distinct labels are folded and cut into tokens; every distinct token that is not in the reference vocabulary is joined
to it by edit distance (over letters, Korean syllables taken apart) or as an abbreviation; the repaired tokens are
combined with soft TF-IDF to rank complete entries. Joins by edit distance are equi-joins on prefixes of sorted letters,
which lose no pair within the distance, followed by the exact distance over whole batches of pairs.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.folding import fold
from ledgerloom.session import materialise, small

#: Tokens that decorate a label (numbering, remarks); they weigh nothing unless the reference list uses them. More are
#: learnt: tokens that stand beside the complete words of entries of at least LEARNT_FIELDS different fields.
LEARNT_FIELDS = 5
DECORATION = frozenset("no nr final draft as stated value see note old 합계 확정 값 비고 참고 최종 재확인".split())
#: Least similarity of a repaired token, least score of an entry, and least similarity of the letters of whole labels.
TOKEN_SIMILARITY = 0.6
DECORATION_SIMILARITY = 0.7
ENTRY_SCORE = 0.6
WHOLE_SIMILARITY = 0.74
#: Similarity of an abbreviation that is a prefix, or only a subsequence, of its word, or is so but for one character.
PREFIX, SKIPPED, SLIPPED = 0.92, 0.86, 0.72

_TOKEN = re.compile(r"[a-z0-9]*[a-z][a-z0-9]*|[0-9]+|[가-힣]+|[^\W_]+")
_NUMBERING = re.compile(r"(?<![^\s(*-])(?:no\.?\s*\d+\b|\d+\s*[).](?!\d))")


def letters(text: str) -> str:
    """Korean syllables taken apart into letters, everything else as it is."""
    return unicodedata.normalize("NFD", text)


def tokens(label: str) -> list[str]:
    """Tokens of a label in plain lower-case form, without numbering; letters and digits of one word stay together."""
    return _TOKEN.findall(_NUMBERING.sub(" ", fold(label).lower()))


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with adjacent transpositions, or most + 1 once it is exceeded."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, last[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


# Characters that scanners and typists confuse within words.
CONFUSED = str.maketrans("01358$", "olesbs")
CONFUSED_PAIRS = (("rn", "m"), ("ri", "n"), ("cl", "d"), ("vv", "w"))


def unconfused(token: str) -> str:
    """A longer word with digits among its letters, read as letters."""
    return token.translate(CONFUSED) if len(token) > 3 and not token.isalpha() and sum(map(str.isdigit, token)) <= 2 else token


def decorates(token: str, decorations: frozenset[str] = DECORATION) -> float:
    """1 for a decoration, its similarity for one mistyped, else 0."""
    if token in decorations:
        return 1.0
    return max((x for d in decorations if len(token) > 1 and len(d) > 1 and (x := similarity(token, d)) >= DECORATION_SIMILARITY), default=0.0)


def similarity(a: str, b: str) -> float:
    """1 minus edits per letter, at least TOKEN_SIMILARITY, else 0."""
    x, y = letters(a), letters(b)
    size = max(len(x), len(y))
    most = int((1 - TOKEN_SIMILARITY) * size)
    d = edits(x, y, most)
    return 1 - d / size if d <= most else 0.0


def abbreviates(short: str, word: str) -> float:
    """Similarity of an abbreviation: same first letter, its letters occur in order in the word."""
    if not (2 <= len(short) < len(word)) or short[0] != word[0] or not short.isalpha() or not short.isascii():
        return 0.0
    if word.startswith(short):
        return PREFIX
    if _skips(short, word):
        return SKIPPED
    slips = (short[:i] + short[i + 1 :] for i in range(1, len(short)))
    return SLIPPED if len(short) >= 4 and any(_skips(x, word) for x in slips) else 0.0


def _skips(short: str, word: str) -> bool:
    rest = iter(word)
    return all(c in rest for c in short)


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """Edit distances with adjacent transpositions of pairs of strings, all pairs in step."""
    out = np.zeros(len(a), dtype=np.int32)
    sizes = np.array([[len(x), len(y)] for x, y in zip(a, b, strict=True)], dtype=np.int64).reshape(-1, 2)
    order = np.lexsort((sizes[:, 1], sizes[:, 0]))
    at = 0
    while at < len(order):
        # Pairs of similar length come together, and fewer of them the longer they are.
        take = max(1, min(4096, 2_000_000 // (int(sizes[order[at:at + 4096]].max()) + 1)))
        part = order[at : at + take]
        at += take
        out[part] = _distances([a[i] for i in part], [b[i] for i in part], sizes[part])
    return out


def _codes(texts: list[str], width: int) -> np.ndarray:
    out = np.zeros((width, len(texts)), dtype=np.uint32)
    for k, t in enumerate(texts):
        out[: len(t), k] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return out


def _distances(a: list[str], b: list[str], sizes: np.ndarray) -> np.ndarray:
    high, wide = (int(x) for x in sizes.max(axis=0))
    x, y = _codes(a, high), _codes(b, wide)
    columns = np.arange(len(a))
    out = sizes[:, 1].astype(np.int32)  # of empty first strings
    last = row = np.repeat(np.arange(wide + 1, dtype=np.int32)[:, None], len(a), axis=1)
    for i in range(1, high + 1):
        before, last, row = last, row, np.empty_like(row)
        row[0] = i
        for j in range(1, wide + 1):
            best = np.minimum(np.minimum(last[j], row[j - 1]) + 1, last[j - 1] + (x[i - 1] != y[j - 1]))
            if i > 1 and j > 1:
                swapped = (x[i - 1] == y[j - 2]) & (x[i - 2] == y[j - 1])
                best = np.where(swapped, np.minimum(best, before[j - 2] + 1), best)
            row[j] = best
        done = sizes[:, 0] == i
        out[done] = row[sizes[done, 1], columns[done]]
    return out


#: Letters from rare to frequent, so that prefixes hold rare ones; any fixed order is right.
_RARE = {c: i for i, c in enumerate("zqxjkvbpygfwmucldrhsnioate")}


def prefix_keys(spelt: str, least: float) -> list[str]:
    """Keys of which two strings share one, if they are similar by at least least (1 minus edits per letter).

    Strings of n letters within distance d share n - d of them, counted with repetition; of such sets in one order, the
    first n - (n - d) + 1 cannot all differ.
    """
    seen: dict[str, int] = {}
    items = []
    for c in spelt:
        seen[c] = seen.get(c, 0) + 1
        items.append((-seen[c], _RARE.get(c, -1), c))
    items.sort()
    return [f"{c}{-k}" for k, _, c in items[: int((1 - least) * len(spelt)) + 1]]


def _squeezed(token: str) -> str:
    return re.sub(r"(.)\1+", r"\1", token)


def spellings(token: str) -> dict[str, float]:
    """What a token may have been before it was scanned or typed, with the share of similarity that is left."""
    plain = unconfused(token)
    return {plain: 1.0} | {plain.replace(a, b): 0.97 for a, b in CONFUSED_PAIRS if a in plain}


def _digits(text: str) -> str:
    return re.sub(r"\D", "", text)


def wholes(parts: list[tuple[str, bool, float]]) -> list[str]:
    """Letters of a whole label, of (token, in the vocabulary, decorates) parts: without decorations, and with those
    that the reference list uses as well."""
    spelt = [(t if known else unconfused(t), known, decor) for t, known, decor in parts]
    bare = letters("".join(t for t, _, decor in spelt if decor < 1))
    kept = letters("".join(t for t, known, decor in spelt if known or decor < 1))
    return sorted({bare, kept})


@dataclass
class Reference:
    """Entries of the canonical list, or one block of them, with their tokens, weights and letters."""

    entries: list[tuple[str, str]]  # (label, target)
    #: Entries of the whole list, and of them those that have each word; None where entries is the whole list.
    total: int | None = None
    counts: dict[str, int] | None = None
    words: list[list[str]] = field(default_factory=list)
    weight: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.words = [tokens(label) for label, _ in self.entries]
        total = len(self.entries) if self.total is None else self.total
        count: dict[str, int] = {}
        for words in self.words:
            for w in set(words):
                count[w] = count.get(w, 0) + 1
        self.weight = {w: math.log1p(total / (n if self.counts is None else self.counts[w])) for w, n in count.items()}
        self.most = math.log1p(total)
        self.norm = [math.sqrt(sum(self.weight[w] ** 2 for w in words)) for words in self.words]
        self.whole = [letters("".join(words)) for words in self.words]
        self.at = {e: k for k, e in enumerate(self.entries)}
        self.holders: dict[str, list[int]] = {}
        for k, words in enumerate(self.words):
            for w in set(words):
                self.holders.setdefault(w, []).append(k)

    def repair(self, token: str) -> list[tuple[str, float]]:
        """Words of the vocabulary that a token may stand for, with similarities; tokens with digits must be exact, but
        for a character typed twice. This is the plain form of the join, one word after the other."""
        if token in self.weight:
            return [(token, 1.0)]
        found = {w: s for w in self.weight if (s := token_similarity(token, w))}
        return sorted(found.items(), key=lambda x: (-x[1], x[0]))

    def rank(
        self, parts: list[tuple[str, list[tuple[str, float]]]], decor: list[float] | None = None, known: list[bool] | None = None, alike: dict[int, float] | None = None
    ) -> list[tuple[float, int]]:
        """(score, entry) of all entries that share a repaired token, or whose letters are alike, best first.

        decor, known and alike (of entries) are what joins found; where they are not given, they are worked out here.
        """
        known = [t in self.weight for t, _ in parts] if known is None else known
        decor = [decorates(t) for t, _ in parts] if decor is None else decor
        weighing = [(t, dict(m), d) for (t, m), d in zip(parts, decor, strict=True) if m or not t.isdigit()]
        if not weighing:
            return []
        spelt = wholes([(t, k, d) for (t, _), k, d in zip(parts, known, decor, strict=True)])
        if alike is None:
            alike = {k: max(_alike(x, other) for x in spelt) for k, other in enumerate(self.whole)}
        digits = [next(w for w in m if not w.isalpha()) for _, m, _ in weighing if any(not w.isalpha() for w in m)]
        candidates = {k for _, m, _ in weighing for w in m for k in self.holders.get(w, ())} | {k for k, x in alike.items() if x}
        scored = []
        for k in candidates:
            words = self.words[k]
            if [w for w in words if not w.isalpha()] != digits and not any(_digits(x) == _digits(self.whole[k]) for x in spelt):
                continue
            free, dot, norm = list(words), 0.0, 0.0
            order = sorted(range(len(weighing)), key=lambda i: -max((weighing[i][1].get(w, 0.0) for w in words), default=0.0))
            for i in order:
                matches = weighing[i][1]
                best = max(free, key=lambda w: (matches.get(w, 0.0), w), default=None)
                s = matches.get(best, 0.0) if best is not None else 0.0
                if s:
                    free.remove(best)
                    dot += s * self.weight[best] ** 2
                    norm += self.weight[best] ** 2
                elif not weighing[i][2]:
                    norm += self.most**2
            score = dot / (self.norm[k] * math.sqrt(norm)) if norm else 0.0
            if free:  # an entry all of whose words are not there is not meant, unless the letters say so
                score *= 0.7
            scored.append((max(score, alike.get(k, 0.0)), k))
        return sorted(scored, key=lambda x: (-x[0], x[1]))


def token_similarity(token: str, word: str) -> float:
    """How well a token that is no word of the vocabulary stands for a word, 0 if it does not."""
    best = 0.9 if not token.isalpha() and _squeezed(word) == _squeezed(token) else 0.0
    for form, share in spellings(token).items():
        if form == word:
            best = max(best, 0.97)
        if form.isalpha() and word.isalpha():
            best = max(best, share * max(similarity(form, word), abbreviates(form, word)))
    return best


def _alike(whole: str, other: str) -> float:
    """Similarity of the letters of a whole label and an entry, in order and without spaces; digits must be equal."""
    size = max(len(whole), len(other))
    most = int((1 - WHOLE_SIMILARITY) * size)
    if size < 6 or _digits(whole) != _digits(other):
        return 0.0
    d = edits(whole, other, most)
    return 1 - d / size if d <= most else 0.0


def _token_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """token, form, share, key: where a token meets words: equal, equal but for doubled characters, same first letter of
    an abbreviation, or a shared prefix key."""
    for b in batches:
        rows = []
        for t in b["token"]:
            if not t.isalpha():
                rows.append((t, _squeezed(t), 0.9, f"~{_squeezed(t)}"))
            for form, share in spellings(t).items():
                rows.append((t, form, share, f"={form}"))
                if form.isalpha():
                    rows += [(t, form, share, k) for k in prefix_keys(letters(form), TOKEN_SIMILARITY)]
                    if form.isascii() and len(form) > 1:
                        rows.append((t, form, share, f"^{form[0]}"))
        yield pd.DataFrame(rows, columns=["token", "form", "share", "key"])


def _word_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for w in b["word"]:
            rows += [(w, f"~{_squeezed(w)}"), (w, f"={w}")]
            if w.isalpha():
                rows += [(w, k) for k in prefix_keys(letters(w), TOKEN_SIMILARITY)]
                if len(w) > 2:
                    rows.append((w, f"^{w[0]}"))
        yield pd.DataFrame(rows, columns=["word", "key"])


def _pair_similarity(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """similarity of (token, form, share, word) pairs: that of token_similarity, over whole batches."""
    for b in batches:
        form, word, token = b["form"].tolist(), b["word"].tolist(), b["token"].tolist()
        x, y = [letters(f) for f in form], [letters(w) for w in word]
        size = np.array([max(len(p), len(q)) for p, q in zip(x, y, strict=True)], dtype=float)
        both = np.array([f.isalpha() and w.isalpha() for f, w in zip(form, word, strict=True)], dtype=bool)
        near = both & (np.abs(np.array([len(p) - len(q) for p, q in zip(x, y, strict=True)])) <= np.floor((1 - TOKEN_SIMILARITY) * size))
        best = np.zeros(len(b))
        at = np.flatnonzero(near)
        if len(at):
            d = distances([x[i] for i in at], [y[i] for i in at])
            best[at] = np.where(d <= np.floor((1 - TOKEN_SIMILARITY) * size[at]), 1 - d / size[at], 0.0)
        short = np.array([abbreviates(f, w) if z else 0.0 for f, w, z in zip(form, word, both, strict=True)])
        best = np.maximum(best, short) * b["share"].to_numpy()
        equal = np.array([0.97 if f == w and f in spellings(t) else 0.0 for f, w, t in zip(form, word, token, strict=True)])
        doubled = np.array([0.9 if not t.isalpha() and _squeezed(w) == _squeezed(t) else 0.0 for w, t in zip(word, token, strict=True)])
        out = pd.DataFrame({"token": token, "word": word, "similarity": np.maximum(np.maximum(best, equal), doubled)})
        yield out[out["similarity"] > 0]


def _joined_tokens(unknown: DataFrame, words: DataFrame) -> DataFrame:
    """token, word, similarity of every token that is no word of the list, and every word it may stand for."""
    tasks = int(unknown.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = small(words.select("word").distinct().mapInPandas(_word_keys, "word string, key string"))
    pairs = unknown.select("token").mapInPandas(_token_keys, "token string, form string, share double, key string").join(keys, "key")
    pairs = pairs.select("token", "form", "share", "word").distinct().repartition(tasks, "token", "word")
    found = pairs.mapInPandas(_pair_similarity, "token string, word string, similarity double")
    return found.groupBy("token", "word").agg(F.max("similarity").alias("similarity"))


def _labels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"raw_label": b["raw_label"], "tokens": [tokens(x) for x in b["raw_label"]]})


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        words = [tokens(x) for x in b["label"]]
        yield pd.DataFrame({"label": b["label"], "field": b["field"], "words": words, "whole": [letters("".join(w)) for w in words]})


def learnt_decorations(labels: DataFrame, entries: DataFrame, counts: DataFrame) -> DataFrame:
    """word: tokens that stand, with two others at most, beside all the words of entries of LEARNT_FIELDS fields.

    An entry meets the labels that have its rarest word; labels that repeat a token are left out of account.
    """
    rare = (
        entries.select("label", "field", "words", F.explode("words").alias("word")).join(counts, "word")
        .groupBy("label", "field").agg(F.min_by("word", F.struct("n", "word")).alias("token"), F.any_value("words").alias("words"))
    )
    met = labels.select("tokens", F.explode(F.array_distinct("tokens")).alias("token")).join(small(rare), "token")
    rest = F.array_except("tokens", "words")
    beside = (F.size(F.array_except("words", "tokens")) == 0) & (F.size("tokens") == F.size("words") + F.size(rest)) & F.size(rest).between(1, 3)
    pairs = met.filter(beside).select(F.explode(rest).alias("word"), "field").distinct()
    return pairs.groupBy("word").agg(F.count("*").alias("fields")).filter(F.col("fields") >= LEARNT_FIELDS).select("word")


def _whole_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for label, parts in zip(b["raw_label"], b["parts"], strict=True):
            for whole in wholes([(p["token"], p["known"], p["decor"]) for p in parts]):
                rows += [(label, whole, f"{_digits(whole)}|{k}") for k in prefix_keys(whole, WHOLE_SIMILARITY)]
        yield pd.DataFrame(rows, columns=["raw_label", "spelt", "key"])


def _entry_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(label, f, w, f"{_digits(w)}|{k}") for label, f, w in zip(b["label"], b["field"], b["whole"], strict=True) for k in prefix_keys(w, WHOLE_SIMILARITY)]
        yield pd.DataFrame(rows, columns=["label", "field", "whole", "key"])


def _pair_alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """alike of (raw_label, spelt, label, field, whole) pairs of equal digits: that of _alike, over whole batches."""
    for b in batches:
        d = distances(b["spelt"].tolist(), b["whole"].tolist())
        size = np.maximum(b["spelt"].str.len(), b["whole"].str.len()).to_numpy()
        good = (d <= np.floor((1 - WHOLE_SIMILARITY) * size)) & (size >= 6)
        out = b[["raw_label", "label", "field"]].assign(alike=1 - d / np.maximum(size, 1))
        yield out[good]


def _alike_entries(labels: DataFrame, entries: DataFrame) -> DataFrame:
    """raw_label, label, field, alike of every label and entry whose letters are alike."""
    tasks = int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = small(entries.select("label", "field", "whole").mapInPandas(_entry_keys, "label string, field string, whole string, key string"))
    pairs = labels.select("raw_label", "parts").mapInPandas(_whole_keys, "raw_label string, spelt string, key string").join(keys, "key").drop("key")
    m, n = F.length("spelt"), F.length("whole")
    close = F.abs(m - n) <= F.floor((1 - WHOLE_SIMILARITY) * F.greatest(m, n))
    pairs = pairs.filter(close).distinct().repartition(tasks, "raw_label", "label")
    found = pairs.mapInPandas(_pair_alike, "raw_label string, label string, field string, alike double")
    return found.groupBy("raw_label", "label", "field").agg(F.max("alike").alias("alike"))


#: Entries of the reference list that a task holds at a time; a longer list is ranked in blocks, and the best taken.
BLOCK_ENTRIES = 20_000


def map_labels(candidates: DataFrame, reference: DataFrame, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """raw_label, field, score for every distinct label typed freely (records whose field is null).

    field is null for labels that stand for none of the reference, which has label and field. Defined results: null
    labels and labels without letters or digits are unmatched with a null score; equal scores fall to the first entry in
    order of (label, field); repeated rows count once; very long labels are read whole; other columns are ignored; an
    empty input or an empty reference matches nothing. The result does not depend on block_entries.
    """
    spark = candidates.sparkSession
    # Few bytes, but much work each: the number of tasks is fixed, so that adaptive execution doesn't merge them.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = reference.select("label", "field").dropna().distinct()
    entries = materialise(listed.mapInPandas(_entries, "label string, field string, words array<string>, whole string"), "entries")
    total = entries.count()
    spread = entries.select("label", "field", F.explode(F.array_distinct("words")).alias("word"))
    counts = spread.groupBy("word").agg(F.count("*").alias("n"))
    distinct = candidates.filter("field IS NULL AND raw_label IS NOT NULL").select("raw_label").distinct()
    labels = materialise(distinct.repartition(tasks, "raw_label").mapInPandas(_labels, "raw_label string, tokens array<string>"), "labels")
    seed = spark.createDataFrame([(w,) for w in sorted(DECORATION)], "word string")
    decorations = seed.unionByName(learnt_decorations(labels, entries, counts)).distinct()

    # A token meets the words of the list and the decorations once, however many labels have it.
    vocabulary = small(counts.select(F.col("word").alias("token"), F.lit(True).alias("known")))
    every = labels.select(F.explode("tokens").alias("token")).distinct().join(vocabulary, "token", "left")
    words = counts.select("word", F.lit(True).alias("listed")).join(decorations.withColumn("decorates", F.lit(True)), "word", "full")
    words = materialise(words.select("word", F.coalesce("listed", F.lit(False)).alias("listed"), F.coalesce("decorates", F.lit(False)).alias("decorates")), "vocabulary")
    near = _joined_tokens(every.select("token"), words).join(small(words), "word")
    pair = F.struct("word", "similarity")
    long_enough = (F.length("token") > 1) & (F.length("word") > 1) & (F.col("similarity") >= DECORATION_SIMILARITY)
    plain = F.col("word") == F.col("token")
    matches = near.groupBy("token").agg(
        F.collect_list(F.when(F.col("listed"), pair)).alias("words"),
        F.max(F.when(F.col("decorates"), F.when(plain, 1.0).when(long_enough, F.least("similarity", F.lit(0.999))))).alias("decor"),
    )
    own = F.array(F.struct(F.col("token").alias("word"), F.lit(1.0).alias("similarity")))
    by_rank = F.sort_array(F.transform("words", lambda w: F.struct((-w["similarity"]).alias("s"), w["word"].alias("w"))))
    ordered = F.transform(by_rank, lambda w: F.struct(w["w"].alias("word"), (-w["s"]).alias("similarity")))
    none = F.array().cast("array<struct<word:string,similarity:double>>")
    judged = every.join(matches, "token", "left").select(
        "token", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("decor", F.lit(0.0)).alias("decor"),
        F.when(F.col("known"), own).otherwise(F.coalesce(ordered, none)).alias("words"),
    )
    parts = labels.select("raw_label", F.posexplode("tokens").alias("position", "token")).join(judged, "token")
    grouped = parts.groupBy("raw_label").agg(F.array_sort(F.collect_list(F.struct("position", "token", "known", "decor", "words"))).alias("parts"))
    # Hot tokens (in a third of all labels) are what adaptive execution splits; a label is one row again afterwards.
    spelt = materialise(grouped.repartition(tasks, "raw_label"), "spelt")
    alike = _alike_entries(spelt, entries).groupBy("raw_label").agg(F.collect_list(F.struct("label", "field", "alike")).alias("alike"))
    ready = spelt.join(alike, "raw_label", "left").repartition(tasks, "raw_label")
    if total <= block_entries:
        blocks = [entries]
    else:
        number = -(-total // block_entries)
        hashed = entries.withColumn("block", F.pmod(F.xxhash64("label", "field"), F.lit(number)))
        blocks = [hashed.filter(F.col("block") == k) for k in range(number)]
        ready = materialise(ready, "ready")
    ranked = [_ranked(ready, block, counts, total) for block in blocks]
    best = ranked[0]
    if len(ranked) > 1:
        every_block = ranked[0]
        for other in ranked[1:]:
            every_block = every_block.unionAll(other)
        order = F.when(F.col("score").isNotNull(), F.struct((-F.col("score")).alias("s"), "label", "target"))
        best = every_block.groupBy("raw_label").agg(F.min_by(F.struct("target", "score"), order).alias("b")).select("raw_label", "b.*")
    return best.select("raw_label", F.when(F.col("score") >= ENTRY_SCORE, F.col("target")).alias("field"), "score")


def _ranked(labels: DataFrame, block: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """raw_label, label, target, score of the best entry of a block, all null but raw_label where none shares anything."""
    rows = [(r.label, r.field) for r in block.select("label", "field").collect()]
    own = block.select(F.explode("words").alias("word")).distinct().join(counts, "word")
    shared = labels.sparkSession.sparkContext.broadcast((sorted(rows), total, {r.word: r.n for r in own.collect()}))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ref = Reference(*shared.value)
        for b in batches:
            rows = []
            for label, parts, alike in zip(b["raw_label"], b["parts"], b["alike"], strict=True):
                close: dict[int, float] = {}
                for x in alike if alike is not None else ():
                    if (k := ref.at.get((x["label"], x["field"]))) is not None:
                        close[k] = x["alike"]
                found = [(p["token"], [(w["word"], w["similarity"]) for w in p["words"]]) for p in parts]
                ranked = ref.rank(found, [p["decor"] for p in parts], [bool(p["known"]) for p in parts], close)
                rows.append((label, *ref.entries[ranked[0][1]], ranked[0][0]) if ranked else (label, None, None, None))
            yield pd.DataFrame(rows, columns=["raw_label", "label", "target", "score"])

    return labels.mapInPandas(decide, "raw_label string, label string, target string, score double")


def mapped_candidates(candidates: DataFrame, reference: DataFrame) -> DataFrame:
    """cand_id, field of every candidate without a field whose label stands for one, each once."""
    found = map_labels(candidates, reference).filter("field IS NOT NULL").select(F.col("raw_label").alias("#label"), F.col("field").alias("#field"))
    rows = candidates.filter("field IS NULL AND raw_label IS NOT NULL").select("cand_id", "raw_label").distinct()
    return rows.join(found, F.col("raw_label") == F.col("#label")).select("cand_id", F.col("#field").alias("field")).distinct()


def unmatched_labels(candidates: DataFrame, reference: DataFrame) -> DataFrame:
    """raw_label, score, records of every label that stands for no entry, with the number of its records."""
    labels = map_labels(candidates, reference).select(F.col("raw_label").alias("#label"), F.col("field").alias("#field"), "score")
    counts = candidates.filter("field IS NULL").groupBy("raw_label").agg(F.countDistinct("cand_id").alias("records"))
    joined = counts.join(labels, F.col("raw_label").eqNullSafe(F.col("#label")), "left")
    return joined.filter(F.col("#field").isNull()).select("raw_label", F.round("score", 6).alias("score"), "records")
