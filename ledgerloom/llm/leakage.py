"""Evaluation texts leaking into training text.

A generalised suffix automaton of the normalised test items is built and broadcast (one per set of items, where all are
more than a task should hold); every training text is streamed through it, tracking the longest matching length at each letter. Where that length reaches the limit, the items that
hold the last letters are known from the state. Texts that share no short run with any item at fixed steps, which a
long shared run cannot avoid, are passed over before streaming.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import discard, materialise

#: Letters and digits of a shared run that count as a leak.
RUN = 50
#: A text more than this share of which is leaked is dropped as a whole by remove_leaks; else the spans are cut out.
COVERAGE = 0.5
#: Letters of test items in one automaton, which the driver and every task hold (some 200 bytes each). More items are
#: cut into several sets, and every text is streamed through each.
SET_LETTERS = 500_000

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _letter_table() -> np.ndarray:
    """Code point -> code point of its lower-case letter or digit, 0 for everything else."""
    table = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
    for point in range(sys.maxunicode + 1):
        ch = chr(point)
        if ch.isalnum():
            table[point] = ord(ch.lower()[0])
    return table


_letters: np.ndarray | None = None


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(letters and digits in lower case as code points, their places in text)."""
    global _letters
    if _letters is None:
        _letters = _letter_table()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    plain = _letters[points]
    places = np.flatnonzero(plain)
    return plain[places], places


def window_hashes(points: np.ndarray, width: int, step: int) -> np.ndarray:
    """Polynomial hashes of windows of width letters at every step-th place."""
    count = (len(points) - width) // step + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    at = np.arange(count) * step
    out = np.zeros(count, dtype=np.uint64)
    for j in range(width):
        out = out * _BASE + points[at + j].astype(np.uint64) + np.uint64(1)
    return out


@dataclass
class Automaton:
    """A generalised suffix automaton in flat arrays, with the items that hold the last RUN letters of each state."""

    keys: np.ndarray  # state << 21 | letter
    targets: np.ndarray
    link: np.ndarray
    length: np.ndarray
    anchor: np.ndarray  # per state: the ancestor that stands for its last run letters, -1 if it is shorter
    starts: np.ndarray  # per state: items[starts[s]:starts[s + 1]] hold the run of anchor s
    items: np.ndarray
    hashes: np.ndarray  # of all windows of run // 2 letters of the items, sorted
    run: int


def build_automaton(texts: list[tuple[int, str]], run: int = RUN) -> Automaton:
    """The automaton of (item, text) pairs; an item may have several texts."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    strings = [(item, normalise(text)[0]) for item, text in texts]
    strings = [(item, s) for item, s in strings if len(s) >= run]
    for _, string in strings:
        last = 0
        for c in string.tolist():
            if c in step[last]:
                q = step[last][c]
                if length[q] == length[last] + 1:
                    last = q
                    continue
                clone = len(step)
                step.append(dict(step[q]))
                length.append(length[last] + 1)
                link.append(link[q])
                link[q] = clone
                p = last
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                last = clone
                continue
            fresh = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in step[p]:
                step[p][c] = fresh
                p = link[p]
            if p != -1:
                q = step[p][c]
                if length[q] == length[p] + 1:
                    link[fresh] = q
                else:
                    clone = len(step)
                    step.append(dict(step[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[fresh] = clone
                    while p != -1 and step[p].get(c) == q:
                        step[p][c] = clone
                        p = link[p]
            last = fresh
    anchor = [-1] * len(step)
    for s in sorted(range(1, len(step)), key=length.__getitem__):
        if length[s] >= run:
            anchor[s] = s if length[link[s]] < run else anchor[link[s]]
    holders: dict[int, set[int]] = {}
    hashes = []
    for item, string in strings:
        s = 0
        for i, c in enumerate(string.tolist(), 1):
            s = step[s][c]
            if i >= run:
                holders.setdefault(anchor[s], set()).add(item)
        hashes.append(window_hashes(string, run // 2, 1))
    keys = np.fromiter(((s << 21) | c for s, d in enumerate(step) for c in d), dtype=np.int64)
    targets = np.fromiter((t for d in step for t in d.values()), dtype=np.int32)
    sizes = np.zeros(len(step) + 1, dtype=np.int64)
    for s, held in holders.items():
        sizes[s + 1] = len(held)
    items = np.array([i for s in sorted(holders) for i in sorted(holders[s])], dtype=np.int64)
    every = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, dtype=np.uint64)
    return Automaton(
        keys, targets, np.array(link, np.int32), np.array(length, np.int32), np.array(anchor, np.int32), np.cumsum(sizes), items, every, run
    )


class Scanner:
    """Streams texts through an automaton held in plain lists and one dictionary."""

    def __init__(self, automaton: Automaton):
        self.a = automaton
        self.step = dict(zip(automaton.keys.tolist(), automaton.targets.tolist(), strict=True))
        self.link, self.length = automaton.link.tolist(), automaton.length.tolist()

    def may_match(self, texts: list[str]) -> np.ndarray:
        """False only where no run is shared: such a run holds a window of half its length at a multiple of that length.

        All texts are normalised and hashed together.
        """
        half = self.a.run // 2
        hit = np.zeros(len(texts), dtype=bool)
        points, places = normalise("".join(texts))
        ends = np.cumsum([len(t) for t in texts])
        counts = np.diff(np.searchsorted(places, ends), prepend=0)
        windows = np.maximum(0, counts - half) // half + (counts >= half)
        if not windows.sum() or not len(self.a.hashes):
            return hit
        owner = np.repeat(np.arange(len(texts)), windows)
        first = np.cumsum(counts) - counts
        at = first[owner] + half * (np.arange(len(owner)) - (np.cumsum(windows) - windows)[owner])
        found = np.zeros(len(at), dtype=np.uint64)
        for j in range(half):
            found = found * _BASE + points[at + j].astype(np.uint64) + np.uint64(1)
        near = np.minimum(np.searchsorted(self.a.hashes, found), len(self.a.hashes) - 1)
        hit[owner[self.a.hashes[near] == found]] = True
        return hit

    def scan(self, text: str) -> tuple[list[int], list[tuple[int, int]], int, int]:
        """(items leaked, spans of text as [begin, end), letters matched, letters) of one text."""
        points, places = normalise(text)
        step, link, length, run = self.step, self.link, self.length, self.a.run
        state = matched = 0
        states: set[int] = set()
        ends: list[tuple[int, int]] = []  # [first, last] letters
        for i, c in enumerate(points.tolist()):
            target = step.get((state << 21) | c)
            while target is None and state:
                state = link[state]
                matched = length[state]
                target = step.get((state << 21) | c)
            if target is None:
                matched = 0
                continue
            state = target
            matched += 1
            if matched >= run:
                states.add(state)
                if ends and i - matched + 1 <= ends[-1][1] + 1:
                    ends[-1] = (min(ends[-1][0], i - matched + 1), i)
                else:
                    ends.append((i - matched + 1, i))
        a = self.a
        held = {int(a.anchor[s]) for s in states}
        items = sorted({int(x) for s in held for x in a.items[a.starts[s] : a.starts[s + 1]]})
        spans = [(int(places[b]), int(places[e]) + 1) for b, e in ends]
        return items, spans, sum(e - b + 1 for b, e in ends), len(points)


def _parts(batch: pd.DataFrame, most: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Parts of a batch of about most characters each, so that memory doesn't grow with the length of texts."""
    group = batch["text"].str.len().cumsum().floordiv(most)
    for _, part in batch.groupby(group, sort=False):
        yield part


SCAN_SCHEMA = "doc_id long, text string, items array<long>, spans array<struct<begin:int,end:int>>, matched long, letters long"


def _pieces(run: int, most: int):
    """item_id, piece, size: texts of items as letters and digits, in pieces of at most most that overlap by run - 1, so
    that every run lies within one."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for item, text in zip(b["item_id"], b["t"], strict=True):
                plain = normalise(text)[0].tobytes().decode("utf-32-le", "surrogatepass")
                for start in range(0, max(1, len(plain) - run + 1), most - run + 1):
                    if len(piece := plain[start : start + most]) >= run:
                        rows.append((item, piece, len(piece)))
            if rows:
                yield pd.DataFrame(rows, columns=["item_id", "piece", "size"])

    return cut


def _sets(items: DataFrame, run: int, most: int) -> Iterator[list[tuple[int, str]]]:
    """The items in sets of about most letters; one set reaches the driver at a time."""
    rows = items.select("item_id", F.explode(F.array("query", "passage")).alias("t")).filter("t IS NOT NULL")
    pieces = rows.mapInPandas(_pieces(run, max(2 * run, most // 4)), "item_id long, piece string, size int")
    total = pieces.agg(F.sum("size")).first()[0] or 0
    count = max(1, -(-total // most))
    if count > 1:
        pieces = written = materialise(pieces.withColumn("s", F.pmod(F.xxhash64("piece"), F.lit(count))), "items")
    for k in range(count):
        part = pieces if count == 1 else pieces.filter(F.col("s") == k)
        yield [(r.item_id, r.piece) for r in part.orderBy("item_id", "piece").collect()]
    if count > 1:
        discard(written)


def _scan_set(documents: DataFrame, automaton: Automaton) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(automaton)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(shared.value)
        for b in batches:
            out = []
            for part in _parts(b):
                texts = part["text"].tolist()
                for i in np.flatnonzero(scanner.may_match(texts)).tolist():
                    found, spans, matched, letters = scanner.scan(texts[i])
                    if found:
                        out.append((part["doc_id"].iat[i], texts[i], found, [{"begin": s, "end": e} for s, e in spans], matched, letters))
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "text", "items", "spans", "matched", "letters"])

    return documents.select("doc_id", "text").filter("text IS NOT NULL").mapInPandas(scan, SCAN_SCHEMA)


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spans of several sets joined where they overlap or touch, and the letters within them counted again."""
    for b in batches:
        rows = []
        for doc_id, text, items, spans, letters in zip(b["doc_id"], b["text"], b["items"], b["spans"], b["letters"], strict=True):
            places = normalise(text)[1]
            found: list[list[int]] = []  # [first, last] letters
            for s in sorted(spans, key=lambda s: s["begin"]):
                first, last = (int(x) for x in np.searchsorted(places, (s["begin"], s["end"])))
                if found and first <= found[-1][1]:
                    found[-1][1] = max(found[-1][1], last)
                else:
                    found.append([first, last])
            merged = [{"begin": int(places[f]), "end": int(places[e - 1]) + 1} for f, e in found]
            rows.append((doc_id, text, sorted(items), merged, sum(e - f for f, e in found), letters))
        yield pd.DataFrame(rows, columns=["doc_id", "text", "items", "spans", "matched", "letters"])


def _scans(documents: DataFrame, items: DataFrame, run: int, set_letters: int) -> list[DataFrame]:
    return [_scan_set(documents, build_automaton(part, run)) for part in _sets(items, run, set_letters)]


def scan_leaks(documents: DataFrame, items: DataFrame, run: int = RUN, set_letters: int = SET_LETTERS) -> DataFrame:
    """doc_id, text, items (leaked), spans, matched and letters of every document that leaks.

    items need item_id, query, passage. One scan and one map per set of items of set_letters letters; what several sets
    find in a text is joined, so that the result does not depend on the sets. Defined results: null and empty texts, and
    items of fewer than run letters, match nothing; repeated texts are reported under each id, and repeated rows once;
    texts of any length are streamed whole; other columns are ignored; an empty input gives an empty result.
    """
    scans = _scans(documents, items, run, set_letters)
    if len(scans) == 1:
        return scans[0].dropDuplicates(["doc_id", "text"])
    joined = reduce(DataFrame.unionAll, scans).groupBy("doc_id", "text").agg(
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"), F.max("letters").alias("letters")
    )  # a row per set at most, but for repeated rows
    return joined.mapInPandas(_merge, SCAN_SCHEMA)


def leaked_items(documents: DataFrame, items: DataFrame, run: int = RUN, set_letters: int = SET_LETTERS) -> DataFrame:
    """doc_id, item_id of every document and test item that share a run, each once; no text is moved."""
    every = reduce(DataFrame.unionAll, _scans(documents, items, run, set_letters))
    return every.select("doc_id", F.explode("items").alias("item_id")).distinct()


def remove_leaks(documents: DataFrame, items: DataFrame, run: int = RUN, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, text, matched, letters, action of every document that leaks: spans cut out, or a null text where too much leaks."""
    found = scan_leaks(documents, items, run)
    share = F.col("matched") / F.col("letters")
    kept = F.expr(
        "concat(substring(text, 1, spans[0].begin), array_join(transform(spans, (s, i) -> "
        "substring(text, s.end + 1, coalesce(get(spans, i + 1).begin, length(text)) - s.end)), ''))"
    )
    return found.select(
        "doc_id", F.when(share <= coverage, kept).alias("text"), "matched", "letters",
        F.when(share <= coverage, "cut").otherwise("drop").alias("action"),
    )
