"""Visually identical text with different characters: one consistent form for every text, with the changed ones named.

Arrow text is copied once per batch into a numpy array of code points; tables indexed by code point are gathered,
characters are expanded by offsets, marks are composed and look-alike letters are replaced inside their words, all
vectorially: no string call per row.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.folding import ARMENIAN_LOOKS, CHEROKEE_LOOKS, COPTIC_LOOKS, CYRILLIC_LOOKS, GREEK_LOOKS, is_invisible

POINTS = sys.maxunicode + 1
#: Decompositions that only change width or shape. Super- and subscripts, fractions and circled signs look different.
SHAPE_TAGS = ("<wide>", "<narrow>", "<font>", "<square>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>")
LATIN, GREEK, CYRILLIC, ARMENIAN, CHEROKEE, COPTIC = 1, 2, 3, 4, 5, 6
SCRIPTS = {"LATIN": LATIN, "GREEK": GREEK, "CYRILLIC": CYRILLIC}


def _plain_of(ch: str) -> str | None:
    """What a single character becomes, or None where it stays."""
    if is_invisible(ch):
        return ""
    category = unicodedata.category(ch)
    if category == "Zs":
        return None if ch == " " else " "
    composed = unicodedata.normalize("NFC", ch)
    if composed != ch:
        return composed
    decomposition = unicodedata.decomposition(ch)
    if not decomposition.startswith("<"):
        return None
    tag = decomposition.split()[0]
    plain = unicodedata.normalize("NFKC", ch)
    if tag in SHAPE_TAGS and " " not in plain:
        return plain
    # Ligatures, Roman numerals and the like: compatibility forms that stand for ASCII letters.
    if tag == "<compat>" and plain.isascii() and plain.replace(".", "").isalnum() and unicodedata.category(ch) != "No":
        return plain
    return None


class Tables:
    """Lookup tables by code point: replacement, canonical class, script and word membership."""

    def __init__(self) -> None:
        self.flag = np.zeros(POINTS, dtype=bool)  # the row needs work
        self.has = np.zeros(POINTS, dtype=bool)  # it expands: to the pieces of its plain form
        self.length = np.ones(POINTS, dtype=np.int32)
        self.start = np.zeros(POINTS, dtype=np.int64)
        self.ccc = np.zeros(POINTS, dtype=np.uint8)
        self.word = np.zeros(POINTS, dtype=bool)
        self.script = np.zeros(POINTS, dtype=np.uint8)
        self.mark = np.zeros(POINTS, dtype=bool)  # may compose with what stands before
        out: list[int] = []
        pairs: dict[int, int] = {}
        for point in range(POINTS):
            if 0xAC00 <= point <= 0xD7A3 or 0xD800 <= point <= 0xDFFF or 0x4E00 <= point <= 0x9FFF:
                self.word[point] = True
                continue
            ch = chr(point)
            category = unicodedata.category(ch)
            if category in ("Cn", "Co"):
                continue
            self.word[point] = category[0] in "LMN"
            self.ccc[point] = unicodedata.combining(ch)
            plain = _plain_of(ch)
            self.flag[point] = plain is not None
            pieces = unicodedata.normalize("NFD", ch if plain is None else plain)
            if pieces != ch:
                self.has[point] = True
                self.start[point] = len(out)
                self.length[point] = len(pieces)
                out.extend(map(ord, pieces))
            if category[0] == "L" and point < 0x2000 or 0x1E00 <= point <= 0x1FFF or 0x2C60 <= point <= 0x2C7F:
                name = unicodedata.name(ch, "")
                self.script[point] = SCRIPTS.get(name.split(" ")[0], 0)
            parts = unicodedata.decomposition(ch).split()
            if len(parts) == 2 and parts[0][0] != "<":
                first, second = (int(p, 16) for p in parts)
                if unicodedata.normalize("NFC", chr(first) + chr(second)) == ch:
                    pairs[(first << 21) | second] = point
                    self.mark[second] = True
        self.mark |= self.ccc > 0
        self.out = np.array(out, dtype=np.uint32)
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.composed = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.uint32)
        self.mark[0x1161:0x1176] = True
        self.mark[0x11A8:0x11C3] = True
        self.flag |= self.mark
        self.to_latin = np.zeros(POINTS, dtype=np.uint32)
        self.to_other = {GREEK: np.zeros(POINTS, dtype=np.uint32), CYRILLIC: np.zeros(POINTS, dtype=np.uint32)}
        for script, looks in ((CYRILLIC, CYRILLIC_LOOKS), (GREEK, GREEK_LOOKS)):
            for other, latin in looks.items():
                self.to_latin[ord(other)] = ord(latin)
                self.to_other[script][ord(latin)] = ord(other)
        # Of rarer scripts only the letters that look like a Latin one take part, in words with Latin letters.
        for script, looks in ((ARMENIAN, ARMENIAN_LOOKS), (CHEROKEE, CHEROKEE_LOOKS), (COPTIC, COPTIC_LOOKS)):
            for other, latin in looks.items():
                self.to_latin[ord(other)] = ord(latin)
                self.script[ord(other)] = script
        self.flag |= self.script > LATIN


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def _compose(points: np.ndarray, row: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order and composition of marks and conjoining letters, within rows."""
    ccc = t.ccc[points]
    if ((ccc[:-1] > ccc[1:]) & (ccc[1:] > 0) & (row[:-1] == row[1:])).any():
        # Canonical order: a stable sort by class behind each starter, however long its run of marks is.
        run = np.cumsum((ccc == 0) | np.concatenate(([True], row[1:] != row[:-1])))
        order = np.lexsort((ccc, run))
        points, ccc = points[order], ccc[order]
    while len(points) > 1:
        at = np.arange(len(points))
        starter = np.maximum.accumulate(np.where(ccc == 0, at, -1))
        before = np.concatenate(([-1], starter[:-1]))  # the starter before each character
        previous = np.concatenate(([0], ccc[:-1])).astype(np.int16)
        open_ = t.mark[points] & (before >= 0)
        open_ &= row[np.maximum(before, 0)] == row
        open_ &= (before == at - 1) | ((previous != 0) & (previous < ccc))
        where = np.flatnonzero(open_)
        if not len(where):
            break
        base, mark = points[before[where]].astype(np.int64), points[where].astype(np.int64)
        result = np.zeros(len(where), dtype=np.uint32)
        found = np.searchsorted(t.keys, (base << 21) | mark)
        found = np.minimum(found, len(t.keys) - 1)
        hit = t.keys[found] == (base << 21) | mark
        result[hit] = t.composed[found[hit]]
        lead, vowel = base - 0x1100, mark - 0x1161
        jamo = (lead >= 0) & (lead < 19) & (vowel >= 0) & (vowel < 21)
        result[jamo] = (0xAC00 + (lead * 21 + vowel) * 28)[jamo]
        syllable, tail = base - 0xAC00, mark - 0x11A7
        closed = (syllable >= 0) & (syllable < 11172) & (syllable % 28 == 0) & (tail > 0) & (tail < 28)
        result[closed] = (base + tail)[closed]
        ok = result > 0
        where, result = where[ok], result[ok]
        if not len(where):
            break
        target = before[where]
        first = np.concatenate(([True], target[1:] != target[:-1]))
        where, result, target = where[first], result[first], target[first]
        points[target] = result
        keep = np.ones(len(points), dtype=bool)
        keep[where] = False
        points, row = points[keep], row[keep]
        ccc = t.ccc[points]
    return points, row


def _unmix(points: np.ndarray, row: np.ndarray, t: Tables) -> np.ndarray:
    """Replace letters of another script inside a word: by Latin ones if all of them have one, else the Latin
    letters by the other script's where that has most of the word."""
    script = t.script[points]
    if not (script > LATIN).any():
        return points
    inside = t.word[points]
    starts = inside & np.concatenate(([True], ~inside[:-1] | (row[1:] != row[:-1])))
    word = np.cumsum(starts) - 1
    count = int(word[-1]) + 1 if len(word) else 0
    if count == 0:
        return points
    member = np.flatnonzero(inside)
    ids = word[member]

    def per_word(mask: np.ndarray) -> np.ndarray:
        return np.bincount(ids, weights=mask[member], minlength=count)

    latin = per_word(script == LATIN)
    foreign = per_word(script > LATIN)
    to_latin = t.to_latin[points]
    mixed = (latin > 0) & (foreign > 0)
    greek, cyrillic = per_word(script == GREEK), per_word(script == CYRILLIC)
    all_latin = mixed & (per_word((script > LATIN) & (to_latin > 0)) == foreign)
    out = points.copy()
    change = np.zeros(len(points), dtype=bool)
    change[member] = all_latin[ids]
    change &= (script > LATIN) & (to_latin > 0)
    out[change] = to_latin[change]
    for other, own in ((CYRILLIC, cyrillic), (GREEK, greek)):
        table = t.to_other[other][points]
        rest = mixed & ~all_latin & (own == foreign) & (own > latin) & (per_word((script == LATIN) & (table > 0)) == latin)
        change = np.zeros(len(points), dtype=bool)
        change[member] = rest[ids]
        change &= (script == LATIN) & (table > 0)
        out[change] = table[change]
    both = ~mixed & (greek > 0) & (cyrillic > 0) & (greek + cyrillic == foreign) & (per_word((script > LATIN) & (to_latin > 0)) == foreign)
    change = np.zeros(len(points), dtype=bool)
    change[member] = both[ids]
    change &= script > LATIN
    out[change] = to_latin[change]
    return out


def plain_form(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(texts in one consistent form, which of them changed); nulls stay null and count as unchanged."""
    t = tables()
    texts = texts.cast(pa.large_string())
    count = len(texts)
    changed = np.zeros(count, dtype=bool)
    if count == 0:
        return texts, changed
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=texts.offset + count + 1)[texts.offset :]
    base = int(offsets[0])
    buffer = texts.buffers()[2]
    data = buffer.to_pybytes()[base : int(offsets[-1])] if buffer is not None else b""
    raw = np.frombuffer(data, dtype=np.uint8)
    if not (raw >= 0x80).any():
        return texts, changed
    # Rows of plain ASCII are done: only rows with a higher byte are decoded.
    ends = np.concatenate(([0], np.cumsum(raw >= 0x80)))
    high = ends[offsets[1:] - base] > ends[offsets[:-1] - base]
    all_points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    leads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    bounds = leads[offsets - base]
    flagged = np.concatenate(([0], np.cumsum(t.flag[all_points])))
    high &= flagged[bounds[1:]] > flagged[bounds[:-1]]
    rows = np.flatnonzero(high)
    if not len(rows):
        return texts, changed
    lengths = (bounds[1:] - bounds[:-1])[rows]
    row = np.repeat(np.arange(len(rows)), lengths)
    take = np.repeat(bounds[:-1][rows] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(len(row))
    points = before = all_points[take]
    before_row = row
    # Expansion: each character is repeated by the length of its plain form and gathered from the table.
    size = t.length[points]
    replaced = t.start[points]
    has = t.has[points]
    spread = np.repeat(np.arange(len(points)), size)
    inner = np.arange(len(spread)) - np.repeat(np.concatenate(([0], np.cumsum(size)[:-1])), size)
    points = np.where(has[spread], t.out[np.minimum(replaced[spread] + inner, len(t.out) - 1)], points[spread])
    row = row[spread]
    points, row = _compose(points, row, t)
    points = _unmix(points, row, t)
    before_sizes = np.bincount(before_row, minlength=len(rows))
    sizes = np.bincount(row, minlength=len(rows))
    differs = before_sizes != sizes
    equal = np.flatnonzero(~differs)
    if len(equal):
        old, new = np.isin(before_row, equal), np.isin(row, equal)
        unlike = before[old] != points[new]
        differs[np.unique(before_row[old][unlike])] = True
    changed[rows[differs]] = True
    out = _to_arrow(points, sizes)
    index = np.arange(count)
    index[rows[differs]] = count + np.flatnonzero(differs)
    return pa.concat_arrays([texts, out]).take(pa.array(index)), changed


def _to_arrow(points: np.ndarray, sizes: np.ndarray) -> pa.Array:
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    ends = np.concatenate(([0], np.cumsum(width)))
    offsets = ends[np.concatenate(([0], np.cumsum(sizes)))].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))


def one_form(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, plain (the text in one consistent form) and changed for every row of df.

    Plain means: no invisible characters; the plain space for every other space; width and presentation forms,
    ligatures and squared letters replaced; letters stored in pieces composed; letters of another script inside a word
    replaced by the letters they look like. Defined results: a null text stays null and unchanged; an empty text is
    unchanged; repeated rows are kept; texts of any length are processed whole; columns that are not named are left
    out, so clashing names do no harm; an empty input gives an empty result.
    """
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("plain", T.StringType()), T.StructField("changed", T.BooleanType())])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain, changed = plain_form(batch.column(len(keys)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keys))), plain.cast(pa.string()), pa.array(changed)], names=schema.names
            )

    return df.select(*keys, F.col(text).alias("#text")).mapInArrow(convert, schema)


def trade_lines(documents: DataFrame) -> DataFrame:
    """rec_key, page, line, text of every line of document bundles."""
    pages = documents.select(F.col("doc_key").alias("rec_key"), F.explode("pages").alias("p"))
    lines = pages.select("rec_key", F.col("p.page").alias("page"), F.explode("p.lines").alias("l"))
    return lines.select("rec_key", "page", F.col("l.line").alias("line"), F.col("l.text").alias("text"))


def changed_lines(documents: DataFrame, candidates: DataFrame) -> DataFrame:
    """tab, rec_key, page, line of every line of either table that is not in plain form, each once."""
    lines = trade_lines(documents).withColumn("tab", F.lit("trade_case_documents"))
    raw = candidates.select(
        F.col("cand_id").alias("rec_key"), F.lit(0).alias("page"), F.lit(0).alias("line"),
        F.col("raw_line").alias("text"), F.lit("candidates").alias("tab"),
    )
    every = lines.unionByName(raw).filter("text IS NOT NULL")
    keys = ["tab", "rec_key", "page", "line"]
    return one_form(every, "text", keys).filter("changed").select(*keys).distinct()
