"""Garbled text from wrong character encodings.

Candidate decodings of every suspicious line are compressed with per-language zstandard dictionaries; the chain of
decodings with the least description length, chain cost included, is taken, and the line stays as it is otherwise.
Words and dictionaries are counted over all distinct texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import discard, materialise

#: Bytes a chain of decodings costs, at first and for each further step, and what a chain of single letters costs more.
CHAIN_COST = 2.0
STEP_COST = 1.0
LETTER_COST = 1.5
#: Bytes that a word with unusual characters costs where the lexicon doesn't have it.
UNKNOWN_COST = 3.0
#: Steps of a chain at most, and candidates kept for the next step.
STEPS = 3
WIDTH = 6
#: Words on either side within which a changed word is judged.
AROUND = 200
#: Sizes of the model: languages with a dictionary of their own (the others share one) and bytes of a dictionary.
LANGUAGES = 32
DICTIONARY_BYTES = 65_536
#: Bytes that a reference into a dictionary costs itself.
REFERENCE_COST = 3
#: Known words that every task holds; all others are looked up by a join, so that this bounds memory, not the lexicon.
HEAD_WORDS = 50_000
#: A word is known if it occurs at least so often, and no decoding of it is this many times as frequent.
KNOWN_COUNT = 3
OUTNUMBERED = 4

# The codecs by which bytes of UTF-8, of Korean and of western text are taken for something else.
SINGLE = ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "iso8859_2", "iso8859_15", "koi8_r")
WESTERN = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251")
MULTI = ("utf-8", "cp949")
#: First words of names of letters that stand beside those of any alphabet.
MIXING = frozenset(("HANGUL", "CJK", "HIRAGANA", "KATAKANA", "FULLWIDTH", "FEMININE", "MASCULINE", "MICRO", "MODIFIER"))
REPLACEMENT = "�"
SIGNS = frozenset("’‘“”–—«»€°·…ºª§£¡¿")

_WORD = re.compile(r"[^ \t\n\r]+")
_PIECES = re.compile(r"([^ \t\n\r]+)")
#: What phrases are made of: words with the white space behind them, single characters in scripts that use none.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff"
_PIECE = re.compile(f"[{_UNSPACED}]\\s*|[^\\s{_UNSPACED}]+\\s*")
_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf4][\x80-\xbf]{3}")
_KOREAN = re.compile(rb"(?:[\xa1-\xfe][\xa1-\xfe])+")
_MISPLACED = re.compile(r"[^\W_][“„‘«¡¿]|[”»][^\W_]")
_UNUSUAL = re.compile("[^\x00-\x7f가-힣]")
_MIXED = re.compile("[A-Za-z][가-힣]|[가-힣][A-Za-z]")
_BROKEN = re.compile(f"[{REPLACEMENT}\x80-\x84\x86-\x9f]")


@lru_cache(maxsize=None)
def _encoder(codec: str) -> dict[str, int]:
    """Character -> byte; bytes that the codec leaves undefined stand for the control character of the same number."""
    table = {}
    for byte in range(0x80, 0x100):
        try:
            table[bytes([byte]).decode(codec)] = byte
        except UnicodeDecodeError:
            table[chr(byte)] = byte
    return table


@lru_cache(maxsize=None)
def _letter_map(wrong: str, right: str) -> dict[str, str]:
    """Character as read -> character as meant, where both are printable and differ."""
    out = {}
    for ch, byte in _encoder(wrong).items():
        try:
            meant = bytes([byte]).decode(right)
        except UnicodeDecodeError:
            continue
        if meant != ch and (meant.isalpha() or meant in SIGNS):
            out[ch] = meant
    return out


def _class(chars: list[str]) -> str:
    return "[" + "".join(map(re.escape, chars)) + "]"


@lru_cache(maxsize=None)
def _utf8_start(codec: str) -> re.Pattern[str]:
    """Two characters in codec whose bytes may begin a UTF-8 character."""
    table = _encoder(codec)
    return re.compile(_class([c for c, b in table.items() if 0xC2 <= b <= 0xF4]) + _class([c for c, b in table.items() if b < 0xC0]))


@lru_cache(maxsize=None)
def _pair(codec: str) -> re.Pattern[str]:
    """Two characters in codec whose bytes may be a Korean syllable."""
    high = _class([c for c, b in _encoder(codec).items() if b >= 0xA1])
    return re.compile(high + high)


@lru_cache(maxsize=None)
def _letters_only(wrong: str, right: str) -> tuple[re.Pattern[str], dict[int, str]]:
    table = _letter_map(wrong, right)
    return re.compile("[\x00-\x7f" + "".join(map(re.escape, table)) + "]+"), str.maketrans(table)


def _sane(text: str) -> bool:
    return all(unicodedata.category(c) not in ("Cc", "Cn", "Co", "Cs") for c in text)


def _to_utf8(word: str, codec: str) -> str | None:
    """word with every sequence of characters replaced whose bytes in codec are one UTF-8 character."""
    if not _utf8_start(codec).search(word):
        return None
    table = _encoder(codec)
    out, run = [], bytearray()
    origin: list[str] = []
    changed = False

    def flush() -> None:
        nonlocal changed
        at = 0
        for m in _UTF8.finditer(bytes(run)):
            decoded = m.group().decode("utf-8", "ignore")
            if not decoded or not (_sane(decoded) or decoded < "\xa0"):
                continue
            out.append("".join(origin[at : m.start()]))
            out.append(decoded)
            at = m.end()
            changed = True
        out.append("".join(origin[at:]))
        run.clear()
        origin.clear()

    for c in word:
        byte = table.get(c)
        if byte is None:
            flush()
            out.append(c)
        else:
            run.append(byte)
            origin.append(c)
    flush()
    return "".join(out) if changed else None


def _to_korean(word: str, codec: str) -> str | None:
    """word with runs of character pairs replaced whose bytes in codec are Korean syllables."""
    if not _pair(codec).search(word):
        return None
    table = _encoder(codec)
    out, run = [], []
    changed = False

    def flush(after: str = "") -> None:
        nonlocal changed
        if run:
            data = bytes(table[c] for c in run)
            # A single pair within a Latin word is rather two Latin letters.
            if _KOREAN.fullmatch(data) and not (len(data) == 2 and after.isascii() and after.isalpha()):
                decoded = data.decode("cp949", "ignore")
                if len(decoded) * 2 == len(data) and all("가" <= c <= "힣" for c in decoded):
                    out.append(decoded)
                    changed = True
                    run.clear()
                    return
            out.extend(run)
            run.clear()

    for c in word:
        if c in table and table[c] >= 0xA1:
            run.append(c)
        else:
            flush(c)
            out.append(c)
    flush()
    return "".join(out) if changed else None


def _from_multibyte(word: str, right: str) -> str | None:
    """word read back through Korean bytes as UTF-8 or western text."""
    try:
        data = word.encode("cp949")
        decoded = data.decode(right)
    except UnicodeError:
        return None
    ok = decoded != word and _sane(decoded) and (right == "utf-8" or all(c.isascii() or c.isalpha() or c in SIGNS for c in decoded))
    return decoded if ok else None


def _letterwise(word: str, wrong: str, right: str) -> str | None:
    allowed, table = _letters_only(wrong, right)
    if allowed.fullmatch(word):
        decoded = word.translate(table)
        # An opening sign after a letter, or a closing one before it, is no reading.
        return None if _MISPLACED.search(decoded) else decoded
    return None


def _chains() -> list[tuple[str, float, object]]:
    chains: list[tuple[str, float, object]] = []
    for codec in SINGLE:
        chains.append((f"{codec}>utf-8", 0.0, lambda w, c=codec: _to_utf8(w, c)))
    for codec in ("cp1252", "latin-1", "mac_roman", "cp437", "cp1251", "cp1250"):
        chains.append((f"{codec}>cp949", 0.0, lambda w, c=codec: _to_korean(w, c)))
    chains.append(("cp949>utf-8", 0.0, lambda w: _from_multibyte(w, "utf-8")))
    chains.append(("cp949>cp1252", LETTER_COST, lambda w: _from_multibyte(w, "cp1252")))
    for wrong in WESTERN:
        for right in WESTERN:
            if wrong != right:
                chains.append((f"{wrong}>{right}", LETTER_COST, lambda w, a=wrong, b=right: _letterwise(w, a, b)))
    return chains


CHAINS = _chains()


@lru_cache(maxsize=1 << 15)
def _decodings(word: str) -> tuple[tuple[int, str], ...]:
    """(chain, decoded word) for every chain that changes the word."""
    out = []
    for k, (_, _, decode) in enumerate(CHAINS):
        decoded = decode(word)
        if decoded is not None and decoded != word:
            out.append((k, decoded))
    return tuple(out)


@lru_cache(maxsize=1 << 15)
def _reads_as_utf8(word: str) -> bool:
    """Whether bytes of the word in some codec are UTF-8 characters that give a word of one alphabet.

    Right words have readings too, which mix alphabets: ’é of L’électricité would be an Armenian letter in Mac Roman.
    """
    for name, _, decode in CHAINS:
        if name.endswith(">utf-8") and (decoded := decode(word)) not in (None, word) and len(_alphabets(decoded)) < 2:
            return True
    return False


def _alphabets(word: str) -> set[str]:
    return {unicodedata.name(c, "").split(" ")[0] for c in word if c.isalpha()} - MIXING


@lru_cache(maxsize=1 << 15)
def suspicious(word: str) -> bool:
    """Whether a word has unusual characters, or Korean syllables among Latin letters that are UTF-8 read as Korean."""
    return bool(_UNUSUAL.search(word)) or bool(_MIXED.search(word)) and _from_multibyte(word, "utf-8") is not None


def looks(text: str) -> bool:
    return not text.isascii() and bool(_UNUSUAL.search(text) or _MIXED.search(text))


@lru_cache(maxsize=1 << 14)
def forms(word: str) -> tuple[str, ...]:
    """Counted forms of a word and of all that STEPS decodings can make of it: what the search may ask the lexicon."""
    seen, last = {word}, {word}
    for _ in range(STEPS):
        last = {decoded for w in last for _, decoded in _decodings(w)} - seen
        seen |= last
    return tuple(sorted({bare(w) for w in seen} - {""}))


@dataclass
class Model:
    """What is fitted: the most frequent known words, a dictionary per language (raw content, the best phrases last), and
    the table (word) of all known words, None where known has them all."""

    known: frozenset[str]
    dictionaries: dict[str, bytes]
    lexicon: DataFrame | None = None


class Repairer:
    """Judges lines; holds one compressor per language."""

    def __init__(self, model: Model):
        import zstandard

        self.known = model.known
        #: Known words beyond those, as far as the line in hand may ask for them.
        self.more: frozenset[str] = frozenset()
        #: Unknown words of the candidates in hand.
        self.counted: dict[str, int] = {}
        # Optimal parsing: a greedy one may measure a text the longer, the more often a dictionary has its words.
        parameters = zstandard.ZstdCompressionParameters.from_level(
            6, strategy=zstandard.STRATEGY_BTOPT, search_log=6, write_content_size=0, write_checksum=0, write_dict_id=0
        )
        self.compressors = [
            zstandard.ZstdCompressor(compression_params=parameters, dict_data=zstandard.ZstdCompressionDict(data))
            for data in model.dictionaries.values()
        ] or [zstandard.ZstdCompressor(compression_params=parameters)]

    def unknown(self, text: str) -> list[str]:
        """Suspicious words that the lexicon doesn't have."""
        return [w for w in _WORD.findall(text) if self._is_unknown(w)]

    def is_known(self, word: str) -> bool:
        if _reads_as_utf8(word):
            return False
        core = bare(word)
        return core in self.known or core in self.more or (not _UNUSUAL.search(core) and not _BROKEN.search(word))

    def _is_unknown(self, word: str) -> bool:
        return not word.isascii() and suspicious(word) and not self.is_known(word)

    def cost(self, text: str) -> float:
        """Description length in bytes, under the best of the dictionaries."""
        data = text.encode("utf-8", "surrogatepass")
        unknown = self.counted.get(text)
        return min([len(c.compress(data)) for c in self.compressors]) + UNKNOWN_COST * (len(self.unknown(text)) if unknown is None else unknown)

    def line(self, line: str) -> tuple[str, str | None]:
        """(line as meant, chain taken or None).

        Every candidate of a step is measured by the dictionaries of all languages and may be taken; the WIDTH best go on.
        """
        # White space at even places, words at odd ones; decodings make and remove neither.
        parts = _PIECES.split(line)
        unknown = [i for i in range(1, len(parts), 2) if self._is_unknown(parts[i])]
        if not unknown:
            return line, None
        self.counted = {line: len(unknown)}
        best, chain = line, None
        least = None
        frontier: list[tuple[float, str, tuple[int, ...], list[str], list[int]]] = [(0.0, line, (), parts, unknown)]
        seen = {line}
        for step in range(STEPS):
            grown = []
            for _, _, taken, parts, unknown in frontier:
                by_chain: dict[int, dict[str, str]] = {}
                for w in {parts[i] for i in unknown}:
                    for k, decoded in _decodings(w):
                        by_chain.setdefault(k, {})[w] = decoded
                for k, changes in by_chain.items():
                    changed = parts.copy()
                    for i in unknown:
                        changed[i] = changes.get(parts[i], parts[i])
                    candidate = "".join(changed)
                    if candidate in seen:
                        continue
                    seen.add(candidate)
                    left = [i for i in unknown if self._is_unknown(changed[i])]
                    self.counted[candidate] = len(left)
                    extra = sum(CHAINS[i][1] for i in (*taken, k))
                    grown.append((CHAIN_COST + STEP_COST * step + extra, candidate, (*taken, k), changed, left))
            if not grown:
                break
            if least is None:
                least = self.cost(line)
            grown = sorted(((self.cost(text) + cost, text, *rest) for cost, text, *rest in grown), key=lambda x: (x[0], x[2]))
            if grown[0][0] < least:
                least, best, chain = grown[0][0], grown[0][1], grown[0][2]
            frontier = grown[:WIDTH]
        self.counted = {}
        if chain is None:
            return line, None
        return self._keep_right_words(line, best), "+".join(CHAINS[k][0] for k in chain)

    def _keep_right_words(self, line: str, best: str) -> str:
        """Undo changes of single words that lengthen the description: words that were right among garbled ones.

        A word is judged within AROUND words on either side, so that a line of any length is treated alike.
        """
        old, new = _WORD.findall(line), _WORD.findall(best)
        if len(old) != len(new):  # no decoding makes or removes white space
            return best
        changed = [i for i, (a, b) in enumerate(zip(old, new, strict=True)) if a != b]
        if len(changed) < 2:
            return best
        gaps = _WORD.split(best)
        window, now = None, 0.0
        for i in changed:
            at = (max(0, i - AROUND), min(len(new), i + AROUND + 1))
            if at != window:
                window, now = at, self.cost(_joined(gaps, new, *at))
            kept, new[i] = new[i], old[i]
            cost = self.cost(_joined(gaps, new, *at))
            if cost < now:
                now = cost
            else:
                new[i] = kept
        return gaps[0] + _joined(gaps, new, 0, len(new)) + gaps[-1]

    def text(self, text: str) -> tuple[str, list[str], bool]:
        """(text as far as it can be restored, chains taken, whether something is lost for good)."""
        if not looks(text):
            return text, [], False
        chains, out = [], []
        for line in text.split("\n"):
            if looks(line):
                line, chain = self.line(line)
                if chain:
                    chains.append(chain)
            out.append(line)
        restored = "\n".join(out)
        return restored, chains, bool(_BROKEN.search(restored))


def _joined(gaps: list[str], words: list[str], begin: int, end: int) -> str:
    """Words from begin to end with the white space between them."""
    return "".join(w + (gaps[k + 1] if k + 1 < end else "") for k, w in enumerate(words[begin:end], begin))


@lru_cache(maxsize=1 << 16)
def bare(word: str) -> str:
    """A word without digits and outer punctuation: the form that is counted."""
    return re.sub("[0-9]+", "0", word).strip(".,;:!?()[]\"'“”‘’«»–—")


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        counts: dict[str, int] = {}
        for text in b["text"]:
            if text.isascii():
                continue
            for w in {bare(m.group()) for m in _WORD.finditer(text) if not m.group().isascii()}:
                counts[w] = counts.get(w, 0) + 1
        if counts:
            yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})


def fit(documents: DataFrame, head_words: int = HEAD_WORDS) -> Model:
    """Words, and the phrases of dictionaries, counted over all distinct texts.

    The lexicon is a table without bound; only its head_words most frequent words reach the driver. A word is not known
    if it reads as UTF-8 of one alphabet or as Korean in another encoding, however frequent it is, if another reading as
    UTF-8 is as frequent, or if any other reading is OUTNUMBERED times as frequent: copies don't make a garbled word
    known, and whether a reading is taken is left to the description length. Dictionaries hold the phrases of lines whose
    unusual words are all known.
    """
    texts = documents.select("text", "lang").filter("text IS NOT NULL AND text <> ''")
    distinct = texts.select("text").filter(F.col("text").rlike("[^\\x00-\\x7F]")).distinct()
    counted = distinct.mapInPandas(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialise(counted.filter(F.col("n") >= KNOWN_COUNT), "words")
    lexicon = materialise(_known_words(counts), "lexicon")
    discard(counts)
    head = [r.word for r in lexicon.orderBy(F.desc("n"), "word").limit(head_words + 1).collect()]
    whole = len(head) <= head_words
    known = frozenset(head[:head_words])
    beyond = None if whole else lexicon.select("word")
    dictionaries = _dictionaries(texts, known, beyond)
    if whole:
        discard(lexicon)
    return Model(known, dictionaries, beyond)


def _readings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """word, n, form, multi: the readings that may speak against a word; form is null where none does."""
    for b in batches:
        rows = []
        for word, n in zip(b["word"], b["n"], strict=True):
            # Signs alone are counted under the empty word: a reading as a sign speaks against a letter.
            if not word or _BROKEN.search(word) or _reads_as_utf8(word):
                continue
            korean = any("가" <= c <= "힣" for c in word)
            against = {(bare(d), CHAINS[k][0].endswith(MULTI), any("가" <= c <= "힣" for c in d)) for k, d in _decodings(word)}
            if any(multi and hangul and not korean for _, multi, hangul in against):
                continue
            rows += [(word, n, form, multi) for form, multi, _ in against] or [(word, n, None, False)]
        yield pd.DataFrame(rows, columns=["word", "n", "form", "multi"])


def _known_words(counts: DataFrame) -> DataFrame:
    """word, n of the counted words that no more frequent reading speaks against: one join of readings with the counts."""
    readings = counts.mapInPandas(_readings, "word string, n long, form string, multi boolean")
    other = counts.select(F.col("word").alias("form"), F.col("n").alias("other"))
    against = (F.col("other") >= OUTNUMBERED * F.col("n")) | (F.col("multi") & (F.col("other") >= F.col("n")))
    judged = readings.join(other, "form", "left").groupBy("word", "n").agg(F.bool_or(F.coalesce(against, F.lit(False))).alias("against"))
    return judged.filter(~F.col("against")).select("word", "n")


def _dictionaries(texts: DataFrame, known: frozenset[str], lexicon: DataFrame | None) -> dict[str, bytes]:
    """A dictionary for each of the LANGUAGES languages with most texts, and one for all others, from all distinct texts.

    Words and pairs of neighbouring words are counted exactly; those that save most for the bytes they take fill the
    dictionary: a word its bytes but for a reference, a pair the second reference. Each takes a byte at least, so that no
    more than DICTIONARY_BYTES of a language can take part.
    """
    language = F.regexp_extract(F.lower(F.coalesce("lang", F.lit("und"))), "^[a-z]{2,3}", 0)
    keyed = texts.select(language.alias("l"), "text")
    most = keyed.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(LANGUAGES)
    own = [r.l for r in most.collect()]
    keyed = keyed.withColumn("l", F.when(F.col("l").isin(own), F.col("l")).otherwise("other")).distinct()
    schema, size = "l string, phrase string, saves int, n long", DICTIONARY_BYTES
    shared = texts.sparkSession.sparkContext.broadcast(known)
    if lexicon is None:
        counted, rare = keyed.mapInPandas(lambda batches: _count_phrases(_fine_lines(batches, shared.value, False)), schema), None
    else:
        lines = keyed.mapInPandas(lambda batches: _fine_lines(batches, shared.value, True), "l string, line string, rare array<string>")
        rare = materialise(lines.filter(F.size("rare") > 0).withColumn("id", F.monotonically_increasing_id()), "rare")
        unknown = rare.select("id", F.explode("rare").alias("word")).join(lexicon, "word", "left_anti").select("id").distinct()
        fine = lines.filter(F.size("rare") == 0).select("l", "line").union(rare.join(unknown, "id", "left_anti").select("l", "line"))
        counted = fine.mapInPandas(_count_phrases, schema)
    gain = (F.col("n") - 1) * F.col("saves") / F.octet_length("phrase")
    phrases = counted.groupBy("l", "phrase", "saves").agg(F.sum("n").alias("n")).withColumn("gain", gain)
    phrases = phrases.filter((F.col("gain") > 0) & (F.octet_length("phrase") <= size))
    place = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("gain"), "phrase"))
    ranked = phrases.withColumn("k", place).filter(F.col("k") <= size).select("l", "k", "phrase")

    def compose(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"l": group["l"].iloc[:1], "data": [_dictionary(group.sort_values("k")["phrase"].tolist(), size)]})

    made = ranked.groupBy("l").applyInPandas(compose, "l string, data binary").collect()
    if rare is not None:
        discard(rare)
    return {r.l: bytes(r.data) for r in sorted(made, key=lambda r: r.l)}


def _fine_lines(batches: Iterator[pd.DataFrame], known: frozenset[str], beyond: bool) -> Iterator[pd.DataFrame]:
    """l, line, rare: lines without a word that reads as UTF-8; rare are their unusual words that known does not have,
    which only a lexicon beyond it can allow."""
    for b in batches:
        rows = []
        for language, text in zip(b["l"], b["text"], strict=True):
            for line in filter(None, text.split("\n")):
                unusual = [] if line.isascii() else [w for w in _WORD.findall(line) if _UNUSUAL.search(bare(w))]
                rare = {bare(w) for w in unusual} - known
                if (beyond or not rare) and not any(map(_reads_as_utf8, unusual)):
                    rows.append((language, line, sorted(rare)))
        yield pd.DataFrame(rows, columns=["l", "line", "rare"])


def _count_phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """l, phrase, saves, n: words and pairs of neighbouring words, and the bytes that one saves where it is referred to."""
    for b in batches:
        words: Counter[tuple[str, str]] = Counter()
        pairs: Counter[tuple[str, str]] = Counter()
        for language, line in zip(b["l"], b["line"], strict=True):
            pieces = _PIECE.findall(line)
            words.update((language, p) for p in pieces)
            pairs.update((language, p + q) for p, q in zip(pieces, pieces[1:], strict=False))
        rows = [(*key, len(key[1].encode()) - REFERENCE_COST, n) for key, n in words.items()]
        rows += [(*key, REFERENCE_COST, n) for key, n in pairs.items()]
        yield pd.DataFrame(rows, columns=["l", "phrase", "saves", "n"])


def _dictionary(ranked: list[str], size: int) -> bytes:
    """As many of the phrases, best first, as size bytes hold; zstandard refers most cheaply to what stands last."""
    pieces = [_PIECE.findall(p) for p in ranked]
    fits, over = 0, len(ranked) + 1
    step = 1024
    while over - fits > 1:
        at = min(fits + step, (fits + over) // 2)
        if sum(len(x.encode()) for x in _passages(pieces[:at])) <= size:
            fits, step = at, 2 * step
        else:
            over = at
    return "".join(reversed(_passages(pieces[:fits]))).encode()


def _passages(phrases: list[list[str]]) -> list[str]:
    """Passages that hold all the phrases (words and pairs, best first): pairs are chained where one begins with the word
    another ends with, each taken once, and a word of a pair does not stand alone."""
    pairs = [p for p in phrases if len(p) == 2]
    paired = {w for p in pairs for w in p}
    after: dict[str, list[int]] = {}
    before: dict[str, list[int]] = {}
    for i in reversed(range(len(pairs))):
        after.setdefault(pairs[i][0], []).append(i)
        before.setdefault(pairs[i][1], []).append(i)
    used: set[int] = set()

    def take(waiting: list[int]) -> int | None:
        while waiting:
            if (i := waiting.pop()) not in used:
                used.add(i)
                return i
        return None

    out, at = [], 0
    for phrase in phrases:
        if len(phrase) != 2:
            if phrase[0] not in paired:
                out.append(phrase[0])
            continue
        first, at = at, at + 1
        if first in used:
            continue
        used.add(first)
        right, left = [pairs[first][1]], [pairs[first][0]]
        while (i := take(after.get(right[-1], []))) is not None:
            right.append(pairs[i][1])
        while (i := take(before.get(left[-1], []))) is not None:
            left.append(pairs[i][0])
        out.append("".join((*reversed(left), *right)))
    return out


LINE_SCHEMA = "doc_id long, text string, lines array<struct<place:int,line:string,words:array<string>>>"


def _judged(documents: DataFrame, model: Model) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, key, lines of every text with unknown words or lost characters; line, meant, chain of garbled lines).

    A line that many texts share is judged once. What the search may ask the lexicon beyond the words that every task
    holds is joined to the line before, one row per distinct word.
    """
    shared = documents.sparkSession.sparkContext.broadcast(Model(model.known, model.dictionaries))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repairer = Repairer(shared.value)
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                if not looks(text):
                    continue
                found = [(i, x, repairer.unknown(x)) for i, x in enumerate(text.split("\n")) if looks(x)]
                found = [{"place": i, "line": x, "words": sorted(set(w))} for i, x, w in found if w]
                if found or _BROKEN.search(text):
                    out.append((doc_id, text, found))
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "text", "lines"])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repairer = Repairer(shared.value)
        for b in batches:
            out = []
            for line, more in zip(b["line"], b["more"], strict=True):
                repairer.more = frozenset(more if more is not None else ())
                meant, chain = repairer.line(line)
                if chain:
                    out.append((line, meant, chain))
            if out:
                yield pd.DataFrame(out, columns=["line", "meant", "chain"])

    rows = documents.select("doc_id", "text").filter("text IS NOT NULL AND text <> ''")
    texts = materialise(rows.mapInPandas(pick, LINE_SCHEMA), "suspicious")
    texts = texts.withColumn("key", F.xxhash64("text"))
    lines = texts.select(F.explode("lines").alias("l")).select("l.line", "l.words").distinct()
    # Few rows, but much work each: the number of tasks is fixed, so that adaptive execution doesn't merge them.
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if model.lexicon is None:
        asked = lines.select("line", F.lit(None).cast("array<string>").alias("more"))
    else:
        words = lines.select(F.explode("words").alias("word")).distinct()
        reach = words.mapInPandas(_reach, "word string, form string")
        hits = reach.join(model.lexicon.withColumnRenamed("word", "form"), "form").groupBy("word").agg(F.collect_set("form").alias("forms"))
        spread = lines.select("line", F.explode("words").alias("word")).join(hits, "word")
        more = spread.groupBy("line").agg(F.array_distinct(F.flatten(F.collect_list("forms"))).alias("more"))
        asked = lines.select("line").join(more, "line", "left")
    return texts, asked.repartition(tasks, "line").mapInPandas(judge, "line string, meant string, chain string")


def _reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(w, f) for w in b["word"] for f in forms(w)]
        yield pd.DataFrame(rows, columns=["word", "form"])


def _is_broken(text: str) -> Column:
    return F.col(text).rlike(_BROKEN.pattern)


def repair(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, text, restored, chains, lost of every document with garbled passages.

    restored is the text as far as it can be had; lost tells that characters are gone for good (replacement or stray
    control characters remain), which alone makes a document garbled. Defined results: null and empty texts are never
    garbled; repeated texts are reported under each id; texts of any length are read whole; other columns are ignored;
    an empty input gives an empty result.
    """
    texts, judged = _judged(documents, model or fit(documents))
    changed = (
        texts.select("doc_id", "key", F.explode("lines").alias("l"))
        .select("doc_id", "key", "l.place", "l.line").distinct()
        .join(judged, "line")
        .groupBy("doc_id", "key")
        .agg(F.map_from_entries(F.collect_list(F.struct("place", "meant"))).alias("meant"), F.array_sort(F.collect_set("chain")).alias("chains"))
    )
    both = texts.select("doc_id", "text", "key").join(changed, ["doc_id", "key"], "left").filter(F.col("chains").isNotNull() | _is_broken("text"))
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.coalesce(F.try_element_at("meant", i), x))
    restored = F.when(F.col("meant").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))
    chains = F.coalesce("chains", F.array().cast("array<string>"))
    done = both.select("doc_id", "text", restored.alias("restored"), chains.alias("chains"))
    return done.withColumn("lost", _is_broken("restored"))


def garbled(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id of every document with a garbled passage, each once: one with a garbled line, or with lost characters."""
    texts, judged = _judged(documents, model or fit(documents))
    spoilt = texts.select("doc_id", F.explode("lines.line").alias("line")).join(judged.select("line"), "line", "left_semi").select("doc_id")
    return spoilt.union(texts.filter(_is_broken("text")).select("doc_id")).distinct()
