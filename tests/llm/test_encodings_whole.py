"""Dictionaries are counted over all texts, whole."""

from collections import Counter

from ledgerloom.llm import encodings
from ledgerloom.llm.encodings import fit

SCHEMA = "doc_id long, text string, lang string"


def test_dictionaries_hold_what_any_text_repeats(spark):
    """3,000 texts of one language, each phrase in two of them, and one that stands only behind 30,000 characters."""
    rows = [(i, f"alpha{i // 2:04d} beta{i // 2:04d}\n{i}", "en") for i in range(3000)]
    rows += [(5000 + i, f"{i} " + "filling " * 4000 + "latecomers gather", "en") for i in range(3)]
    held = fit(spark.createDataFrame(rows, SCHEMA)).dictionaries["en"].decode()
    assert all(f"alpha{k:04d} beta{k:04d}" in held for k in range(1500)) and "latecomers gather" in held


def test_phrases_that_save_most_are_kept(spark, monkeypatch):
    """Against counts by hand, copies once, where not all of them fit."""
    monkeypatch.setattr(encodings, "DICTIONARY_BYTES", 200)
    rows = [(i, f"word{i % 40 * i % 37:02d} tail{i % 11:02d}\n{i}", "de") for i in range(400)]
    lines = [t.split("\n")[0].split() for t in {t for _, t, _ in rows}]
    words = Counter(w for a, b in lines for w in (a + " ", b))
    gains = {w: (n - 1) * (len(w) - encodings.REFERENCE_COST) / len(w) for w, n in words.items()}
    pairs = Counter(f"{a} {b}" for a, b in lines)
    gains |= {p: (n - 1) * encodings.REFERENCE_COST / len(p) for p, n in pairs.items()}
    held = fit(spark.createDataFrame(rows + [(900 + i, "copied often\n0", "de") for i in range(500)], SCHEMA)).dictionaries["de"].decode()
    inside = [p in held for p in sorted(gains, key=lambda p: (-gains[p], p))]
    assert len(held) <= 200 and all(inside[:12]) and not all(inside) and "copied" not in held


def test_passages_hold_all_phrases():
    phrases = [["a ", "b "], ["b "], ["b ", "c "], ["c ", "a "], ["x "], ["z ", "b "], ["a ", "a "]]
    passages = encodings._passages(phrases)
    assert all(any("".join(p) in x for x in passages) for p in phrases) and sum(map(len, passages)) < sum(len("".join(p)) for p in phrases)


def test_lines_with_words_beyond_the_head_take_part(spark):
    """Results don't hang on how many known words every task holds."""
    rows = [(i, f"Größe der Tür {i % 50}: über {i}\nStraße nach Köln {i % 7}", "de") for i in range(100)]
    rows += [(500 + i, f"Stra{chr(0xC3)}{chr(0x178)}e nach nirgendwo {i}\nFraĝo sola {i % 2}", "de") for i in range(2)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole, head = fit(df), fit(df, head_words=1)
    assert head.lexicon is not None and head.dictionaries == whole.dictionaries
    held = whole.dictionaries["de"].decode()
    assert "Größe der Tür " in held and "nach Köln" in held and "nirgendwo" not in held and "sola" not in held
