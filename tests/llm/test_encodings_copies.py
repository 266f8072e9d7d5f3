"""Garbled words that are frequent."""

from ledgerloom.llm.encodings import fit, repair
from tests.llm.test_encodings import LINES, wrong

RIGHT = "Die französische Rückvergütung für Köln läuft."
ELIDED = "L’électricité s’élève, d’été en été."
LETTERS = "Die Prüfstelle bestätigt größere Lücken, die Waldfläche ist höher."


def test_copies_do_not_make_words_known(spark):
    garbled = {1000: wrong(RIGHT, ("utf-8", "cp1252")), 2000: wrong(LETTERS, ("cp1252", "mac_roman"))}
    rows = [(i, LINES[i % len(LINES)].format(i), "de") for i in range(300)]
    rows += [(start + i, text, "de") for start, text in garbled.items() for i in range(150)]
    # The same words in distinct texts, the right form in none.
    rows += [(3000 + i, f"{wrong('Zählerstände', ('utf-8', 'cp1252'))} {i}", "de") for i in range(5)]
    rows += [(4000 + i, f"{ELIDED} {i}", "fr") for i in range(5)]  # right, though ’é reads as UTF-8
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.restored for r in repair(df, fit(df)).collect()}
    assert got == {s + i: t for s, t in ((1000, RIGHT), (2000, LETTERS)) for i in range(150)} | {3000 + i: f"Zählerstände {i}" for i in range(5)}


def test_a_sign_that_is_read_as_a_letter(spark):
    """A letter that stands alone where others have a dash is no word, however often it does."""
    rows = [(i, f"The lot – number {i} – is at the gate, page {i}.", "en") for i in range(200)]
    rows += [(1000 + i, f"The lot {wrong('–', ('cp1252', 'mac_roman'))} number {i} {wrong('–', ('cp1252', 'mac_roman'))} is at the gate.", "en") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.restored for r in repair(df, fit(df)).collect()}
    assert got == {1000 + i: f"The lot – number {i} – is at the gate." for i in range(4)}
