"""Candidates and words that the search must not leave out."""

from ledgerloom.llm.encodings import Model, Repairer


class Counted(Repairer):
    """Costs by word; a measure by one dictionary alone misjudges the right reading."""

    costs = {}

    def cost(self, text, compressors=None):
        return 1000.0 if compressors and "café" in text else sum(self.costs.get(w, 50.0) for w in text.split())


def test_every_candidate_is_measured_by_all_dictionaries():
    repairer = Counted(Model(frozenset(), {"fr": b"cafe " * 50, "ko": b"abc " * 50}))
    repairer.costs = {"café": 1.0}
    assert repairer.line("cafÃ© ñ") == ("café ñ", "cp1252>utf-8")


def test_right_words_are_put_back_after_all_chains():
    repairer = Counted(Model(frozenset(), {}))
    repairer.costs = {"naÃ¯ve": 1.0, "naïve": 2.0, "été": 1.0}
    assert repairer.line("naÃ¯ve Ã©tÃ©")[0] == "naÃ¯ve été"


def test_lexicon_beyond_the_head_is_looked_up(spark):
    """Results don't hang on how many known words every task holds."""
    from ledgerloom.llm.encodings import fit, repair
    from tests.llm.test_encodings import LINES, wrong

    rows = [(i, LINES[i % len(LINES)].format(i), "de") for i in range(200)]
    rows += [(1000 + i, wrong(LINES[k].format(i), ("utf-8", "cp1252")), "de") for i, k in enumerate((0, 1, 2, 5, 6, 7))]
    rows += [(2000, "Von M체nchen bis Z체rich", "de")]  # UTF-8 read as Korean
    rows += [(3000 + i, f"Von München bis Zürich sind es {i} km", "de") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole, head = fit(df), fit(df, head_words=3)
    assert whole.lexicon is None and len(head.known) == 3 and {r.word for r in head.lexicon.collect()} == whole.known
    head.dictionaries = whole.dictionaries
    got, want = ({r.doc_id: r.restored for r in repair(df, m).collect()} for m in (head, whole))
    assert got == want and set(got) == {1000 + i for i in range(6)} | {2000} and got[2000] == "Von München bis Zürich"
