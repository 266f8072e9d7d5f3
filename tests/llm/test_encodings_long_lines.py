"""Right words among garbled ones on lines of any length."""

import pytest

from ledgerloom.llm.encodings import Model, Repairer


class Lengths(Repairer):
    """Costs that know the right words, so that only the choice of words is tested."""

    def cost(self, text, compressors=None):
        return float(sum(w.startswith("wrong") for w in text.split()))


@pytest.mark.parametrize("fill", [10, 1500])
def test_right_words_are_put_back(fill):
    line = "  right " + "plain \t" * fill + "garbled right  x "
    best = "  wrong1 " + "plain \t" * fill + "restored wrong2  x "
    repairer = Lengths(Model(frozenset(), {}))
    assert repairer._keep_right_words(line, best) == "  right " + "plain \t" * fill + "restored right  x "
