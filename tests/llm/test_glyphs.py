import random
import unicodedata

import pyarrow as pa
import pytest

from ledgerloom.llm.glyphs import _plain_of, changed_lines, one_form, plain_form, tables


def brute(text):
    """The same rules written per character and word."""
    t = tables()
    text = "".join(c if (p := _plain_of(c)) is None else p for c in text)
    text = unicodedata.normalize("NFC", text)

    def unmixed(word):
        script = [int(t.script[ord(c)]) for c in word]
        foreign = [c for c, k in zip(word, script, strict=True) if k > 1]
        if foreign and (1 in script or len({k for k in script if k > 1}) > 1):
            if all(t.to_latin[ord(c)] for c in foreign):
                return "".join(chr(t.to_latin[ord(c)]) if k > 1 else c for c, k in zip(word, script, strict=True))
            for other in (3, 2):
                if 0 < script.count(1) < len(foreign) and {k for k in script if k > 1} == {other} and all(t.to_other[other][ord(c)] for c, k in zip(word, script, strict=True) if k == 1):
                    return "".join(chr(t.to_other[other][ord(c)]) if k == 1 else c for c, k in zip(word, script, strict=True))
        return word

    out, word = [], ""
    for c in text + "\n":
        if t.word[ord(c)]:
            word += c
        else:
            out += [unmixed(word), c]
            word = ""
    return "".join(out)[:-1]


FIXED = [None, "", "plain", "é", "é", "q̣̇", "각", "각", "x̆y", "Поcтавщик", "ﬁ№㎏㎾h", "ΒОF-7", "́a", "한‍글", "ＡＢＣ　ｄ", "M 5", "𝐌12", "NΜ3", "Å", "à֮̕b"]
KEPT = ["m³ CO₂", "ΔT · µg … ℃ ½ ①", "Aciérie — «é» ‰ €", "Северный луг", "한글 M5제품", "Ω λ"]


def test_agrees_with_brute_force():
    rng = random.Random(3)
    ranges = ((0x20, 0x7E), (0xA0, 0x180), (0x300, 0x330), (0x370, 0x400), (0x400, 0x460), (0x1100, 0x1120), (0x1161, 0x1176), (0x11A8, 0x11C3), (0xAC00, 0xAC30), (0x2000, 0x2070), (0xFF00, 0xFF60), (0x1D400, 0x1D430))
    pool = [chr(c) for r in ranges for c in range(*r)]
    rows = FIXED + KEPT + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    got, changed = plain_form(pa.array(rows))
    for text, plain, flag in zip(rows, got.to_pylist(), changed, strict=True):
        want = None if text is None else brute(text)
        assert (plain, bool(flag)) == (want, want != text), repr(text)
    assert not any(changed[len(FIXED) : len(FIXED) + len(KEPT)])


def test_slices_and_long_texts():
    long = "ａ" * 300_000 + "é" * 10
    got, changed = plain_form(pa.array(["x", "ｂ", None, long, "z"]).slice(1, 3))
    assert got.to_pylist() == ["b", None, "a" * 300_000 + "é" * 10] and changed.tolist() == [True, False, True]
    assert plain_form(pa.array([], pa.string()))[0].to_pylist() == []


def test_idempotent(spark, small_data):
    lines = spark.read.parquet(f"{small_data}/candidates.parquet")
    once = one_form(lines, "raw_line", ["cand_id"])
    assert once.filter("changed").count() > 10
    assert one_form(once, "plain", ["cand_id"]).filter("changed").count() == 0


@pytest.fixture(scope="module")
def bundles(spark):
    schema = "doc_key long, pages array<struct<page:int,lines:array<struct<line:int,text:string,confidence:double>>>>, `#text` string, changed int"
    pages = [(1, [(1, "plain", 0.9), (2, "Ｍ5", None), (3, None, 0.1)]), (2, None)]
    return spark.createDataFrame([(5, pages, "x", 1), (5, pages, "x", 1), (6, None, None, None), (None, [(1, [(1, "é é", 0.5)])], None, None)], schema)


def test_found_once_with_clashing_columns(candidates, bundles):
    raw = candidates({"cand_id": 9, "raw_line": "a​b"}, {"cand_id": 9, "raw_line": "a​b"}, {"cand_id": 10}, {"cand_id": 11, "raw_line": ""}, extra="tab string, text string, plain string")
    got = sorted(tuple(r) for r in changed_lines(bundles, raw).collect())
    assert got == [("candidates", 9, 0, 0), ("trade_case_documents", 5, 1, 2)]
    assert changed_lines(bundles.limit(0), candidates()).collect() == []


def test_letters_of_rarer_scripts_inside_words():
    """Armenian, Cherokee and Coptic letters inside Latin words; words wholly in those scripts stay."""
    import pyarrow as pa

    from ledgerloom.llm.glyphs import plain_form

    texts = ["wօrld", "ᎪᏟME", "ⲞⲢen", "Սրբազան", "ᏣᎳᎩ", "ⲕⲟⲥⲙⲟⲥ", "word Սօ"]
    out, changed = plain_form(pa.array(texts))
    assert out.to_pylist() == ["world", "ACME", "OPen", *texts[3:]] and changed.tolist() == [True] * 3 + [False] * 4


def test_long_runs_of_marks_take_no_square_of_time():
    import time
    import unicodedata

    import pyarrow as pa

    from ledgerloom.llm.glyphs import plain_form

    text = "a" + "\u0301\u0323" * 40_000 + "b"
    began = time.perf_counter()
    out, _ = plain_form(pa.array([text, "e\u0323\u0301"]))
    assert time.perf_counter() - began < 20
    assert out.to_pylist() == [unicodedata.normalize("NFC", text), "\u1eb9\u0301"]
