import pytest

from ledgerloom.llm.encodings import Repairer, fit, garbled, repair

LINES = [
    "Le vérificateur a noté « à compléter » sur la page {} du dossier.", "Die Waldfläche zeigt größere Lücken als am Tag {}.", "Die Schätzung für Los {} lag höher, die Prüfstelle bestätigt.",
    "이번 주 전력 사용은 {} kWh이며 계량기 값은 다르다.", "신고서 {}쪽과 메모를 다시 대조하기 바란다.", "The café ledger – page {} – isn’t complete at 20 °C.", "DECLARAÇÃO DE EMISSÕES, folha {}: NÃO CONFIRMADA, opção até amanhã.",
    "Партия {} отгружена без замечаний.", "異議 신청(申請) {}은 접수(接受)되었다.",
]


def wrong(text, *steps):
    for right, taken in steps:
        data = text.encode(right)
        text = "".join(bytes([b]).decode(taken, "ignore") or chr(b) for b in data) if taken != "cp949" else data.decode("cp949", "replace")
    return text


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, "\n".join(LINES[(i + k) % len(LINES)].format(i * 7 + k) for k in range(3)), ("ko", "fr", None)[i % 3]) for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def model(corpus):
    return fit(corpus)


CASES = [
    (0, ("utf-8", "cp1252")), (0, ("utf-8", "latin-1")), (1, ("utf-8", "mac_roman")), (2, ("utf-8", "cp437")), (3, ("utf-8", "cp1252")), (3, ("cp949", "latin-1")), (4, ("utf-8", "cp1251")), (4, ("utf-8", "cp1250")),
    (1, ("cp1252", "mac_roman")), (2, ("cp1252", "mac_roman")), (5, ("utf-8", "cp1252")), (6, ("utf-8", "cp1252")), (7, ("utf-8", "cp1252")),
]


@pytest.mark.parametrize(("line", "step"), CASES)
def test_exact_round_trip(model, line, step):
    text = LINES[line].format(55)
    spoilt = wrong(text, step)
    assert spoilt != text
    restored, chains, _ = Repairer(model).text(LINES[3].format(1) + "\n" + spoilt)
    assert chains and restored.split("\n")[1] == text


def test_twice_wrong(model):
    text = LINES[0].format(5)
    assert Repairer(model).text(wrong(text, ("utf-8", "cp1252"), ("utf-8", "cp1252")))[0] == text


def test_right_texts_stay(model, corpus):
    others = ["Åkerby och Ærholm skickade 842 kg; se bilaga.", "Lunedì, così disse.", "m³ und CO₂, 5 ‰, Δ NDVI ±0.3 µg", "Résumé naïve façade", "žluťoučký kůň", "ΑΒΓ δοκιμή", "日本語のテキスト"]
    repairer = Repairer(model)
    for text in others + [r.text for r in corpus.collect()]:
        assert repairer.text(text) == (text, [], False), text


def test_rows_lost_and_edges(spark, corpus, model):
    rows = [(1000, LINES[0].format(3)), (1001, wrong(LINES[4].format(9), ("utf-8", "cp949"))), (1002, None), (1003, ""), (1004, "plain " * 50_000), (1005, wrong(LINES[1].format(2), ("utf-8", "cp1252"))), (1006, wrong(LINES[1].format(2), ("utf-8", "cp1252")))]
    df = corpus.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True).selectExpr("*", "1 AS restored", "2 AS chains")
    out = {r.doc_id: r for r in repair(df).collect()}
    assert set(out) == {1001, 1005, 1006} and out[1001].lost and not out[1005].lost
    assert out[1005].restored == out[1006].restored == LINES[1].format(2)
    assert garbled(df.limit(0)).collect() == []
