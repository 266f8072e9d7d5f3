import pytest

from ledgerloom.functions.strict_values import strict_values

MASS, PRICE, INTENSITY, RATIO, ENERGY, GAS = "shipment_mass_t", "certificate_price_eur_per_tco2e", "actual_intensity_tco2e_per_t", "scenario_exposure_factor", "electricity_kwh", "lng_nm3"

TAKEN = [
    (MASS, "190,000 kg", "190"), (MASS, "190 metric tons", "190"), (MASS, "0.5 톤", "0.5"), (MASS, "12 MT", "12"), (MASS, "1,234.50 kgs", "1.2345"), (INTENSITY, "-0.001 tCO2e/t", "-0.001"),
    (INTENSITY, "5.85 t CO2 per tonne", "5.85"), (PRICE, "EUR +87.50 / tCO2e", "87.5"), (PRICE, "87.50 € / tCO2e", "87.5"), (RATIO, "80 %", "0.8"), (RATIO, "0.8", "0.8"), (RATIO, "100%", "1"),
    (ENERGY, "1,200 kWh", "1200"), (GAS, "55 Nm³", "55"), (GAS, "55 nm3", "55"), ("cn_code", "7318 15 90", "73181590"), ("cn_code", "73181590", "73181590"), ("m5_installation_id", "  inst - a ", "INST - A"), ("verification_reference", " v  1 ", "v 1"),
]
SIGNS = ["−", "‐", "‑", "‒", "–", "—", "－", "﹣", "➖"]
REFUSED = [
    ".5 t", "-.5 t", "1e3 t", "1,00 t", "- 1 t", "(0.5) t", "（0.5） t", "87¹ t", "87① t", "⁸⁷ t", "<190 t", "≤190 t", "at most 190 t", "up to 190 t", "190 t 이하", "190 t 이상", "190 t max", "no less than 190 t", "at or above 190 t",
    "not exceeding 190 t", "최대 190 t", "190을 넘지 않음 t", "상한 190 t", "minus 0.5 t", "마이너스 0.5 t", "190 thousand t", "190 k t", "19 만 t", "190 t or 191 t", "190", "t", "", "190 t/day", "190 t per day", "190 t-km", "190 us tons", "190 lb", "not 190 t", "190 t 제외", "190 kg 190 t", "190 t–km", "190 t — km", "190 t ／ km", "190 t∕km", "190 t　per km",
]


def test_cases(spark):
    rows = [(i, f, r) for i, (f, r, _) in enumerate(TAKEN)]
    rows += [(100 + i, PRICE, f"EUR {s}1 / tCO2e") for i, s in enumerate(SIGNS)] + [(200 + i, MASS, r) for i, r in enumerate(REFUSED)]
    other = [(PRICE, "87 USD/tCO2e"), (PRICE, "87 EUR"), (PRICE, "EUR 5 USD/tCO2e"), (INTENSITY, "5 kgCO2e/t"), (ENERGY, "5 MWh"), (GAS, "5 m3"), (RATIO, "1.2"), (RATIO, "-0.1"), ("cn_code", "7318-15.90"), ("cn_code", "731815"), ("colour", "1")]
    rows += [(300 + i, *r) for i, r in enumerate(other)]
    out = {r.k: r for r in strict_values(spark.createDataFrame(rows, "k int, field string, raw string"), "k", "raw").collect()}
    assert {i: out[i].value for i in range(len(TAKEN))} == {i: v for i, (_, _, v) in enumerate(TAKEN)}
    assert all(out[100 + i].value == "-1" for i in range(len(SIGNS)))
    wrong = {r: out[200 + i].value for i, r in enumerate(REFUSED) if out[200 + i].error is None}
    assert wrong == {}
    assert [r for i, r in enumerate(other) if out[300 + i].error is None] == []
    assert all((r.error is None) == (r.transformation != "parse_failed") for r in out.values())


@pytest.mark.parametrize("value", ["", None])
def test_blank_texts_are_no_values(spark, value):
    row = strict_values(spark.createDataFrame([(1, "m5_installation_id", value)], "k int, field string, raw string"), "k", "raw").first()
    assert (row.value, row.transformation, row.error) == (None, "trim_blank_to_null", None)
