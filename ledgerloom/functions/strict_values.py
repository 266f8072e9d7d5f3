"""Strict field values: exactly one plain number with exactly one understood unit, or a reason why not.

Nothing is guessed: bounds, negations, signs and scales in words, accounting brackets and second dimensions all reject
a value. Only the compatibility view needs Python; the rules are column expressions.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that change what a number means, in the two languages of the documents.
NEGATED = ("not", "해당 ?없음", "아님", "미적용", "제외")
BOUNDS = (
    "at most", "at least", "at or below", "at or above", "up to", "no more than", "no less than", "less than", "more than", "greater than", "under", "over", "above",
    "below", "upper limit", "lower limit", "not exceed", "not exceeding", "maximum", "minimum", "max", "min",
)
BOUNDS_KO = ("이하", "이상", "미만", "초과", "최대", "최소", "넘지 ?않", "상한", "하한")
SIGN_WORDS, SIGN_WORDS_KO = ("minus", "negative"), ("마이너스", "음수")
SCALES, SCALES_KO = ("thousand", "million", "billion", "k"), ("백만", "천", "만")
CURRENCIES = "AUD CAD CHF CNY DKK EUR GBP HKD INR JPY KRW NOK NZD PLN RMB RUB SEK SGD TRY USD ZAR".split()
SLASHES = "∕⁄⧸"


def _words(items: tuple[str, ...]) -> str:
    return r"(?<![A-Za-z])(?:" + "|".join(i.replace(" ", r"\s+") for i in items) + r")(?![A-Za-z])"


# Patterns of numbers, units and currencies; what they accept decides results.
_NEGATED = r"(?i)(?<![A-Za-z0-9_])not(?![A-Za-z0-9_])|" + "|".join(w.replace(" ?", r"\s*") for w in NEGATED[1:])
_BOUNDED = r"(?i)[<>≤≥]|" + _words(BOUNDS) + "|" + "|".join(w.replace(" ?", r"\s*") for w in BOUNDS_KO)
_SIGNED = "(?i)" + _words(SIGN_WORDS) + "|" + "|".join(SIGN_WORDS_KO)
_SCALED = "(?i)" + _words(SCALES) + "|(?<![가-힣])(?:" + "|".join(SCALES_KO) + ")(?![가-힣])"
_PLAIN = r"[-+]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?"
_EDGE = r"[0-9A-Za-z.,+-]"
_TOKEN = rf"(?<!{_EDGE})(?:[-+][ \t]*)?\.?[0-9]{_EDGE}*(?!{_EDGE})"
_BRACKETS = rf"(?<!{_EDGE})\([ \t]*{_PLAIN}[ \t]*\)(?!{_EDGE})"

# Spellings of units by dimension. kg and t (or a ton word) stand over a ton word or kg; carbon is co2 or co2e.
MASSES = ("kg", "kgs", "mt", "t", "tonne", "tonnes", "metric ton", "metric tons")
TON_WORDS = ("t", "ton", "tonne")
CARBON = ("co2", "co2e")
POWERS = tuple(p + u for u in ("wh", "w", "j") for p in ("", "k", "m", "g", "t")) + ("btu",)
VOLUMES = tuple(p + u for u in ("m3", "m³") for p in ("", "n", "s"))
SYMBOLS = "€$£¥￥₩"


def _spelt(words: tuple[str, ...], before: str = "A-Za-z", after: str = "A-Za-z") -> str:
    """A pattern of any of the words, longest first, not beside the characters given."""
    every = "|".join(w.replace(" ", r"\s+") for w in sorted(words, key=lambda w: (-len(w), w)))
    return f"(?<![{before}])(?:{every})(?![{after}])"


_OVER = r"(?:/|per\s*)"
_TOP = "(?:" + "|".join(("kg", "t")) + r")\s*(?:" + "|".join(reversed(CARBON)) + ")"
_BELOW = "(?:" + "|".join(sorted((*TON_WORDS, "kg"), key=len, reverse=True)) + ")"
_UNITS = {
    "mass": "(?i)" + _spelt(MASSES, "0-9A-Za-z", "0-9A-Za-z") + "|톤(?![가-힣])",
    "intensity": rf"(?i)(?<![A-Za-z]){_TOP}\s*{_OVER}{_BELOW}(?![A-Za-z])",
    "price": rf"(?i)(?:/|(?<![A-Za-z])per)\s*{_BELOW}\s*{CARBON[1]}(?![A-Za-z])",
    "energy": "(?i)" + _spelt(POWERS),
    "gas": "(?i)" + _spelt(VOLUMES, after="0-9A-Za-z"),
}
#: Units that need no guess, in lower case without spaces.
_ACCEPTED = {
    "mass": [*(w.replace(" ", "") for w in MASSES), "톤"],
    "intensity": [f"t{c}{o}{t}" for c in CARBON for o in ("/", "per") for t in TON_WORDS],
    "price": [f"{o}{t}{CARBON[1]}" for o in ("/", "per") for t in TON_WORDS],
    "energy": ["kwh"], "gas": ["nm3", "nm³"],
}
_CURRENCY = "(?i)" + _spelt(tuple(CURRENCIES)) + f"|[{SYMBOLS}]"
_OTHER_TONS = "(?i)" + _spelt(tuple(f"{kind} {word}" for kind in ("us", "short", "long", "imperial") for word in ("ton", "tons", "tonne", "tonnes")))
_COMMON = {"mass": "t", "intensity": "tCO2e/t", "price": "EUR/tCO2e", "ratio": "ratio", "energy": "kWh", "gas": "Nm3"}


def _view(t: str) -> str:
    plain = unicodedata.normalize("NFKC", t)
    return "".join("/" if c in SLASHES else "-" if unicodedata.category(c) == "Pd" or "MINUS SIGN" in unicodedata.name(c, "") else c for c in plain)


@F.pandas_udf(StringType())
def plain_view(text: pd.Series) -> pd.Series:
    """NFKC with one slash and one minus."""
    return text.map(lambda t: None if t is None else _view(t))


@F.pandas_udf(StringType())
def numeric_view(text: pd.Series) -> pd.Series:
    """plain_view, or null if a superscript, circled or other such digit carries meaning."""

    def view(t: str | None) -> str | None:
        if t is None:
            return None
        for i, c in enumerate(t):
            if unicodedata.category(c) == "No" and not (c == "³" and t[max(0, i - 2) : i].lower() == "nm"):
                return None
        return _view(t)

    return text.map(view)


def _beyond_ascii(udf, text: Column) -> Column:
    """udf of texts with other characters than ASCII; all others are their own view and stay in the JVM."""
    other = text.rlike("[^\\x00-\\x7F]")
    return F.when(other, udf(F.when(other, text))).otherwise(text)


def _kind() -> Column:
    f = F.col("field")
    return (
        F.when(f.endswith("_mass_t"), "mass").when(f.endswith("_intensity_tco2e_per_t"), "intensity").when(f.endswith("_eur_per_tco2e"), "price")
        .when(f == "scenario_exposure_factor", "ratio").when(f == "electricity_kwh", "energy").when(f == "lng_nm3", "gas").when(f == "cn_code", "code")
        .when(f == "verification_reference", "reference").when(f.endswith("_installation_id") | f.endswith("_production_process"), "name")
    )


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def strict_values(df: DataFrame, key: str, value: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, field, value, unit, transformation, error, carry of rows with a field and a raw value.

    A rejected value is null with the transformation parse_failed and the first reason; numbers are decimals of 18
    digits after the point as canonical text. Fields that no rule knows are rejected as unknown_field.
    """
    carried = F.struct(*carry) if carry else F.lit(None)
    raw = df.select(key, "field", F.coalesce(value, F.lit("")).alias("raw"), _kind().alias("kind"), carried.alias("#carried"))
    rows = raw.withColumn("view", _beyond_ascii(numeric_view, F.col("raw")))
    number = F.col("kind").isin("mass", "intensity", "price", "ratio", "energy", "gas")
    tokens = _all(F.col("view"), _TOKEN)
    number_error = (
        F.when(F.col("view").isNull(), "compatibility_number").when(F.col("view").rlike(_NEGATED), "negated").when(F.col("view").rlike(_BOUNDED), "bounded")
        .when(F.col("view").rlike(_SIGNED), "word_signed").when(F.col("view").rlike(_SCALED), "scaled").when(F.col("view").rlike(_BRACKETS), "accounting")
        .when(F.size(tokens) == 0, "no_number").when(F.exists(tokens, lambda t: ~t.rlike(f"^{_PLAIN}$")), "malformed_number").when(F.size(tokens) > 1, "several_numbers")
    )
    found = F.array().cast("array<string>")
    tail, accepted = F.lit(""), F.array().cast("array<string>")
    for kind in _UNITS:
        here = F.col("kind") == kind
        found = F.when(here, F.regexp_extract_all("raw", F.lit(_UNITS[kind]), F.lit(0))).otherwise(found)
        tail = F.when(here, F.regexp_extract("raw", "(?is)(?:" + _UNITS[kind].removeprefix("(?i)") + ")(.*)$", 1)).otherwise(tail)
        accepted = F.when(here, F.array(*map(F.lit, _ACCEPTED[kind]))).otherwise(accepted)
    # What stands behind a unit is looked at as the number is, so that no dash or slash goes unnoticed.
    rows = rows.withColumn("tail", _beyond_ascii(plain_view, tail))
    unit = F.regexp_replace(F.lower(F.get(found, F.lit(0))), r"\s+", "")
    currencies = _all(F.col("raw"), _CURRENCY)
    unit_error = (
        F.when((F.col("kind") == "mass") & F.col("raw").rlike(_OTHER_TONS), "non_metric")
        .when((F.col("kind") == "price") & (F.size(currencies) != 1), "currency_missing_or_ambiguous")
        .when((F.col("kind") == "price") & ~F.lower(F.get(currencies, F.lit(0))).isin("eur", "€"), "other_currency")
        .when((F.col("kind") != "ratio") & (F.size(found) == 0), "unit_missing").when(F.size(found) > 1, "unit_ambiguous")
        .when(F.col("tail").rlike(r"(?i)^[\s\p{Z}]*(?:[/-]|per)"), "compound_unit").when((F.col("kind") != "ratio") & ~F.array_contains(accepted, unit), "other_unit")
    )
    decimal = F.regexp_replace(F.get(tokens, F.lit(0)), "[, \t]", "").try_cast("decimal(38,18)")
    divisor = F.when((F.col("kind") == "mass") & unit.isin("kg", "kgs"), "0.001").when((F.col("kind") == "ratio") & F.col("raw").contains("%"), "0.01").otherwise("1")
    scaled = (decimal.cast("decimal(30,15)") * divisor.cast("decimal(4,3)")).cast("decimal(38,18)")
    range_error = F.when((F.col("kind") == "ratio") & ~scaled.between(0, 1), "out_of_range")
    squeezed = F.trim(F.regexp_replace("raw", r"[\s\p{Z}]+", " "))
    code_error = F.when(~squeezed.rlike(r"^(?:[0-9]{8}|[0-9]{4}([ .-])[0-9]{2}\1[0-9]{2})$"), "invalid_code")
    error = F.when(number, F.coalesce(number_error, unit_error, range_error)).when(F.col("kind") == "code", code_error).when(F.col("kind").isNull(), "unknown_field")
    text = scaled.cast("string")
    plain = F.regexp_replace(F.regexp_replace(text, "(\\.[0-9]*?)0+$", "$1"), "\\.$", "")
    taken = F.when(number, plain).when(F.col("kind") == "code", F.regexp_replace(squeezed, "[^0-9]", "")).when(F.col("kind") == "reference", squeezed).otherwise(F.upper(squeezed))
    change = (
        F.when(F.col("kind") == "mass", F.when(unit.isin("kg", "kgs"), "kg_to_t").otherwise("identity_tonnes")).when(F.col("kind") == "intensity", "normalize_emission_intensity_unit")
        .when(F.col("kind") == "price", "normalize_eur_per_tco2e").when(F.col("kind") == "ratio", F.when(F.col("raw").contains("%"), "percent_to_ratio").otherwise("identity_ratio"))
        .when(F.col("kind") == "energy", "normalize_kwh").when(F.col("kind") == "gas", "normalize_nm3").when(F.col("kind") == "code", "strip_non_digits")
        .when((squeezed == "") | (F.col("kind") == "reference"), "trim_blank_to_null").otherwise("trim_and_uppercase")
    )
    common = F.create_map(*(F.lit(x) for pair in _COMMON.items() for x in pair))
    judged = rows.select("#carried", key, "field", error.alias("error"), taken.alias("taken"), common[F.col("kind")].alias("common"), change.alias("change"))
    fine = F.col("error").isNull()
    return judged.select(
        key, "field", F.when(fine, F.nullif("taken", F.lit(""))).alias("value"), F.when(fine, F.col("common")).alias("unit"),
        F.when(fine, F.col("change")).otherwise("parse_failed").alias("transformation"), "error", *(F.col(f"#carried.{c}").alias(c) for c in carry),
    )
