"""Strict numbers, exact unit conversion and display forms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = r"[+-]?[0-9][0-9,]*(?:\.[0-9]+)?"
_STRICT = r"^[+-]?(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)(?:\.[0-9]+)?$"
_BOUNDED = r"[<>≤≥~±]|약|(?i)\b(about|approx|ca|circa)\b"


def strict_number(text: Column) -> tuple[Column, Column]:
    """(error, decimal): exactly one plain number, unbounded; error is blank, no_number, bounded, several_numbers or malformed."""
    token = F.regexp_extract(text, _TOKEN, 0)
    several = F.size(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))) > 1
    strict = token.rlike(_STRICT)
    error = (
        F.when(F.trim(text) == "", "blank").when(~text.rlike("[0-9]"), "no_number").when(text.rlike(_BOUNDED), "bounded")
        .when(several, "several_numbers").when(~strict, "malformed")
    )
    number = F.regexp_replace(token, ",", "").try_cast("decimal(38,10)")
    return error, F.when(strict & ~several & ~text.rlike(_BOUNDED), number)


# Units of mass that are understood without a guess.
KILOGRAMS, TONNES = ("kg", "kgs", "KG"), ("t", "MT", "tonnes", "톤", "metric tons")


def to_tonnes(unit: Column, value: Column) -> tuple[Column, Column]:
    """(transformation, tonnes): kilograms are scaled exactly, in decimals; any other unit is unsupported, with no value."""
    kilograms, tonnes = unit.isin(*KILOGRAMS), unit.isin(*TONNES)
    number = value.try_cast("decimal(28,10)")
    scaled = (number * F.lit("0.001").cast("decimal(4,3)")).cast("decimal(38,13)")
    change = F.when(kilograms, "kg_to_t").when(tonnes, "identity_tonnes").otherwise("unsupported")
    return change, F.when(kilograms, scaled).when(tonnes, number.cast("decimal(38,13)"))


def plain(number: Column) -> Column:
    """Canonical text of a decimal: no exponent, no trailing zeros."""
    text = number.cast("string")
    return F.when(text.contains("."), F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)


def half_up(number: Column, digits: int) -> Column:
    return F.round(number, digits)


def rate(part: Column, whole: Column, digits: int = 6) -> Column:
    """part / whole rounded half-even, null where whole is 0."""
    return F.bround(F.try_divide(part, whole), digits)
