"""Queries of the general data problems that belong to the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators import rejects, units
from ledgerloom.session import materialise, table

Query = Callable[[SparkSession, str], DataFrame]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.rejected(table(spark, sf_dir, "scene_lines")).select("raw_id")


def p3_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.accepted(table(spark, sf_dir, "scene_lines"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.equal_statements(materialise(units.stated_quantities(table(spark, sf_dir, "candidates")), "quantities"))


def p4_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.convert_quantities(table(spark, sf_dir, "candidates"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p3_found, p3_pixels, p4_found, p4_converted)}

_DIGITS = r'("[0-9]+"|[0-9]+)'
_BAND = r'("[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?"|[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?)'
_LABEL = '("(clear|cloud|shadow)"|clear|cloud|shadow)'
_RECORD = ",".join((_DIGITS, _DIGITS, _BAND, _BAND, _LABEL, _BAND, _BAND, _LABEL))
_GOOD = (
    f"coalesce(regexp_full_match(raw_text, '{_RECORD}') AND list_bool_and(list_transform([3, 4, 6, 7], "
    "lambda i: try_cast(string_split(replace(raw_text, '\"', ''), ',')[i] AS DOUBLE) BETWEEN 0 AND 1 "
    "OR try_cast(string_split(replace(raw_text, '\"', ''), ',')[i] AS DOUBLE) = -9999)), false)"
)

SQL: dict[str, str] = {
    "p3_found": f"SELECT raw_id FROM scene_lines WHERE NOT {_GOOD}",
    "p3_pixels": f"""
        WITH good AS (SELECT raw_id, string_split(replace(raw_text, '"', ''), ',') AS c FROM scene_lines WHERE {_GOOD})
        SELECT raw_id, try_cast(c[1] AS BIGINT) AS row, try_cast(c[2] AS BIGINT) AS col, c[3]::DOUBLE AS red_before, c[4]::DOUBLE AS nir_before,
               c[5] AS qa_before, c[6]::DOUBLE AS red_after, c[7]::DOUBLE AS nir_after, c[8] AS qa_after FROM good""",
}
