"""Strict JSON: duplicate keys, NaN, infinities, overflowing numbers and trailing text are errors, not values."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType


def _no_constant(name: str) -> object:
    raise ValueError(f"{name} is no JSON number")


def _finite(text: str) -> float:
    value = float(text)
    if math.isinf(value):
        raise ValueError(f"{text} is too large")
    return value


def _unique(pairs: list[tuple[str, object]]) -> dict[str, object]:
    keys = [k for k, _ in pairs]
    if len(set(keys)) != len(keys):
        raise ValueError("a key occurs twice in one object")
    return dict(pairs)


def loads(text: str | bytes) -> object:
    """One strict JSON value."""
    if isinstance(text, bytes):
        text = text.decode("utf-8")
    return json.loads(text, object_pairs_hook=_unique, parse_constant=_no_constant, parse_float=_finite)


@F.pandas_udf(StringType())
def json_error(text: pd.Series) -> pd.Series:
    """Why a text is no strict JSON, or null."""

    def error(t: str | None) -> str | None:
        if t is None:
            return "no text"
        try:
            loads(t)
        except (ValueError, RecursionError) as e:
            return str(e)
        return None

    return text.map(error)


def read_strict(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """path, error, value of whole JSON files: value is null where there is an error."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    checked = files.withColumn("error", json_error("value"))
    return checked.select("path", "error", F.when(F.col("error").isNull(), F.from_json("value", schema)).alias("value"))
