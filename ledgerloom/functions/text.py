"""Text functions as column expressions; Unicode forms, which Spark lacks, as an Arrow-batched pandas UDF."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TOKEN = "[0-9a-z가-힣]+"


def squeeze_upper(text: Column) -> Column:
    """White space squeezed and trimmed, upper case, blank as null."""
    return F.nullif(F.upper(F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))), F.lit(""))


def search_form(text: Column) -> Column:
    """Lower case with every run of other characters than letters and digits of the search alphabet as one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^0-9a-z가-힣]+", " "))


@F.pandas_udf(StringType())
def compatibility_fold(text: pd.Series) -> pd.Series:
    """NFKC and case folding."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    """NFC with squeezed white space."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", t).split()))


def folded(text: Column) -> Column:
    """NFKC and case folding; only texts with other letters than ASCII and whole Hangul leave the JVM."""
    return F.coalesce(compatibility_fold(F.when(text.rlike("[^\\x00-\\x7F가-힣]"), text)), F.lower(text))


def folded_form(text: Column) -> Column:
    """search_form of the folded text."""
    return search_form(folded(text))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def ngrams(word: Column, size: int) -> Column:
    """All substrings of size characters of a word."""
    places = F.sequence(F.lit(1), F.length(word) - size + 1)
    return F.when(F.length(word) >= size, F.transform(places, lambda i: F.substring(word, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whether a phrase occurs: an ASCII one at token boundaries, any other anywhere; an empty one never."""
    escaped = F.concat(F.lit(r"(?<![0-9a-z])\Q"), phrase, F.lit(r"\E(?![0-9a-z])"))
    ascii_only = ~phrase.rlike(r"[^\x00-\x7f]")
    return (phrase != "") & text.contains(phrase) & (~ascii_only | F.regexp_like(text, escaped))
