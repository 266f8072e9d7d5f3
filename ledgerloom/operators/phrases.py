"""Phrases of a list within texts: an array of those found per row, without a join of all texts with all phrases."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import ngrams

#: A list of so many phrases at most is a literal that every row is compared with; longer ones are joined by anchors.
IN_ROW = 1000


def with_phrases(df: DataFrame, keys: list[str], text: Column, phrases: DataFrame, needle: str, found: str, in_row: int = IN_ROW) -> DataFrame:
    """df with the array found of the rows of phrases whose needle occurs in text, in order of their columns.

    keys tell the rows of df apart. Blank needles are never found, null texts hold none. A short list costs no shuffle.
    A longer one meets only texts that have the first two letters of a phrase, by an equi-join.
    """
    row = F.struct(*phrases.columns)
    schema = f"array<{phrases.schema.simpleString()}>"
    few = phrases.distinct().limit(in_row + 1).toJSON().collect()
    if len(few) <= in_row:
        every = F.from_json(F.lit(json.dumps(sorted((json.loads(x) for x in few), key=str), ensure_ascii=False)), schema)
        # The text is bound to a variable, so that it is worked out once and not for every phrase.
        inside = F.transform(F.array(text), lambda t: F.filter(every, lambda p: (p[needle] != "") & t.contains(p[needle])))[0]
        return df.withColumn(found, F.sort_array(F.coalesce(inside, F.array().cast(schema))))
    listed = phrases.distinct().filter(F.col(needle) != "").select(row.alias("#p"), F.substring(needle, 1, 2).alias("#anchor"))
    grams = F.array_distinct(F.concat(ngrams(F.col("#t"), 2), ngrams(F.col("#t"), 1)))
    spread = df.select(*keys, text.alias("#t")).select(*keys, "#t", F.explode(grams).alias("#anchor"))
    hits = spread.join(listed, "#anchor").filter(F.expr(f"contains(`#t`, `#p`.`{needle}`)")).groupBy(*keys).agg(F.sort_array(F.collect_list("#p")).alias("#hits"))
    renamed = hits.select(*(F.col(k).alias(f"#{k}") for k in keys), "#hits")
    same = [F.col(k).eqNullSafe(F.col(f"#{k}")) for k in keys]
    joined = df.join(renamed, same, "left")
    return joined.withColumn(found, F.coalesce("#hits", F.array().cast(schema))).drop("#hits", *(f"#{k}" for k in keys))
