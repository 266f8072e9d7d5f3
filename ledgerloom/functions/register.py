"""Registration of the functions that SQL text may call."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ledgerloom.functions import strict_values, text


def register(spark: SparkSession) -> None:
    """compatibility_fold, composed and numeric_view as SQL functions; word_grams(text) is a table function of built-in
    functions: all 2- and 3-grams of the words of a text."""
    spark.udf.register("compatibility_fold", text.compatibility_fold)
    spark.udf.register("composed", text.composed)
    spark.udf.register("numeric_view", strict_values.numeric_view)
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION word_grams(value STRING) RETURNS TABLE(gram STRING, size INT) RETURN SELECT g.gram, g.size FROM (SELECT explode("
        f"flatten(transform(regexp_extract_all(lower(value), '{text.TOKEN}', 0), w -> flatten(transform(array(2, 3), n -> "
        "transform(filter(sequence(1, greatest(length(w) - n + 1, 1)), i -> i <= length(w) - n + 1), i -> struct(substring(w, i, n) AS gram, n AS size))))))) AS g)"
    )
