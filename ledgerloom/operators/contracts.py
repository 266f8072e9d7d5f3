"""Contracts over records, lines, cases and reference entries: errors are rows, not exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import folded_form
from ledgerloom.operators.evidence import BLANKS, document_hashes
from ledgerloom.session import small


def provenance_error() -> Column:
    """The first broken link of a record's lineage, or null: all lineage fields together, spans in order, label in any case
    and value (or a mark of a blank) as stated, hash of the line as stated, hash of the document well formed."""
    s = F.col("source_span")
    fields = ("raw_line", "line_sha256", "document_sha256", "source_span")
    given = sum((F.col(c).isNotNull().cast("int") for c in fields), F.lit(0))
    alias = F.substring("raw_line", s["alias_start"] + 1, s["alias_end"] - s["alias_start"])
    value = F.substring("raw_line", s["value_start"] + 1, s["value_end"] - s["value_start"])
    ordered = (s["alias_start"] >= 0) & (s["alias_start"] < s["alias_end"]) & (s["alias_end"] <= s["value_start"]) & (s["value_start"] <= s["value_end"]) & (s["value_end"] <= F.length("raw_line"))
    return (
        F.when(given == 0, "no_lineage").when(given < len(fields), "partial_lineage").when(~F.coalesce(ordered, F.lit(False)), "span_out_of_order")
        .when(~F.lower(alias).eqNullSafe(F.lower("raw_label")), "label_differs").when((F.coalesce("raw_value", F.lit("")) != "") & (value != F.col("raw_value")), "value_differs")
        .when((F.coalesce("raw_value", F.lit("")) == "") & ~F.lower(F.trim(value)).isin(*BLANKS), "value_not_blank")
        .when(F.sha2("raw_line", 256) != F.col("line_sha256"), "line_hash_differs").when(~F.col("document_sha256").rlike("^[0-9a-f]{64}$"), "document_hash_malformed")
    )


def against_lines(records: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """state, records: whether the line a record names is there, and reads as the record has it."""
    named = lines.groupBy(*keys).agg(F.min("text").alias("text"), F.count("*").alias("copies"))
    joined = records.join(named, keys, "left")
    state = (
        F.when(F.col("copies").isNull(), "no_line").when(F.col("copies") > 1, "several_lines").when(F.col("raw_line").isNull(), "no_text")
        .when(F.col("raw_line") == F.col("text"), "same").otherwise("differs")
    )
    return joined.groupBy(state.alias("state")).agg(F.count("*").alias("records"))


def case_errors(cases: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """key, error of evaluation cases: unknown, repeated or overlapping ids, or a kind that contradicts its ids."""
    known = small(corpus.select(F.col("id").alias("known")).distinct())
    named = cases.select(key, F.explode(F.array_union("expected_ids", "forbidden_ids")).alias("id"))
    unknown = named.join(known, F.col("id") == F.col("known"), "left_anti").select(key, F.lit("unknown_id").alias("error"))
    rules = {
        "repeated_id": F.size(F.array_distinct("expected_ids")) < F.size("expected_ids"),
        "overlapping_ids": F.arrays_overlap("expected_ids", "forbidden_ids"),
        "positive_without_ids": (F.col("case_type") == "positive") & (F.size("expected_ids") == 0),
        "negative_with_ids": (F.col("case_type") != "positive") & (F.size("expected_ids") > 0),
        "blank_query": F.coalesce(F.trim("query") == "", F.lit(True)),
    }
    found = F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules.items())))
    return cases.select(key, F.explode(found).alias("error")).unionByName(unknown).distinct()


def alias_errors(corpus: DataFrame) -> DataFrame:
    """id, alias of aliases that are blank or stand for two concepts of one entry after normalisation."""
    aliases = corpus.select("id", F.explode("concepts").alias("concept", "aliases")).select("id", "concept", F.explode("aliases").alias("a"))
    plain = aliases.select("id", "concept", folded_form(F.col("a")).alias("alias"))
    counts = plain.groupBy("id", "alias").agg(F.countDistinct("concept").alias("concepts"))
    return counts.filter((F.col("alias") == "") | (F.col("concepts") > 1)).select("id", "alias")


def document_errors(lines: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """keys, error of documents that their lines do not reproduce: another number of lines than stated, a line that is
    malformed (numbers from 1, a text, a confidence within 0 to 1) or occurs twice, or another content hash.

    lines has keys, page, line, text, confidence; manifest has keys, lines, sha256.
    """
    fine = (F.col("page") >= 1) & (F.col("line") >= 1) & F.col("text").isNotNull() & F.col("confidence").between(0, 1) & ~F.isnan("confidence")
    shape = lines.groupBy(*keys).agg(F.count_if(~F.coalesce(fine, F.lit(False))).alias("#bad"), (F.count("*") - F.countDistinct("page", "line")).alias("#twice"))
    again = document_hashes(lines, keys).select(*keys, F.col("lines").alias("#lines"), F.col("sha256").alias("#sha")).join(shape, keys)
    error = (
        F.when(F.col("#lines").isNull() | (F.col("#lines") != F.col("lines")), "line_count_differs").when(F.col("#bad") > 0, "malformed_line")
        .when(F.col("#twice") > 0, "line_repeated").when(F.col("#sha") != F.col("sha256"), "content_differs")
    )
    joined = manifest.select(*keys, "lines", "sha256").join(again, keys, "left")
    return joined.select(*keys, error.alias("error")).filter("error IS NOT NULL")


def reused_queries(holdout: DataFrame, development: DataFrame, key: str, text: str) -> DataFrame:
    """key, development_key of held-out cases whose query is, in search form, one of the development cases; blank ones never are."""
    form = folded_form(F.col(text))
    own = holdout.select(key, form.alias("form")).filter("form <> ''")
    other = development.select(F.col(key).alias("development_key"), form.alias("form")).filter("form <> ''")
    return own.join(other, "form").select(key, "development_key").distinct()
