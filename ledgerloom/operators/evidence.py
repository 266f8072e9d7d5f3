"""From document lines to field candidates: flattening, label matching, values with spans, hashes and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import composed
from ledgerloom.operators.phrases import with_phrases

# Characters between a label and its value, and texts that stand for no value.
LEADING = " \t:：=|"
BLANKS = ("-", "n/a", "[blank]", "공란", "")
_WORD = r"[\p{L}\p{N}_]"


def bundle_lines(documents: DataFrame) -> DataFrame:
    """doc_key, case_id, document_id, document_type, page, line, text, confidence: one row per line of nested bundles."""
    keys = ["doc_key", "case_id", "document_id", "document_type"]
    pages = documents.select(*keys, F.explode("pages").alias("p"))
    lines = pages.select(*keys, F.col("p.page").alias("page"), F.explode("p.lines").alias("l"))
    return lines.select(*keys, "page", F.col("l.line").alias("line"), F.col("l.text").alias("text"), F.col("l.confidence").alias("confidence"))


def text_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, text: non-blank lines of a text, numbered from 1 after blank lines are dropped."""
    parts = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return df.select(key, F.posexplode(parts).alias("n", "text")).select(key, (F.col("n") + 1).alias("line"), "text")


def pages_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, page, line, text of plain text with form feeds: pages count even when empty, blank lines are dropped."""
    splits = r"\r\n|[\n\r\x0b\x1c-\x1e\x85  ]"
    pages = df.select(key, F.posexplode(F.split(text, "\f")).alias("p", "body"))
    lines = F.filter(F.split("body", splits), lambda x: F.trim(x) != "")
    return pages.select(key, (F.col("p") + 1).alias("page"), F.posexplode(lines).alias("n", "text")).select(
        key, "page", (F.col("n") + 1).alias("line"), "text"
    )


def match_labels(lines: DataFrame, labels: DataFrame, keys: list[str], text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """keys, carry, label, field, start, reason: the leading label of each line; keys tell lines apart.

    Labels are found anywhere, in any case, at word boundaries. Of those preceded only by white space the longest wins
    (then start, then label); any other that does not lie inside the winner makes the line ambiguous. reason is null for
    a match, else 'no configured label' or 'multiple configured labels'. All is judged within the row: a list of labels
    that is short enough to be a literal costs no shuffle.
    """
    terms = labels.select("label", F.col("field").alias("label_field"), F.lower("label").alias("needle"))
    kept = [*keys, *(c for c in carry if c not in keys)]
    rows = lines.select(*kept, F.lower(F.col(text)).alias("#low"))
    rows = with_phrases(rows, keys, F.col("#low"), terms, "needle", "#near")
    place = lambda p, i: F.struct((-F.length(p["needle"])).alias("neg"), i.alias("at"), p["label"].alias("label"), p["label_field"].alias("field"))
    alone = lambda low, p, i: ~_is_word(low, i - 1) & ~_is_word(low, i + F.length(p["needle"]))
    spots = lambda low, p: F.filter(_occurrences(low, p["needle"]), lambda i: alone(low, p, i))
    hits = F.transform(F.array("#low"), lambda low: F.flatten(F.transform("#near", lambda p: F.transform(spots(low, p), lambda i: place(p, i)))))[0]
    # Generated, not projected: what is built on it then never works it out again, filters least of all.
    rows = rows.withColumn("#hits", F.explode(F.array(F.coalesce(hits, F.array().cast("array<struct<neg:int,at:int,label:string,field:string>>")))))
    leading = lambda h: F.substring("#low", F.lit(1), h["at"] - 1).rlike(r"^[\s\p{Z}]*$")
    rows = rows.withColumn("#best", F.array_min(F.filter("#hits", leading)))
    inside = lambda h: (h["at"] >= F.col("#best.at")) & (h["at"] - h["neg"] <= F.col("#best.at") - F.col("#best.neg"))
    extra = F.exists("#hits", lambda h: ~inside(h))
    rows = rows.withColumn("#reason", F.when(F.col("#best").isNull(), "no configured label").when(extra, "multiple configured labels"))
    fine = F.col("#reason").isNull()
    return rows.select(
        *kept, F.when(fine, F.col("#best.label")).alias("label"), F.when(fine, F.col("#best.field")).alias("field"),
        F.when(fine, F.col("#best.at") - 1).alias("start"), F.col("#reason").alias("reason"),
    )


def _occurrences(text: Column, needle: Column) -> Column:
    """1-based places of all, also overlapping, occurrences."""
    spots = F.sequence(F.lit(1), F.greatest(F.length(text) - F.length(needle) + 1, F.lit(1)))
    return F.filter(spots, lambda i: F.substring(text, i, F.length(needle)) == needle)


def _is_word(text: Column, place: Column) -> Column:
    return (place >= 1) & F.coalesce(F.substring(text, place, F.lit(1)).rlike(_WORD), F.lit(False))


def raw_value(text: Column, after: Column) -> tuple[Column, Column, Column]:
    """(value, start, end) of what follows a label that ends at code point after: separators skipped, trimmed, blanks empty."""
    rest = F.substring(text, after + 1, F.length(text))
    body = F.regexp_replace(rest, "^[ \t:：=|]+", "")
    value = F.rtrim(body)
    start = after + F.length(rest) - F.length(body)
    return F.when(F.lower(value).isin(*BLANKS), "").otherwise(value), start, start + F.length(value)


def evidence_id(document: Column, page: Column, line: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(document), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.format_string("ev-%s-p%02d-l%03d", slug, page, line)


def document_hashes(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lines, pages, sha256: hash of the ordered [page,line,confidence,text] records of each document."""
    record = F.concat(
        F.lit("["), F.col("page"), F.lit(","), F.col("line"), F.lit(","), F.coalesce(F.col("confidence").cast("string"), F.lit("null")), F.lit(","), F.col("text"), F.lit("]")
    )
    ordered = F.array_sort(F.collect_list(F.struct("page", "line", record.alias("record"))))
    return lines.groupBy(*keys).agg(
        F.count("*").alias("lines"), F.countDistinct("page").alias("pages"), F.sha2(F.concat_ws("\n", ordered["record"]), 256).alias("sha256")
    )


def auto_numbers(df: DataFrame, page: list[str], order: list[str], number: str) -> DataFrame:
    """df with state: an explicit number raises the running number of its page to itself, a missing one adds 1.

    Closed form over one window: with k the missing numbers so far, state = k + max(0, running max of number - k).
    """
    w = Window.partitionBy(*page).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    missing = F.count_if(F.col(number).isNull()).over(w)
    counted = df.withColumn("#k", missing)
    return counted.withColumn("state", F.col("#k") + F.greatest(F.lit(0), F.coalesce(F.max(F.col(number) - F.col("#k")).over(w), F.lit(0)))).drop("#k")


def words_to_lines(words: DataFrame, line: list[str], order: str, text: str, confidence: str) -> DataFrame:
    """line keys, text (words in order), confidence (mean of percents, 6 digits half-even)."""
    ordered = F.array_sort(F.collect_list(F.struct(order, text)))
    return words.groupBy(*line).agg(
        F.concat_ws(" ", ordered[text]).alias("text"), F.bround(F.avg(F.col(confidence) / 100), 6).alias("confidence"), F.count("*").alias("words")
    )


def field_scores(predicted: DataFrame, expected: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and outcome (match, mismatch, missing, spurious) of a full outer join of two keyed relations."""
    p = predicted.select(*keys, F.col(value).alias("#p"), F.lit(True).alias("#in_p"))
    e = expected.select(*keys, F.col(value).alias("#e"), F.lit(True).alias("#in_e"))
    outcome = (
        F.when(F.col("#in_p").isNull(), "missing").when(F.col("#in_e").isNull(), "spurious")
        .when(F.col("#p").eqNullSafe(F.col("#e")), "match").otherwise("mismatch")
    )
    return p.join(e, keys, "full").select(*keys, outcome.alias("outcome"))


def score_summary(outcomes: DataFrame) -> DataFrame:
    """tp, fp, fn and precision, recall, f1 of field_scores: a mismatch is both a false positive and a false negative."""
    counts = outcomes.agg(
        F.count_if(F.col("outcome") == "match").alias("tp"),
        F.count_if(F.col("outcome").isin("mismatch", "spurious")).alias("fp"),
        F.count_if(F.col("outcome").isin("mismatch", "missing")).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "tp", "fp", "fn", F.bround(F.try_divide(tp, tp + fp), 6).alias("precision"), F.bround(F.try_divide(tp, tp + fn), 6).alias("recall"),
        F.bround(F.try_divide(2 * tp, 2 * tp + fp + fn), 6).alias("f1"),
    )


def error_buckets(predicted: DataFrame, expected: DataFrame, keys: list[str], value: str, confidence: str) -> DataFrame:
    """outcome, n, mean_confidence (6 digits half-even, null for missing ones) of two keyed relations.

    Values are compared composed and with white space squeezed, in their case.
    """
    p = predicted.select(*keys, composed(F.col(value)).alias("v"), confidence)
    e = expected.select(*keys, composed(F.col(value)).alias("v"))
    outcomes = field_scores(p, e, keys, "v").join(p.select(*keys, confidence), keys, "left")
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"), F.bround(F.avg(confidence), 6).alias("mean_confidence"))
