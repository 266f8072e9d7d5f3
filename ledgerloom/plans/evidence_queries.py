"""Evidence operators on candidates, trade documents, documents and scene lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import numeric, strict_values, text
from ledgerloom.operators import evidence, pipelines, winners
from ledgerloom.plans.registry import SPACE, Registry
from ledgerloom.session import small, table

registry = Registry()
query = registry.query

_VALID_SQL = (
    "coalesce(confidence BETWEEN 0 AND 1 AND NOT isnan(confidence) AND lower(trim(normalized_value)) NOT IN ('', '-', 'n/a', '[blank]', '공란'), false)"
)
_RECORDS_SQL = f"""records AS (
    SELECT DISTINCT ON (cand_id) cand_id, case_id, field, sequence, document, coalesce(document_type, 'unknown') AS kind,
           CASE WHEN isnan(confidence) THEN NULL ELSE confidence END AS confidence, normalized_value, {_VALID_SQL} AS valid
    FROM candidates WHERE field IS NOT NULL ORDER BY cand_id, ingested_at DESC),
ranks AS (
    SELECT r.*, coalesce(o.authority_rank, g.authority_rank, 10) AS rank
    FROM records r
    LEFT JOIN source_authority o ON o.field = r.field AND o.document_type = r.kind
    LEFT JOIN source_authority g ON g.field IS NULL AND g.document_type = r.kind)"""
_ORDER_SQL = "valid DESC, rank DESC, confidence DESC NULLS LAST, sequence, cand_id"


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    """Field candidates once each, with validity and rank by two-level fallback."""
    rows = table(spark, d, "candidates").filter("field IS NOT NULL")
    value = F.lower(F.trim("normalized_value"))
    ok = F.coalesce(F.col("confidence").between(0, 1) & ~F.isnan("confidence") & ~value.isin(*evidence.BLANKS), F.lit(False))
    rows = rows.select(
        "cand_id", "case_id", "field", "sequence", "document", F.coalesce("document_type", F.lit("unknown")).alias("kind"),
        F.when(~F.isnan("confidence"), F.col("confidence")).alias("confidence"), "normalized_value", ok.alias("valid"), "ingested_at",
    )
    once = winners.latest_delivery(rows, "cand_id", "ingested_at").drop("ingested_at")
    return winners.fallback_rank(once, table(spark, d, "source_authority"), "field", "kind", 10)


def _best() -> Column:
    """The same order as one value, greatest first."""
    return F.struct("valid", "rank", F.coalesce("confidence", F.lit(-1e9)), -F.col("sequence").cast("long"), -F.col("cand_id"))


def _order() -> list:
    return [F.col("valid").desc(), F.col("rank").desc(), F.col("confidence").desc_nulls_last(), F.col("sequence").asc(), F.col("cand_id").asc()]


@query(f"""WITH {_RECORDS_SQL}, n AS (
    SELECT *, row_number() OVER (PARTITION BY case_id, field ORDER BY {_ORDER_SQL}) AS p, count(*) OVER (PARTITION BY case_id, field) AS candidates FROM ranks)
SELECT case_id, field, cand_id, normalized_value, CAST(rank AS INT) AS rank, candidates FROM n WHERE p = 1""")
def select_winner(spark: SparkSession, d: str) -> DataFrame:
    return winners.winners(_ranks(spark, d), ["case_id", "field"], _best(), ["cand_id", "normalized_value", "rank"])


@query(f"""WITH {_RECORDS_SQL}
SELECT case_id, field, cand_id, row_number() OVER w AS position, count(*) OVER (PARTITION BY case_id, field) AS candidates,
       row_number() OVER w = 1 AS selected FROM ranks WINDOW w AS (PARTITION BY case_id, field ORDER BY {_ORDER_SQL})""")
def candidate_ledger(spark: SparkSession, d: str) -> DataFrame:
    rows = winners.ranked(_ranks(spark, d), ["case_id", "field"], _order())
    return rows.select("case_id", "field", "cand_id", "position", "candidates", "selected")


@query(f"WITH {_RECORDS_SQL} SELECT cand_id, field, kind, CAST(rank AS INT) AS rank FROM ranks")
def authority_fallback(spark: SparkSession, d: str) -> DataFrame:
    return _ranks(spark, d).select("cand_id", "field", "kind", "rank")


@query(f"""WITH {_RECORDS_SQL}, w AS (
    SELECT *, CASE WHEN valid THEN normalized_value END AS v,
           first_value(CASE WHEN valid THEN normalized_value END) OVER o AS winner, row_number() OVER o AS n
    FROM ranks WINDOW o AS (PARTITION BY case_id, field ORDER BY {_ORDER_SQL})),
d AS (SELECT *, abs(try_cast(v AS DECIMAL(28,10)) - try_cast(winner AS DECIMAL(28,10))) AS gap,
             n > 1 AND v IS NOT NULL AND winner IS NOT NULL AND v <> winner AS other FROM w)
SELECT case_id, field, count(*) AS candidates, count(*) FILTER (WHERE other AND NOT coalesce(gap <= 0.1, false)) AS material,
       count(*) FILTER (WHERE other AND coalesce(gap <= 0.1, false)) AS equivalent, CAST(max(gap) FILTER (WHERE other) AS DOUBLE) AS largest_difference
FROM d GROUP BY 1, 2""")
def conflict_partition(spark: SparkSession, d: str) -> DataFrame:
    rows = _ranks(spark, d).withColumn("v", F.when(F.col("valid"), F.col("normalized_value")))
    return winners.conflicts(rows, ["case_id", "field"], _best(), "cand_id", "v", F.lit(0.1).cast("decimal(4,2)"))


@query(f"""WITH {_RECORDS_SQL}, r AS (SELECT DISTINCT field FROM field_labels), c AS (SELECT DISTINCT case_id FROM candidates),
h AS (SELECT DISTINCT case_id, field FROM records WHERE valid)
SELECT c.case_id, r.field, h.field IS NOT NULL AS passed FROM c CROSS JOIN r LEFT JOIN h ON h.case_id = c.case_id AND h.field = r.field""")
def required_fields_ledger(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "candidates").select("case_id")
    return winners.required_ledger(cases, table(spark, d, "field_labels"), _ranks(spark, d).filter("valid"), "case_id", "field")


@query("""SELECT raw_label, count(DISTINCT cand_id) AS records FROM candidates c
WHERE NOT EXISTS (SELECT 1 FROM field_labels l WHERE l.label = c.raw_label) GROUP BY 1""")
def unknown_label_rejects(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "field_labels").select(F.col("label").alias("raw_label"))
    rows = table(spark, d, "candidates").select("raw_label", "cand_id")
    return rows.join(small(labels), "raw_label", "left_anti").groupBy("raw_label").agg(F.countDistinct("cand_id").alias("records"))


# A ledger as it might have been stored: every 97th record is a place off, every 101st is missing.
_STORED = "CASE WHEN cand_id % 97 = 0 THEN position + 1 ELSE position END"


@query(f"""WITH {_RECORDS_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY case_id, field ORDER BY {_ORDER_SQL}) AS position FROM ranks)
SELECT case_id, field, cand_id, CAST(CASE WHEN cand_id % 101 <> 0 THEN {_STORED} END AS INT) AS stored, CAST(position AS INT) AS derived FROM s
WHERE cand_id % 97 = 0 OR cand_id % 101 = 0""")
def ledger_rederivation(spark: SparkSession, d: str) -> DataFrame:
    """What deriving a ledger again finds in one that was damaged after it had been stored."""
    ranks = _ranks(spark, d)
    stored = winners.ranked(ranks, ["case_id", "field"], _order()).filter("cand_id % 101 <> 0").withColumn("position", F.expr(_STORED))
    return winners.rederived(stored, ranks, ["case_id", "field"], _order(), "cand_id", "position")


@query("""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS line, t AS text FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) x
WHERE trim(t) <> ''""")
def line_explode(spark: SparkSession, d: str) -> DataFrame:
    return evidence.text_lines(table(spark, d, "documents"), "doc_id", "text")


_LINES_SQL = """once AS (SELECT DISTINCT ON (doc_key) * FROM trade_case_documents ORDER BY doc_key, received_at DESC),
p AS (SELECT doc_key, case_id, document_id, unnest(pages) AS pg FROM once),
l AS (SELECT doc_key, case_id, document_id, pg.page AS page, unnest(pg.lines) AS ln FROM p),
lines AS (SELECT doc_key, case_id, document_id, page, ln.line AS line, ln.text AS text, ln.confidence AS confidence FROM l)"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    documents = winners.latest_delivery(table(spark, d, "trade_case_documents"), "doc_key", "received_at")
    return evidence.bundle_lines(documents)


@query(f"""WITH {_LINES_SQL}, c AS (SELECT DISTINCT case_id, document, page, line FROM candidates)
SELECT doc_key, count(*) AS line_count, count(DISTINCT lines.page) AS page_count, count(c.line) AS matched,
       round_even(count(c.line) / count(*), 4) AS coverage
FROM lines LEFT JOIN c ON c.case_id = lines.case_id AND c.document = lines.document_id AND c.page = lines.page AND c.line = lines.line
GROUP BY 1""")
def document_manifest(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "candidates").select("case_id", F.col("document").alias("document_id"), "page", "line").distinct().withColumn("seen", F.lit(1))
    rows = _lines(spark, d).join(seen, ["case_id", "document_id", "page", "line"], "left")
    return rows.groupBy("doc_key").agg(
        F.count("*").alias("line_count"), F.countDistinct("page").alias("page_count"), F.count("seen").alias("matched"),
        F.bround(F.count("seen") / F.count("*"), 4).alias("coverage"),
    )


@query(f"WITH {_LINES_SQL} SELECT doc_key, page, line, sha256(text) AS sha256 FROM lines")
def line_sha256(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("doc_key", "page", "line", F.sha2("text", 256).alias("sha256"))


@query(f"""WITH {_LINES_SQL}
SELECT doc_key, count(*) AS lines, count(DISTINCT page) AS pages,
       sha256(string_agg('[' || page || ',' || line || ',' || coalesce(CAST(confidence AS VARCHAR), 'null') || ',' || text || ']', chr(10) ORDER BY page, line)) AS sha256
FROM lines GROUP BY 1""")
def document_hash(spark: SparkSession, d: str) -> DataFrame:
    return evidence.document_hashes(_lines(spark, d), ["doc_key"])


_MATCH_SQL = rf"""{_LINES_SQL},
hits AS (
    SELECT x.doc_key, x.page, x.line, x.text, label, field, length(label) AS size, i AS pos
    FROM (SELECT *, lower(text) AS low FROM lines) x JOIN field_labels f ON contains(x.low, lower(f.label)),
         unnest(range(1, length(x.low) - length(f.label) + 2)) AS r(i)
    WHERE substr(x.low, i, length(f.label)) = lower(f.label)
      AND NOT regexp_matches(CASE WHEN i > 1 THEN substr(x.low, i - 1, 1) ELSE '' END, '[\p{{L}}\p{{N}}_]')
      AND NOT regexp_matches(substr(x.low, i + length(f.label), 1), '[\p{{L}}\p{{N}}_]')),
best AS (
    SELECT DISTINCT ON (doc_key, page, line) * FROM hits WHERE regexp_full_match(substr(text, 1, pos - 1), '[\s\p{{Z}}]*') ORDER BY doc_key, page, line, size DESC, pos, label),
extra AS (
    SELECT h.doc_key, h.page, h.line, bool_or(NOT (h.pos >= b.pos AND h.pos + h.size <= b.pos + b.size)) AS extra
    FROM hits h JOIN best b ON b.doc_key = h.doc_key AND b.page = h.page AND b.line = h.line GROUP BY 1, 2, 3),
matched AS (
    SELECT l.doc_key, l.page, l.line, l.text, CASE WHEN NOT e.extra THEN b.label END AS label, CASE WHEN NOT e.extra THEN b.field END AS field,
           CASE WHEN NOT e.extra THEN b.pos - 1 END AS start,
           CASE WHEN b.label IS NULL THEN 'no configured label' WHEN e.extra THEN 'multiple configured labels' END AS reason
    FROM lines l LEFT JOIN best b ON b.doc_key = l.doc_key AND b.page = l.page AND b.line = l.line
    LEFT JOIN extra e ON e.doc_key = l.doc_key AND e.page = l.page AND e.line = l.line)"""


def _matched(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    return evidence.match_labels(lines, table(spark, d, "field_labels"), ["doc_key", "page", "line"])


@query(f"WITH {_MATCH_SQL} SELECT doc_key, page, line, label, field, CAST(start AS INT) AS start, reason FROM matched")
def alias_match(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d)


_VALUE_SQL = rf"""rest AS (
    SELECT doc_key, page, line, start + length(label) AS after, substr(text, CAST(start + length(label) + 1 AS BIGINT)) AS rest FROM matched WHERE label IS NOT NULL),
v AS (SELECT *, rtrim(regexp_replace(rest, '^[ \t:：=|]+', ''), ' ') AS value, after + length(rest) - length(regexp_replace(rest, '^[ \t:：=|]+', '')) AS b FROM rest)"""
_SPAN_SQL = """SELECT doc_key, page, line, CASE WHEN lower(value) IN ('-', 'n/a', '[blank]', '공란', '') THEN '' ELSE value END AS value,
       CAST(b AS INT) AS value_start, CAST(b + length(value) AS INT) AS value_end FROM v"""


@query(f"WITH {_MATCH_SQL}, {_VALUE_SQL} {_SPAN_SQL}")
def raw_value_span(spark: SparkSession, d: str) -> DataFrame:
    keys = ["doc_key", "page", "line"]
    rows = evidence.match_labels(_lines(spark, d), table(spark, d, "field_labels"), keys, carry=("text",)).filter("label IS NOT NULL")
    value, start, end = evidence.raw_value(F.col("text"), F.col("start") + F.length("label"))
    return rows.select("doc_key", "page", "line", value.alias("value"), start.cast("int").alias("value_start"), end.cast("int").alias("value_end"))


@query(f"""WITH {_LINES_SQL} SELECT doc_key, page, line, 'ev-' || regexp_replace(regexp_replace(lower(document_id), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')
|| '-p' || lpad(CAST(page AS VARCHAR), 2, '0') || '-l' || lpad(CAST(line AS VARCHAR), 3, '0') AS id FROM lines""")
def evidence_ids(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("doc_key", "page", "line", evidence.evidence_id(F.col("document_id"), F.col("page"), F.col("line")).alias("id"))


@query(f"""WITH {_LINES_SQL}, m AS (SELECT lines.*, EXISTS (
    SELECT 1 FROM candidates c WHERE c.case_id = lines.case_id AND c.document = lines.document_id AND c.page = lines.page AND c.line = lines.line) AS hit FROM lines)
SELECT count(DISTINCT doc_key) AS documents, count(*) AS lines, count(*) FILTER (WHERE hit) AS matched, count(*) FILTER (WHERE NOT hit) AS unmatched,
       round_even(count(*) FILTER (WHERE hit) / count(*), 4) AS coverage FROM m""")
def extraction_summary(spark: SparkSession, d: str) -> DataFrame:
    m = document_manifest(spark, d)
    return m.agg(
        F.count("*").alias("documents"), F.sum("line_count").alias("lines"), F.sum("matched").alias("matched"),
        F.sum(F.col("line_count") - F.col("matched")).alias("unmatched"), F.bround(F.sum("matched") / F.sum("line_count"), 4).alias("coverage"),
    )


@query(r"""SELECT DISTINCT ON (cand_id) cand_id,
    CASE WHEN trim(raw_value) = '' THEN 'blank'
         WHEN NOT regexp_matches(raw_value, '[0-9]') THEN 'no_number'
         WHEN regexp_matches(raw_value, '[<>≤≥~±]|약|(?i)\b(about|approx|ca|circa)\b') THEN 'bounded'
         WHEN len(regexp_extract_all(raw_value, '[+-]?[0-9][0-9,]*(?:\.[0-9]+)?')) > 1 THEN 'several_numbers'
         WHEN NOT regexp_full_match(regexp_extract(raw_value, '[+-]?[0-9][0-9,]*(?:\.[0-9]+)?'), '[+-]?(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)(?:\.[0-9]+)?') THEN 'malformed'
    END AS error,
    CASE WHEN regexp_full_match(regexp_extract(raw_value, '[+-]?[0-9][0-9,]*(?:\.[0-9]+)?'), '[+-]?(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)(?:\.[0-9]+)?')
          AND len(regexp_extract_all(raw_value, '[+-]?[0-9][0-9,]*(?:\.[0-9]+)?')) = 1 AND NOT regexp_matches(raw_value, '[<>≤≥~±]|약|(?i)\b(about|approx|ca|circa)\b')
         THEN CAST(try_cast(replace(regexp_extract(raw_value, '[+-]?[0-9][0-9,]*(?:\.[0-9]+)?'), ',', '') AS DECIMAL(38,10)) AS DOUBLE) END AS number
FROM candidates WHERE raw_value IS NOT NULL ORDER BY cand_id""")
def number_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "candidates").filter("raw_value IS NOT NULL").select("cand_id", "raw_value").distinct()
    error, number = numeric.strict_number(F.col("raw_value"))
    return rows.select("cand_id", error.alias("error"), number.cast("double").alias("number"))


@query(r"""SELECT DISTINCT cand_id, CASE WHEN unit IN ('kg', 'kgs', 'KG') THEN 'kg_to_t' WHEN unit IN ('t', 'MT', 'tonnes', '톤', 'metric tons') THEN 'identity_tonnes' ELSE 'unsupported' END AS transformation,
    CAST(CASE WHEN unit IN ('kg', 'kgs', 'KG') THEN try_cast(normalized_value AS DECIMAL(28,10)) * 0.001 WHEN unit IN ('t', 'MT', 'tonnes', '톤', 'metric tons') THEN try_cast(normalized_value AS DECIMAL(28,10)) END AS DOUBLE) AS tonnes
FROM candidates WHERE field LIKE '%\_mass\_t' ESCAPE '\'""")
def unit_convert(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "candidates").filter(F.col("field").endswith("_mass_t"))
    change, tonnes = numeric.to_tonnes(F.col("unit"), F.col("normalized_value"))
    return rows.select("cand_id", change.alias("transformation"), tonnes.cast("double").alias("tonnes")).distinct()


@query(r"""SELECT DISTINCT cand_id, nullif(upper(trim(regexp_replace(raw_value, '[\s\p{Z}]+', ' ', 'g'))), '') AS value FROM candidates
WHERE field = 'verification_reference' OR field LIKE '%\_installation\_id' ESCAPE '\'""")
def blank_to_null(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "candidates").filter((F.col("field") == "verification_reference") | F.col("field").endswith("_installation_id"))
    return rows.select("cand_id", text.squeeze_upper(F.col("raw_value")).alias("value")).distinct()


@query("""WITH r AS (SELECT DISTINCT cand_id, case_id, raw_label FROM candidates)
SELECT cand_id, row_number() OVER (PARTITION BY case_id, raw_label ORDER BY cand_id) AS occurrence FROM r""")
def occurrence_index(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "candidates").select("cand_id", "case_id", "raw_label").distinct()
    return winners.ranked(rows, ["case_id", "raw_label"], [F.col("cand_id").asc()]).select("cand_id", F.col("position").alias("occurrence"))


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 17 END AS n FROM events),
k AS (SELECT *, count(*) FILTER (WHERE n IS NULL) OVER w AS k FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, CAST(k + greatest(0, coalesce(max(n - k) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0)) AS BIGINT) AS state FROM k""")
def auto_line_numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 17).alias("n"))
    return evidence.auto_numbers(rows, ["user_id"], ["event_id"], "n").select("user_id", "event_id", "state")


@query("""SELECT user_id, string_agg(event_type, ' ' ORDER BY event_id, event_type) AS text, round_even(avg(value / 100), 6) AS confidence, count(*) AS words FROM events GROUP BY 1""")
def words_to_lines(spark: SparkSession, d: str) -> DataFrame:
    return evidence.words_to_lines(table(spark, d, "events"), ["user_id"], "event_id", "event_type", "value")


_SCORING_SQL = f"""{_LINES_SQL}, pred AS (
    SELECT DISTINCT ON (case_id, document, page, line) case_id, document, page, line, raw_label AS v FROM candidates ORDER BY case_id, document, page, line, cand_id),
ref AS (SELECT case_id, document_id AS document, page, line, regexp_replace(regexp_extract(text, '^([^:|=：]+)[:|=：]', 1), '^ +| +$', '', 'g') AS v FROM lines WHERE regexp_matches(text, '^[^:|=：]+[:|=：]')),
o AS (SELECT case_id, document, page, line, CASE WHEN p.k IS NULL THEN 'missing' WHEN r.k IS NULL THEN 'spurious' WHEN p.v IS NOT DISTINCT FROM r.v THEN 'match' ELSE 'mismatch' END AS outcome
      FROM (SELECT *, 1 AS k FROM pred) p FULL JOIN (SELECT *, 1 AS k FROM ref) r USING (case_id, document, page, line))"""


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    keys = ["case_id", "document", "page", "line"]
    predicted = table(spark, d, "candidates").groupBy(*keys).agg(F.min_by("raw_label", "cand_id").alias("v"))
    lines = _lines(spark, d).withColumnRenamed("document_id", "document").filter(F.col("text").rlike("^[^:|=：]+[:|=：]"))
    expected = lines.select(*keys, F.trim(F.regexp_extract("text", "^([^:|=：]+)[:|=：]", 1)).alias("v"))
    return evidence.field_scores(predicted, expected, keys, "v")


@query(f"WITH {_SCORING_SQL} SELECT outcome, count(*) AS n FROM o GROUP BY 1")
def field_scoring_full_outer(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"""WITH {_SCORING_SQL}, c AS (SELECT count(*) FILTER (WHERE outcome = 'match') AS tp, count(*) FILTER (WHERE outcome IN ('mismatch', 'spurious')) AS fp,
    count(*) FILTER (WHERE outcome IN ('mismatch', 'missing')) AS fn FROM o)
SELECT tp, fp, fn, round_even(tp / nullif(tp + fp, 0), 6) AS precision, round_even(tp / nullif(tp + fn, 0), 6) AS recall, round_even(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""")
def field_scoring_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evidence.score_summary(_outcomes(spark, d))


_PLAIN = lambda c: f"trim(regexp_replace(nfc_normalize({c}), '{SPACE}', ' ', 'g'))"


@query(f"""WITH {_SCORING_SQL.split("o AS (SELECT")[0].rstrip().rstrip(",")},
pc AS (SELECT DISTINCT ON (case_id, document, page, line) case_id, document, page, line, {_PLAIN("raw_label")} AS v, CASE WHEN isnan(confidence) THEN NULL ELSE confidence END AS confidence, 1 AS k FROM candidates ORDER BY case_id, document, page, line, cand_id),
ob AS (SELECT confidence, CASE WHEN p.k IS NULL THEN 'missing' WHEN r.k IS NULL THEN 'spurious' WHEN p.v IS NOT DISTINCT FROM {_PLAIN("r.v")} THEN 'match' ELSE 'mismatch' END AS outcome
      FROM pc p FULL JOIN (SELECT *, 1 AS k FROM ref) r USING (case_id, document, page, line))
SELECT outcome, count(*) AS n, round_even(avg(confidence), 6) AS mean_confidence FROM ob GROUP BY 1""")
def field_error_buckets(spark: SparkSession, d: str) -> DataFrame:
    keys = ["case_id", "document", "page", "line"]
    sure = F.when(~F.isnan("confidence"), F.col("confidence"))
    first = table(spark, d, "candidates").groupBy(*keys).agg(F.min_by(F.struct("raw_label", sure.alias("confidence")), "cand_id").alias("r"))
    predicted = first.select(*keys, F.col("r.raw_label").alias("v"), "r.confidence")
    lines = _lines(spark, d).withColumnRenamed("document_id", "document").filter(F.col("text").rlike("^[^:|=：]+[:|=：]"))
    expected = lines.select(*keys, F.trim(F.regexp_extract("text", "^([^:|=：]+)[:|=：]", 1)).alias("v"))
    return evidence.error_buckets(predicted, expected, keys, "v", "confidence")


def _extraction(spark: SparkSession, d: str) -> pipelines.Extraction:
    documents = winners.latest_delivery(table(spark, d, "trade_case_documents"), "doc_key", "received_at")
    return pipelines.extract(documents, table(spark, d, "field_labels"))


@query(f"""WITH {_MATCH_SQL}, {_VALUE_SQL}, spans AS ({_SPAN_SQL})
SELECT m.doc_key, m.page, m.line, m.field, m.label, nullif(s.value, '') AS value, CAST(m.start AS INT) AS alias_start, s.value_start, s.value_end, sha256(m.text) AS line_sha256
FROM matched m JOIN spans s ON s.doc_key = m.doc_key AND s.page = m.page AND s.line = m.line""")
def extract_records(spark: SparkSession, d: str) -> DataFrame:
    return _extraction(spark, d).records.select(
        "doc_key", "page", "line", "field", "label", "value", "source_span.alias_start", "source_span.value_start", "source_span.value_end", "line_sha256"
    )


@query(f"WITH {_MATCH_SQL} SELECT reason, count(*) AS lines FROM matched WHERE label IS NULL GROUP BY 1")
def unmatched_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _extraction(spark, d).unmatched.groupBy("reason").agg(F.count("*").alias("lines"))


@query()
def strict_field_values(spark: SparkSession, d: str) -> DataFrame:
    """Every field candidate under the strict rules; the lookarounds of the rules have no counterpart in DuckDB."""
    rows = table(spark, d, "candidates").filter("field IS NOT NULL").select("cand_id", "field", "raw_value").distinct()
    return strict_values.strict_values(rows, "cand_id", "raw_value")
