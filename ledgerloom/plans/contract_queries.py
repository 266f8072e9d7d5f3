"""Contracts, issues and consistency of the evidence tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators import contracts, normalisation, pipelines, winners
from ledgerloom.plans import evidence_queries as evidence
from ledgerloom.plans import retrieval_queries as retrieval
from ledgerloom.plans.registry import Registry
from ledgerloom.session import BROADCAST_ROWS, small, table

registry = Registry()
query = registry.query

_ORDER = evidence._ORDER_SQL


@query("""WITH r AS (SELECT DISTINCT ON (cand_id) *, source_span AS s, (raw_line IS NOT NULL)::INT + (line_sha256 IS NOT NULL)::INT + (document_sha256 IS NOT NULL)::INT + (source_span IS NOT NULL)::INT AS given
    FROM candidates ORDER BY cand_id, ingested_at DESC),
e AS (SELECT CASE WHEN given = 0 THEN 'no_lineage' WHEN given < 4 THEN 'partial_lineage'
    WHEN NOT coalesce(s.alias_start >= 0 AND s.alias_start < s.alias_end AND s.alias_end <= s.value_start AND s.value_start <= s.value_end AND s.value_end <= length(raw_line), false) THEN 'span_out_of_order'
    WHEN lower(substr(raw_line, s.alias_start + 1, s.alias_end - s.alias_start)) IS DISTINCT FROM lower(raw_label) THEN 'label_differs'
    WHEN coalesce(raw_value, '') <> '' AND substr(raw_line, s.value_start + 1, s.value_end - s.value_start) <> raw_value THEN 'value_differs'
    WHEN coalesce(raw_value, '') = '' AND lower(trim(substr(raw_line, s.value_start + 1, s.value_end - s.value_start))) NOT IN ('-', 'n/a', '[blank]', '공란', '') THEN 'value_not_blank'
    WHEN sha256(raw_line) <> line_sha256 THEN 'line_hash_differs' WHEN NOT regexp_full_match(document_sha256, '[0-9a-f]{64}') THEN 'document_hash_malformed' END AS error FROM r)
SELECT coalesce(error, 'none') AS error, count(*) AS records FROM e GROUP BY 1""")
def provenance_errors(spark: SparkSession, d: str) -> DataFrame:
    once = winners.latest_delivery(table(spark, d, "candidates"), "cand_id", "ingested_at")
    return once.groupBy(F.coalesce(contracts.provenance_error(), F.lit("none")).alias("error")).agg(F.count("*").alias("records"))


@query(f"""WITH {evidence._LINES_SQL}, n AS (SELECT case_id, document_id, page, line, min(text) AS text, count(*) AS copies FROM lines GROUP BY 1, 2, 3, 4),
r AS (SELECT DISTINCT cand_id, case_id, document, page, line, raw_line FROM candidates)
SELECT CASE WHEN copies IS NULL THEN 'no_line' WHEN copies > 1 THEN 'several_lines' WHEN raw_line IS NULL THEN 'no_text' WHEN raw_line = text THEN 'same' ELSE 'differs' END AS state, count(*) AS records
FROM r LEFT JOIN n ON n.case_id = r.case_id AND n.document_id = r.document AND n.page = r.page AND n.line = r.line GROUP BY 1""")
def source_line_check(spark: SparkSession, d: str) -> DataFrame:
    keys = ["case_id", "document_id", "page", "line"]
    records = table(spark, d, "candidates").select("cand_id", "case_id", F.col("document").alias("document_id"), "page", "line", "raw_line").distinct()
    return contracts.against_lines(records, evidence._lines(spark, d), keys)


@query("""WITH known AS (SELECT DISTINCT id FROM legal_corpus)
SELECT item_id, 'unknown_id' AS error FROM (SELECT item_id, unnest(list_concat(expected_ids, forbidden_ids)) AS id FROM eval_items) x WHERE id NOT IN (SELECT id FROM known)
UNION SELECT item_id, 'repeated_id' FROM eval_items WHERE len(list_distinct(expected_ids)) < len(expected_ids)
UNION SELECT item_id, 'overlapping_ids' FROM eval_items WHERE len(list_intersect(expected_ids, forbidden_ids)) > 0
UNION SELECT item_id, 'positive_without_ids' FROM eval_items WHERE case_type = 'positive' AND len(expected_ids) = 0
UNION SELECT item_id, 'negative_with_ids' FROM eval_items WHERE case_type <> 'positive' AND len(expected_ids) > 0
UNION SELECT item_id, 'blank_query' FROM eval_items WHERE coalesce(trim(query) = '', true)""")
def case_validity(spark: SparkSession, d: str) -> DataFrame:
    return contracts.case_errors(table(spark, d, "eval_items"), table(spark, d, "legal_corpus"), "item_id")


@query(f"""SELECT id, alias FROM (SELECT id, {retrieval._FORM.format('alias')} AS alias, count(DISTINCT concept) AS n FROM (
    SELECT id, concept, unnest(aliases) AS alias FROM (SELECT id, unnest(map_keys(concepts)) AS concept, unnest(map_values(concepts)) AS aliases FROM legal_corpus) x) y GROUP BY 1, 2) z WHERE alias = '' OR n > 1""")
def corpus_aliases(spark: SparkSession, d: str) -> DataFrame:
    return contracts.alias_errors(table(spark, d, "legal_corpus"))


@query("""SELECT case_id, count(*) AS records, count(DISTINCT sequence) = count(*) AS unique_sequence, max(sequence) - min(sequence) + 1 = count(*) AS gapless
FROM (SELECT DISTINCT cand_id, case_id, sequence FROM candidates) x GROUP BY 1""")
def sequence_check(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "candidates").select("cand_id", "case_id", "sequence").distinct()
    n = F.count("*")
    return rows.groupBy("case_id").agg(n.alias("records"), (F.countDistinct("sequence") == n).alias("unique_sequence"), (F.max("sequence") - F.min("sequence") + 1 == n).alias("gapless"))


@query(f"""WITH {evidence._LINES_SQL}, u AS (
    SELECT case_id, document_id AS document, page, line, 'line' AS origin FROM lines UNION ALL SELECT DISTINCT case_id, document, page, line, 'record' FROM candidates)
SELECT case_id, document, page, line, count(*) FILTER (WHERE origin = 'line') AS lines, count(*) FILTER (WHERE origin = 'record') AS records FROM u GROUP BY 1, 2, 3, 4""")
def line_inventory(spark: SparkSession, d: str) -> DataFrame:
    keys = ["case_id", "document", "page", "line"]
    lines = evidence._lines(spark, d).withColumnRenamed("document_id", "document").select(*keys, F.lit("line").alias("origin"))
    records = table(spark, d, "candidates").select(*keys).distinct().withColumn("origin", F.lit("record"))
    count = lambda o: F.count_if(F.col("origin") == o)
    return lines.unionByName(records).groupBy(*keys).agg(count("line").alias("lines"), count("record").alias("records"))


_ISSUES_SQL = f"""{evidence._RECORDS_SQL},
raw AS (SELECT DISTINCT ON (cand_id) * FROM candidates ORDER BY cand_id, ingested_at DESC),
w AS (SELECT *, CASE WHEN valid THEN normalized_value END AS v, first_value(CASE WHEN valid THEN normalized_value END) OVER o AS winner, row_number() OVER o AS n
    FROM ranks WINDOW o AS (PARTITION BY case_id, field ORDER BY {_ORDER})),
g AS (SELECT case_id, field, bool_or(valid) AS any_valid,
        count(*) FILTER (WHERE n > 1 AND v <> winner AND NOT coalesce(abs(try_cast(v AS DECIMAL(28,10)) - try_cast(winner AS DECIMAL(28,10))) <= 0.1, false)) AS material,
        count(*) FILTER (WHERE n > 1 AND v <> winner AND coalesce(abs(try_cast(v AS DECIMAL(28,10)) - try_cast(winner AS DECIMAL(28,10))) <= 0.1, false)) AS equivalent FROM w GROUP BY 1, 2),
need AS (SELECT c.case_id, f.field FROM (SELECT DISTINCT case_id FROM candidates) c CROSS JOIN (SELECT DISTINCT field FROM field_labels) f),
issues AS (
    SELECT case_id, 'unknown_label' AS code FROM raw WHERE field IS NULL
    UNION ALL SELECT case_id, 'parse_failure' FROM raw WHERE field IS NOT NULL AND transformation = 'parse_failed'
    UNION ALL SELECT case_id, 'invalid_confidence' FROM raw WHERE NOT coalesce(confidence BETWEEN 0 AND 1 AND NOT isnan(confidence), false)
    UNION ALL SELECT case_id, 'cross_document_conflict' FROM g WHERE material > 0
    UNION ALL SELECT case_id, 'within_tolerance_variance' FROM g WHERE material = 0 AND equivalent > 0
    UNION ALL SELECT case_id, 'missing_required_evidence' FROM g WHERE NOT any_valid
    UNION ALL SELECT need.case_id, 'missing_required_field' FROM need WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.case_id = need.case_id AND g.field = need.field))"""


@query(f"WITH {_ISSUES_SQL} SELECT case_id, code, count(*) AS n FROM issues GROUP BY 1, 2")
def issue_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Issues and observations of normalisation, counted per case and code."""
    raw = winners.latest_delivery(table(spark, d, "candidates").select("cand_id", "case_id", "field", "transformation", "confidence", "ingested_at"), "cand_id", "ingested_at")
    sound = F.coalesce(F.col("confidence").between(0, 1) & ~F.isnan("confidence"), F.lit(False))
    codes = F.array_compact(
        F.array(
            F.when(F.col("field").isNull(), "unknown_label"),
            F.when(F.col("field").isNotNull() & (F.col("transformation") == "parse_failed"), "parse_failure"),
            F.when(~sound, "invalid_confidence"),
        )
    )
    per_record = raw.select("case_id", F.explode(codes).alias("code"))
    ranks = evidence._ranks(spark, d).withColumn("v", F.when(F.col("valid"), F.col("normalized_value")))
    split = winners.conflicts(ranks, ["case_id", "field"], evidence._best(), "cand_id", "v", F.lit(0.1).cast("decimal(4,2)"))
    fine = ranks.groupBy("case_id", "field").agg(F.bool_or("valid").alias("any_valid"))
    groups = split.join(fine, ["case_id", "field"])
    group_codes = F.array_compact(
        F.array(
            F.when(F.col("material") > 0, "cross_document_conflict"),
            F.when((F.col("material") == 0) & (F.col("equivalent") > 0), "within_tolerance_variance"),
            F.when(~F.col("any_valid"), "missing_required_evidence"),
        )
    )
    per_group = groups.select("case_id", F.explode(group_codes).alias("code"))
    needed = winners.required_ledger(table(spark, d, "candidates"), table(spark, d, "field_labels"), groups, "case_id", "field")
    missing = needed.filter(~F.col("passed")).select("case_id", F.lit("missing_required_field").alias("code"))
    return per_record.unionByName(per_group).unionByName(missing).groupBy("case_id", "code").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT DISTINCT cand_id, raw_label, field FROM candidates), f AS (SELECT label, min(field) AS expected FROM field_labels GROUP BY 1)
SELECT CASE WHEN expected IS NULL THEN CASE WHEN field IS NULL THEN 'free' ELSE 'field_without_label' END WHEN field IS NULL THEN 'unassigned' WHEN field = expected THEN 'assigned' ELSE 'differs' END AS state, count(*) AS records
FROM c LEFT JOIN f ON f.label = c.raw_label GROUP BY 1""")
def label_assignment(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "field_labels").groupBy(F.col("label").alias("raw_label")).agg(F.min("field").alias("expected"))
    rows = table(spark, d, "candidates").select("cand_id", "raw_label", "field").distinct().join(small(labels), "raw_label", "left")
    free = F.when(F.col("field").isNull(), "free").otherwise("field_without_label")
    state = F.when(F.col("expected").isNull(), free).when(F.col("field").isNull(), "unassigned").when(F.col("field") == F.col("expected"), "assigned").otherwise("differs")
    return rows.groupBy(state.alias("state")).agg(F.count("*").alias("records"))


# Tolerances of a policy on the test tables, and fields that a case must have.
TOLERANCES = {"shipment_mass_t": "0.1", "actual_intensity_tco2e_per_t": "0.001"}
REQUIRED = ("shipment_mass_t", "cn_code", "actual_intensity_tco2e_per_t", "verification_reference")


def _policy(spark: SparkSession, d: str) -> normalisation.Policy:
    """The policy that the table of authorities states (a curated list), with the tolerances above."""
    general, by_field = {}, {f: {} for f in TOLERANCES}
    rows = table(spark, d, "source_authority").filter("document_type IS NOT NULL").limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        raise ValueError(f"a policy of more than {BROADCAST_ROWS} authorities")
    for r in rows:
        (general if r.field is None else by_field.setdefault(r.field, {}))[r.document_type] = r.authority_rank
    return normalisation.Policy("test tables", 10, general, by_field, TOLERANCES)


def _records(spark: SparkSession, d: str) -> DataFrame:
    once = winners.latest_delivery(table(spark, d, "candidates"), "cand_id", "ingested_at")
    return once.withColumnRenamed("record_id", "stated_id").withColumn("record_id", F.col("cand_id"))


def _normalised(spark: SparkSession, d: str) -> normalisation.Normalised:
    return normalisation.normalise(_records(spark, d), table(spark, d, "field_labels"), _policy(spark, d), list(REQUIRED))


@query()
def normalize_records(spark: SparkSession, d: str) -> DataFrame:
    """The selected value of every case and field, parsed from the raw text by strict rules that SQL cannot state."""
    return _normalised(spark, d).fields


@query()
def normalize_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts of fields, issues and observations of every case, and its status."""
    return _normalised(spark, d).summary


@query()
def normalize_rederivation(spark: SparkSession, d: str) -> DataFrame:
    """What deriving again finds in stored candidates of which every 97th value was changed and every 101st record lost."""
    records, labels, policy = _records(spark, d), table(spark, d, "field_labels"), _policy(spark, d)
    stored = normalisation.normalise(records, labels, policy, []).candidates.filter("record_id % 101 <> 0")
    damaged = stored.withColumn("value", F.when(F.col("record_id") % 97 == 0, F.concat(F.coalesce("value", F.lit("")), F.lit("0"))).otherwise(F.col("value")))
    return normalisation.rederive(damaged, records, labels, policy)


@query()
def issue_citations(spark: SparkSession, d: str) -> DataFrame:
    """The entries that the questions written for issues of normalisation find, counted per code, field and status."""
    issues = _normalised(spark, d).issues.select("case_id", "code", "field")
    templates = spark.createDataFrame(list(pipelines.ISSUE_QUERIES), "code string, field string, query string")
    found = pipelines.issue_citations(issues, templates, table(spark, d, "legal_corpus"), ["case_id"])
    return found.groupBy("code", "field", "status").agg(F.count("*").alias("issues"), F.any_value(F.array_join("ids", ",")).alias("ids"))


# Documents as they might have been stored: the last line of every 20th is lost, a text of others is changed.
_CUT, _CHANGED = "doc_key % 20 = 3", "doc_key % 20 = 7 AND page = 1 AND line = 1"


@query(f"""WITH {evidence._LINES_SQL}, st AS (SELECT doc_key, count(*) AS n, sha256(string_agg('[' || page || ',' || line || ',' || coalesce(CAST(confidence AS VARCHAR), 'null') || ',' || text || ']', chr(10) ORDER BY page, line)) AS h FROM lines GROUP BY 1),
dm AS (SELECT * REPLACE (CASE WHEN {_CHANGED} THEN text || '.' ELSE text END AS text), row_number() OVER (PARTITION BY doc_key ORDER BY page DESC, line DESC) AS k FROM lines),
nw AS (SELECT doc_key, count(*) AS n, sha256(string_agg('[' || page || ',' || line || ',' || coalesce(CAST(confidence AS VARCHAR), 'null') || ',' || text || ']', chr(10) ORDER BY page, line)) AS h,
        count(*) FILTER (WHERE NOT coalesce(page >= 1 AND line >= 1 AND text IS NOT NULL AND confidence BETWEEN 0 AND 1 AND NOT isnan(confidence), false)) AS bad, count(*) - count(DISTINCT (page, line)) AS twice
        FROM dm WHERE NOT ({_CUT} AND k = 1) GROUP BY 1)
SELECT st.doc_key, CASE WHEN nw.n IS NULL OR nw.n <> st.n THEN 'line_count_differs' WHEN bad > 0 THEN 'malformed_line' WHEN twice > 0 THEN 'line_repeated' WHEN nw.h <> st.h THEN 'content_differs' END AS error
FROM st LEFT JOIN nw ON nw.doc_key = st.doc_key WHERE error IS NOT NULL""")
def document_integrity(spark: SparkSession, d: str) -> DataFrame:
    """What reproducing documents from their lines finds where lines were lost or changed after the manifest was stored."""
    lines = evidence._lines(spark, d)
    stored = evidence.evidence.document_hashes(lines, ["doc_key"]).select("doc_key", "lines", "sha256")
    last = F.struct("page", "line") == F.max(F.struct("page", "line")).over(Window.partitionBy("doc_key"))  # the lines of one document
    damaged = lines.withColumn("#last", last).filter(f"NOT ({_CUT} AND `#last`)").withColumn("text", F.when(F.expr(_CHANGED), F.concat("text", F.lit("."))).otherwise(F.col("text")))
    return contracts.document_errors(damaged, stored, ["doc_key"])


@query(f"""SELECT DISTINCT h.item_id, p.item_id AS development_key FROM (SELECT *, {retrieval._FORM.format("query")} AS form FROM eval_items WHERE case_type <> 'positive') h
JOIN (SELECT *, {retrieval._FORM.format("query")} AS form FROM eval_items WHERE case_type = 'positive') p ON p.form = h.form AND p.form <> ''""")
def reused_queries(spark: SparkSession, d: str) -> DataFrame:
    """Negative and distracting cases that ask what a positive one asks."""
    items = table(spark, d, "eval_items")
    return contracts.reused_queries(items.filter("case_type <> 'positive'"), items.filter("case_type = 'positive'"), "item_id", "query")
