"""Composed operators: bundles to records, and queries to decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators import evidence, retrieval
from ledgerloom.session import small


@dataclass(frozen=True)
class Extraction:
    """Records with spans and hashes, lines that match no label with the reason, and one manifest row per document."""

    records: DataFrame
    unmatched: DataFrame
    manifest: DataFrame


def extract(documents: DataFrame, labels: DataFrame) -> Extraction:
    """Field records of nested document bundles (doc_key, case_id, document_id, document_type, pages)."""
    keys = ["doc_key", "page", "line"]
    lines = evidence.bundle_lines(documents)
    matched = evidence.match_labels(lines, labels, keys, carry=tuple(lines.columns))
    value, begin, end = evidence.raw_value(F.col("text"), F.col("start") + F.length("label"))
    hashes = evidence.document_hashes(lines, ["doc_key"])
    hits = matched.filter("label IS NOT NULL")
    span = F.struct(F.col("start").alias("alias_start"), (F.col("start") + F.length("label")).alias("alias_end"), begin.cast("int").alias("value_start"), end.cast("int").alias("value_end"))
    records = hits.join(hashes.select("doc_key", F.col("sha256").alias("document_sha256")), "doc_key").select(
        evidence.evidence_id(F.col("document_id"), F.col("page"), F.col("line")).alias("record_id"), "doc_key", "case_id", "document_id", "document_type", "page", "line", "field", "label",
        F.nullif(value, F.lit("")).alias("value"), "confidence", F.col("text").alias("raw_line"), span.alias("source_span"), F.sha2("text", 256).alias("line_sha256"), "document_sha256",
    )
    unmatched = matched.filter("label IS NULL").select(*keys, "text", "confidence", "reason", F.sha2("text", 256).alias("line_sha256"))
    counts = hits.groupBy("doc_key").agg(F.count("*").alias("matched"))
    return Extraction(records, unmatched, hashes.join(counts, "doc_key", "left").fillna(0, ["matched"]))


def retrieve(queries: DataFrame, corpus: DataFrame, key: str, text: str, k: int = 3, min_score: float = retrieval.MIN_SCORE, min_margin: float = retrieval.MIN_MARGIN) -> DataFrame:
    """key, reason (of the gate), instrument, status, decision_reason, top_score, margin, id, score, rank: up to k
    entries of every query, or one row of abstention.

    Queries that fail the gate, or refer to an article that their instrument does not have (article_not_in_corpus),
    never reach the index, but keep a row. Only entries of the query's instrument are scored: BM25F over both channels,
    CONCEPT_BONUS for each concept named, ARTICLE_BONUS where the entry's article is. Entries from min_score on are
    results; several of them within min_margin are up for review, unless an article was named; none is low_score.
    """
    gated = retrieval.gate(queries, corpus, key, text)
    entries = corpus.select(F.col("id").alias("entry"), F.col("instrument").alias("of"), retrieval.article_number(F.col("article")).alias("article"))
    known = entries.groupBy("of").agg(F.array_sort(F.collect_set("article")).alias("known"))
    asked = gated.join(small(known), F.col("instrument") == F.col("of"), "left").drop("of")
    passed = F.col("reason") == "domain_supported"
    absent = F.size(F.array_except("articles", F.coalesce("known", F.array().cast("array<string>")))) > 0
    asked = asked.withColumn("stopped", F.when(~passed, F.col("reason")).when(absent, "article_not_in_corpus"))
    open_ = asked.filter("stopped IS NULL").select(key, "instrument", "articles")
    passing = queries.join(open_.select(key), key, "left_semi")
    words = retrieval.bm25f(passing, retrieval.entry_fields(corpus), key, text)
    concepts = retrieval.concept_hits(passing, corpus, key, text).select(key, "id", "concepts")
    same = (F.col("instrument") == F.col("of")) & (F.col("named") == F.col("article"))
    named = open_.select(key, "instrument", F.explode("articles").alias("named")).join(small(entries), same).select(key, F.col("entry").alias("id"), F.lit(retrieval.ARTICLE_BONUS).alias("bonus"))
    total = F.coalesce("score", F.lit(0.0)) + retrieval.CONCEPT_BONUS * F.coalesce("concepts", F.lit(0)) + F.coalesce("bonus", F.lit(0.0))
    scored = words.join(concepts, [key, "id"], "full").join(named, [key, "id"], "full").select(key, "id", F.round(total, 6).alias("score"))
    own = scored.join(small(entries), F.col("id") == F.col("entry")).join(open_.select(key, "instrument"), key).filter("of = instrument").select(key, "id", "score")
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), "id")
    whole = Window.partitionBy(key)
    ranked = own.withColumns(
        {
            "rank": F.row_number().over(w), "top_score": F.max("score").over(whole), "eligible": F.count_if(F.col("score") >= min_score).over(whole),
            "second": F.coalesce(F.max("score").over(w.rowsBetween(1, 1)), F.lit(0.0)),
        }
    )
    ranked = ranked.withColumn("margin", F.round(F.max(F.when(F.col("rank") == 1, F.col("score") - F.col("second"))).over(whole), 6))
    best = ranked.filter((F.col("rank") == 1) | (F.col("rank") <= k) & (F.col("score") >= min_score))
    out = asked.join(best, key, "left")
    top, margin, eligible = (F.coalesce(c, F.lit(0)) for c in ("top_score", "margin", "eligible"))
    low, hit = F.col("stopped").isNull() & (eligible == 0), F.col("stopped").isNull() & (eligible > 0)
    review = hit & (eligible > 1) & (margin < min_margin) & (F.size("articles") == 0)
    status = F.when(F.col("stopped").isNotNull() | low, "abstained").when(review, "review").otherwise("supported")
    why = F.coalesce("stopped", F.when(low, "low_score").when(review, "low_ranking_margin").otherwise("citation_supported"))
    shown = lambda c: F.when(hit, F.col(c)).alias(c)
    reached = lambda c, x: F.when(F.col("stopped").isNull(), x.cast("double")).alias(c)
    return out.select(
        key, "reason", "instrument", status.alias("status"), why.alias("decision_reason"), reached("top_score", top), reached("margin", margin), shown("id"), shown("score"), shown("rank")
    )


def issue_citations(issues: DataFrame, templates: DataFrame, corpus: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """keys, code, field, status, ids of every issue: the entries that the query written for its code and field finds.

    templates (code, field, query) is a curated list; each of its queries is asked once, however many issues need it.
    Issues without a template have the status unmapped.
    """
    asked = templates.select("query").distinct()
    found = retrieve(asked.withColumn("asked", F.col("query")), corpus, "query", "asked", k)
    answers = found.groupBy("query").agg(F.any_value("status").alias("status"), F.transform(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("rank", "id")))), lambda x: x["id"]).alias("ids"))
    named = templates.join(answers, "query").select(F.col("code").alias("#c"), F.col("field").alias("#f"), "status", "ids")
    joined = issues.join(small(named), (F.col("code") == F.col("#c")) & F.col("field").eqNullSafe(F.col("#f")), "left")
    return joined.select(*keys, "code", "field", F.coalesce("status", F.lit("unmapped")).alias("status"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))


# The questions that issues of a code and field raise.
ISSUE_QUERIES = (
    ("cross_document_conflict", "shipment_mass_t", "CBAM 신고 수량이 문서마다 다르면 신고 내용과 수량 근거는 어떤 조항을 확인해야 하나"),
    ("cross_document_conflict", "actual_intensity_tco2e_per_t", "실제 내재배출량과 기본값 계산 근거가 충돌하면 어떤 조항을 확인해야 하나"),
    ("missing_required_evidence", "verification_reference", "실제 배출량을 사용하려는데 검증서가 없으면 어떤 조항을 확인해야 하나"),
)
