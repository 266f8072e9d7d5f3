"""Query gate, article routing, evaluation and phrases within texts."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import pipelines, retrieval
from ledgerloom.operators.phrases import with_phrases

CORPUS = (
    "id string, instrument string, celex string, source_checked_on string, source_status string, regulation string, article string, paragraph string, "
    "title string, summary_ko string, keywords array<string>, concepts map<string,array<string>>, url string"
)


@pytest.fixture(scope="module")
def corpus(spark):
    def entry(id_, instrument, article, title, concepts):
        return (id_, instrument, "C1", "2026-01-01", "draft", "Act 1", article, "1", title, title, [title], concepts, "https://example.org")

    rows = [
        entry("CBAM-A6", "CBAM", "Article 6", "declaration of goods", {"goods": ["goods quantity", "수량"], "declaration": ["declaration"]}),
        entry("CBAM-A7", "CBAM", "Article 7a", "embedded emissions", {"emissions": ["embedded emissions"], "default": ["default value", "기본값"]}),
        entry("EUDR-A9", "EUDR", "Article 9", "geolocation of plots", {"plot": ["plot", "필지"], "goods": ["goods quantity"]}),
        entry("EUDR-B1", "EUDR", "Annex", "annex", {"plot": ["annex"]}),
    ]
    return spark.createDataFrame(rows, CORPUS)


GATE = {
    "CBAM": ("underspecified", "CBAM"), "CBAM weather today": ("underspecified", "CBAM"), "cbam goods quantity": ("underspecified", "CBAM"), "CBAM goods quantity required": ("domain_supported", "CBAM"),
    "cbam 수량 declaration": ("domain_supported", "CBAM"), "CBAM art. 7a": ("domain_supported", "CBAM"), "ＣＢＡＭ 제 6 조": ("domain_supported", "CBAM"), "CBAM and EUDR must": ("ambiguous_instrument", None),
    "article 6": ("ambiguous_instrument", None), "lunch and football": ("out_of_domain", None), "goods quantity and plot": ("out_of_domain", None), "plot of goods quantity must": ("domain_supported", "EUDR"),
    "must goods quantity": ("out_of_domain", None), "must goods quantity declaration 필지": ("ambiguous_instrument", None), "xcbam must declaration": ("out_of_domain", None), "": ("out_of_domain", None),
}


def test_gate(spark, corpus):
    df = spark.createDataFrame(list(enumerate(GATE)), "k int, q string").unionByName(spark.createDataFrame([(-1, None)], "k int, q string"))
    got = {r.k: (r.reason, r.instrument) for r in retrieval.gate(df, corpus, "k", "q").collect()}
    assert got == {i: v for i, v in enumerate(GATE.values())} | {-1: ("out_of_domain", None)}


def test_articles_route_and_missing_ones_abstain(spark, corpus):
    asked = ["CBAM article 6 declaration must", "CBAM article 99 declaration", "CBAM embedded emissions default value", "EUDR 제9조 plot", "CBAM art 1 art 6", "nothing"]
    df = spark.createDataFrame(list(enumerate(asked)), "k int, q string")
    rows = pipelines.retrieve(df, corpus, "k", "q").collect()
    first = {r.k: r for r in rows if r["rank"] in (1, None)}
    assert (first[0].id, first[0].status) == ("CBAM-A6", "supported") and first[0].score > 16
    assert (first[1].status, first[1].decision_reason, first[1].id) == ("abstained", "article_not_in_corpus", None)
    assert first[2].id == "CBAM-A7" and first[3].id == "EUDR-A9" and first[4].decision_reason == "article_not_in_corpus"
    assert (first[5].status, first[5].decision_reason, first[5].top_score) == ("abstained", "out_of_domain", None)
    assert all(r.id is None or r.id.startswith(r.instrument) for r in rows)
    strict = {r.k: r for r in pipelines.retrieve(df, corpus, "k", "q", min_score=10_000.0).collect()}
    assert (strict[0].status, strict[0].decision_reason, strict[0].id) == ("abstained", "low_score", None) and strict[0].top_score == first[0].top_score
    near = {(r.k, r["rank"]): r.status for r in pipelines.retrieve(df, corpus, "k", "q", min_score=0.0, min_margin=10_000.0).collect()}
    assert near[2, 1] == "review" and near[0, 1] == "supported"  # an article that is named needs no margin


def test_evaluation_and_acceptance(spark, corpus):
    cases = [
        (1, "positive", "CBAM article 6 declaration must", "supported", "CBAM", ["CBAM-A6"], []), (2, "positive", "CBAM", "supported", "CBAM", ["CBAM-A7"], []), (3, "negative", "lunch", "abstained", None, [], []),
        (4, "negative", "CBAM default value embedded emissions", "abstained", None, [], []), (5, "distractor", "CBAM default value of embedded emissions", "supported", "EUDR", ["EUDR-A9"], ["CBAM-A7"]),
    ]
    df = spark.createDataFrame(cases, "k int, case_type string, query string, expected_status string, expected_instrument string, expected_ids array<string>, forbidden_ids array<string>")
    judged = retrieval.judged_cases(pipelines.retrieve(df, corpus, "k", "query"), df, corpus, "k")
    row = retrieval.evaluation(judged).first()
    assert (row.cases, row.positive, row.negative, row.distractor) == (5, 2, 2, 1)
    assert (row.hit_rate, row.recall, row.mrr) == (0.3333, 0.3333, 0.3333)
    assert (row.positive_coverage, row.negative_abstention, row.false_support, row.distractor_rejection) == (0.5, 0.5, 0.5, 0.0)
    assert (row.instrument_leakage, row.trace_coverage, row.status_match) == (0.3333, 1.0, 0.6)
    passed = {r.rate: r.passed for r in retrieval.acceptance(retrieval.evaluation(judged)).collect()}
    assert not any(passed.values()) and len(passed) == 6
    empty = retrieval.evaluation(retrieval.judged_cases(pipelines.retrieve(df.limit(0), corpus, "k", "query"), df.limit(0), corpus, "k")).first()
    assert empty.cases == 0 and empty.recall == 0.0 and empty.trace_coverage == 0.0


def test_contributions_add_up_to_scores(spark, corpus):
    df = spark.createDataFrame([(1, "declaration of goods, embedded emissions of goods"), (2, "plots annex")], "k int, q string")
    fields = retrieval.entry_fields(corpus)
    terms = retrieval.term_scores(df, fields, "k", "q")
    whole = {(r.k, r.id): r.score for r in retrieval.bm25f(df, fields, "k", "q").collect()}
    for part in (retrieval.field_contributions(terms, "k").withColumnRenamed("contribution", "x"), retrieval.term_trace(terms, "k").withColumnRenamed("score", "x")):
        sums = {(r.k, r.id): r.x for r in part.groupBy("k", "id").agg(F.sum("x").alias("x")).collect()}
        assert sums.keys() == whole.keys() and all(abs(sums[k] - whole[k]) < 1e-4 for k in whole)


@pytest.mark.parametrize("in_row", [1000, 3])
def test_phrases_in_rows_and_by_anchors(spark, in_row):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("ab가 ") for _ in range(n))
    texts = [(i, text(rng.randint(0, 12))) for i in range(60)] + [(100, None), (None, "abab")]
    phrases = sorted({text(rng.randint(0, 4)) for _ in range(30)})
    df, listed = spark.createDataFrame(texts, "k int, t string"), spark.createDataFrame([(i, p) for i, p in enumerate(phrases)], "n int, p string")
    got = {r.k: [x.p for x in r.found] for r in with_phrases(df, ["k"], F.col("t"), listed, "p", "found", in_row).collect()}
    assert got == {k: [p for p in phrases if p and t and p in t] for k, t in texts}


def test_issues_find_their_entries(spark, corpus):
    issues = spark.createDataFrame([("c1", "conflict", "mass"), ("c2", "conflict", "mass"), ("c1", "conflict", "other"), ("c3", "blank", None)], "case_id string, code string, field string")
    templates = spark.createDataFrame([("conflict", "mass", "CBAM article 6 declaration must"), ("blank", None, "lunch")], "code string, field string, query string")
    got = {(r.case_id, r.code, r.field): (r.status, r.ids[:1]) for r in pipelines.issue_citations(issues, templates, corpus, ["case_id"]).collect()}
    assert got == {("c1", "conflict", "mass"): ("supported", ["CBAM-A6"]), ("c2", "conflict", "mass"): ("supported", ["CBAM-A6"]), ("c1", "conflict", "other"): ("unmapped", []), ("c3", "blank", None): ("abstained", [])}


def test_reused_queries_are_found_in_any_spelling(spark):
    from ledgerloom.operators.contracts import reused_queries

    held = spark.createDataFrame([(1, "ＣＢＡＭ  declaration?"), (2, "another"), (3, ""), (4, None)], "k int, q string")
    known = spark.createDataFrame([(8, "cbam declaration"), (9, "CBAM, Declaration"), (10, " ")], "k int, q string")
    assert {tuple(r) for r in reused_queries(held, known, "k", "q").collect()} == {(1, 8), (1, 9)}
