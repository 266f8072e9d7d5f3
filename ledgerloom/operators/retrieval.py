"""Field-weighted BM25 retrieval over words and character n-grams, decisions with abstention, and retrieval metrics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import contains_phrase, folded_form, ngrams, words
from ledgerloom.operators.phrases import with_phrases
from ledgerloom.session import small

# Saturation, weight of the n-gram channel, bonuses and thresholds of decisions.
K1 = 1.2
GRAM_WEIGHT = 0.18
CONCEPT_BONUS, ARTICLE_BONUS = 4.0, 12.0
MIN_SCORE, MIN_MARGIN = 2.0, 0.35
# Names of the instruments, words of a question of law, and how an article is referred to.
INSTRUMENTS = {
    "CBAM": ("cbam", "탄소국경조정제도", "regulation eu 2023 956", "regulation 2023 956", "2023 956", "32023r0956"),
    "EUDR": ("eudr", "산림전용방지규정", "산림 전용 방지 규정", "eu 산림 규정", "regulation eu 2023 1115", "regulation 2023 1115", "2023 1115", "32023r1115"),
}
CUES = (
    "어떤 조항", "몇 조", "몇조", "의무", "제출", "누락", "빠졌", "빠졌다", "없으면", "없다", "없이", "신고", "증빙", "공제", "차감", "감축", "줄일 수", "검증",
    "확인 없이", "근거", "산정", "계산", "해야", "필요", "할 수 있", "인정", "비준수", "적합", "위반", "완화", "before placing", "must", "required", "evidence", "comply",
)
ARTICLE = r"(?:article|art\.?)\s*([0-9]+[a-z]?)|제\s*([0-9]+[a-z]?)\s*조"


@dataclass(frozen=True)
class Fields:
    """Weight and length normalisation by field."""

    weight: dict[str, float] = field(
        default_factory=lambda: {"regulation": 5.0, "article": 8.0, "title": 4.0, "keywords": 3.0, "concepts": 4.0, "summary": 1.0}
    )
    slope: dict[str, float] = field(
        default_factory=lambda: {"regulation": 0.0, "article": 0.0, "title": 0.2, "keywords": 0.2, "concepts": 0.2, "summary": 0.75}
    )

    def column(self, values: dict[str, float]) -> Column:
        return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[F.col("field")]


def article_number(article: Column) -> Column:
    """The first number, with a letter, of an article's name; null without one."""
    return F.nullif(F.regexp_extract(F.lower(article), r"\b([0-9]+[a-z]?)\b", 1), F.lit(""))


def entry_fields(corpus: DataFrame) -> DataFrame:
    """id, field, text: the searchable fields of reference entries."""
    number = article_number(F.col("article"))
    concepts = F.concat_ws(" ", F.map_keys("concepts"), F.flatten(F.map_values("concepts")))
    texts = {
        "regulation": F.concat_ws(" ", "instrument", "regulation", "celex"),
        "article": F.concat_ws(" ", "article", "paragraph", F.concat(F.lit("제"), number, F.lit("조")), F.concat(number, F.lit("조"))),
        "title": F.col("title"), "keywords": F.concat_ws(" ", "keywords"), "concepts": concepts, "summary": F.col("summary_ko"),
    }
    pairs = F.array(*(F.struct(F.lit(k).alias("field"), folded_form(F.coalesce(v, F.lit(""))).alias("text")) for k, v in texts.items()))
    return corpus.select("id", F.explode(pairs).alias("f")).select("id", "f.field", "f.text")


def terms(text: Column) -> Column:
    """Words, and all 2- and 3-grams of words, as structs of channel and term."""
    tokens = words(text)
    grams = lambda n: F.flatten(F.transform(tokens, lambda w: ngrams(w, n)))
    tag = lambda xs, channel: F.transform(xs, lambda x: F.struct(F.lit(channel).alias("channel"), x.alias("term")))
    return F.concat(tag(tokens, "word"), tag(grams(2), "gram"), tag(grams(3), "gram"))


def postings(fields: DataFrame, key: str) -> DataFrame:
    """key, field, channel, term, tf."""
    spread = fields.select(key, "field", F.explode(terms(F.col("text"))).alias("t")).select(key, "field", "t.channel", "t.term")
    return spread.groupBy(key, "field", "channel", "term").agg(F.count("*").alias("tf"))


def lengths(fields: DataFrame, key: str) -> DataFrame:
    """key, field, channel, length, of empty fields too; grams are counted in closed form instead of being spread."""
    tokens = words(F.col("text"))
    grams = F.aggregate(tokens, F.lit(0), lambda s, w: s + F.greatest(F.length(w) - 1, F.lit(0)) + F.greatest(F.length(w) - 2, F.lit(0)))
    both = F.array(F.struct(F.lit("word").alias("channel"), F.size(tokens).alias("length")), F.struct(F.lit("gram").alias("channel"), grams.alias("length")))
    return fields.select(key, "field", F.explode(both).alias("l")).select(key, "field", "l.channel", "l.length")


def document_frequency(posts: DataFrame, key: str) -> DataFrame:
    return posts.groupBy("channel", "term").agg(F.countDistinct(key).alias("df"))


def idf(df: Column, total: Column) -> Column:
    return F.log1p((total - df + 0.5) / (df + 0.5))


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """key, channel, term, qtf of queries."""
    spread = queries.select(key, F.explode(terms(folded_form(F.col(text)))).alias("t")).select(key, "t.channel", "t.term")
    return spread.groupBy(key, "channel", "term").agg(F.count("*").alias("qtf"))


def term_scores(queries: DataFrame, fields: DataFrame, query_key: str, query_text: str, settings: Fields = Fields(), channels: tuple[str, ...] = ("word", "gram"), parts: bool = True) -> DataFrame:
    """query_key, id, channel, term, score, parts (weighted frequency by field, if asked for), wtf of every term that a
    query and an entry share.

    Only terms that some query has are spread into postings (a semi-join before counting), while lengths and numbers of
    entries come from the whole corpus, so that scores are those of the whole index.
    """
    asked = query_terms(queries, query_key, query_text).filter(F.col("channel").isin(*channels))
    posts = postings(fields, "id").filter(F.col("channel").isin(*channels)).join(small(asked.select("channel", "term").distinct()), ["channel", "term"], "left_semi")
    sizes = lengths(fields, "id")
    means = sizes.groupBy("field", "channel").agg(F.avg("length").alias("mean"))
    total = fields.agg(F.countDistinct("id").alias("total"))
    weighted = (
        posts.join(sizes, ["id", "field", "channel"])
        .join(F.broadcast(means), ["field", "channel"])  # a row per field and channel
        .withColumn("slope", settings.column(settings.slope))
        .withColumn("mean", F.when(F.col("mean") == 0, 1.0).otherwise(F.col("mean")))
        .withColumn("part", settings.column(settings.weight) * F.col("tf") / (1 - F.col("slope") + F.col("slope") * F.col("length") / F.col("mean")))
        .groupBy("id", "channel", "term")
        .agg(F.sum("part").alias("wtf"), *((F.collect_list(F.struct("field", "part")).alias("parts"),) if parts else ()))  # a row per field
    )
    rare = document_frequency(posts, "id").crossJoin(F.broadcast(total)).select("channel", "term", idf(F.col("df"), F.col("total")).alias("idf"))
    channel_weight = F.when(F.col("channel") == "word", 1.0).otherwise(GRAM_WEIGHT)
    scored = asked.join(weighted, ["channel", "term"]).join(rare, ["channel", "term"])
    value = F.col("idf") * (K1 + 1) * F.col("wtf") / (K1 + F.col("wtf")) * (1 + 0.1 * (F.least("qtf", F.lit(2)) - 1)) * channel_weight
    return scored.select(query_key, "id", "channel", "term", value.alias("score"), *(("parts",) if parts else ()), "wtf")


def bm25f(queries: DataFrame, fields: DataFrame, query_key: str, query_text: str, settings: Fields = Fields(), channels: tuple[str, ...] = ("word", "gram")) -> DataFrame:
    """query_key, id, score (6 digits) of every query and entry that share a term."""
    scored = term_scores(queries, fields, query_key, query_text, settings, channels, parts=False)
    return scored.groupBy(query_key, "id").agg(F.round(F.sum("score"), 6).alias("score"))


def field_contributions(scored: DataFrame, query_key: str) -> DataFrame:
    """query_key, id, field, contribution: what each field adds to the score, in proportion to its part of each term."""
    spread = scored.select(query_key, "id", "score", "wtf", F.explode("parts").alias("p"))
    return spread.groupBy(query_key, "id", "p.field").agg(F.round(F.sum(F.col("score") * F.col("p.part") / F.col("wtf")), 6).alias("contribution"))


def term_trace(scored: DataFrame, query_key: str) -> DataFrame:
    """query_key, id, place, channel, term, score of every matched term, greatest score first, then channel and term."""
    w = Window.partitionBy(query_key, "id").orderBy(F.col("score").desc(), "channel", "term")
    rounded = scored.select(query_key, "id", "channel", "term", F.round("score", 6).alias("score"))
    return rounded.withColumn("place", F.row_number().over(w)).select(query_key, "id", "place", "channel", "term", "score")


def concept_aliases(corpus: DataFrame) -> DataFrame:
    """id, instrument, concept, alias (in search form) of every alias of every concept."""
    return (
        corpus.select("id", "instrument", F.explode("concepts").alias("concept", "aliases"))
        .select("id", "instrument", "concept", F.explode("aliases").alias("alias"))
        .select("id", "instrument", "concept", folded_form(F.col("alias")).alias("alias"))
        .distinct()
    )


def _hits(asked: DataFrame, corpus: DataFrame, query_key: str) -> DataFrame:
    """asked with hits: the aliases that occur, ASCII ones at the edges of tokens."""
    found = with_phrases(asked, [query_key], F.col("asked"), concept_aliases(corpus), "alias", "hits")
    return found.withColumn("hits", F.filter("hits", lambda p: contains_phrase(F.col("asked"), p["alias"])))


def concept_hits(queries: DataFrame, corpus: DataFrame, query_key: str, query_text: str) -> DataFrame:
    """query_key, id, instrument, concepts: numbers of concepts of each entry that a query names by an alias."""
    asked = queries.select(query_key, folded_form(F.col(query_text)).alias("asked"))
    hits = _hits(asked, corpus, query_key).select(query_key, F.explode("hits").alias("h"))
    return hits.groupBy(query_key, "h.id", "h.instrument").agg(F.countDistinct("h.concept").alias("concepts"))


@dataclass(frozen=True)
class Gate:
    """What the gate knows: names of instruments, and cues that tell a question of law."""

    instruments: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(INSTRUMENTS))
    cues: tuple[str, ...] = CUES

    def named(self, asked: Column) -> Column:
        """The instruments that a text names, in order."""
        names = [F.when(_any_of(asked, names), F.lit(i)) for i, names in sorted(self.instruments.items())]
        return F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")

    def intent(self, asked: Column) -> Column:
        """The cues in a text, in order."""
        found = [F.when(_any_of(asked, (c,)), F.lit(c)) for c in sorted(self.cues)]
        return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def _any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | contains_phrase(text, F.lit(p))
    return found


def article_references(asked: Column) -> Column:
    """The article numbers that a text refers to, sorted."""
    every = F.concat(*(F.regexp_extract_all(asked, F.lit(ARTICLE), F.lit(k)) for k in (1, 2)))
    return F.array_sort(F.array_distinct(F.filter(every, lambda x: x != "")))


def gate(queries: DataFrame, corpus: DataFrame, query_key: str, query_text: str, settings: Gate = Gate()) -> DataFrame:
    """query_key, instrument, source, instruments (named), cues, articles, concepts (of the best instrument), reason.

    A query passes (domain_supported) if it names one instrument and either an article, or a concept of it together with
    a cue or another concept; or if it names none, has a cue and two concepts of one instrument at least, more than of
    any other. Else: ambiguous_instrument if several are named, or none but an article, or concepts tie; underspecified
    if one is named with too little; out_of_domain otherwise. Every query stays. All is judged within its row.
    """
    asked = queries.select(query_key, F.coalesce(folded_form(F.col(query_text)), F.lit("")).alias("asked"))
    rows = _hits(asked, corpus, query_key).withColumns(
        {"named": settings.named(F.col("asked")), "cues": settings.intent(F.col("asked")), "articles": article_references(F.col("asked"))}
    )
    pairs = F.array_distinct(F.transform("hits", lambda h: F.struct(h["instrument"].alias("i"), h["concept"].alias("c"))))
    rows = rows.withColumn("pairs", pairs)
    counted = F.transform(
        F.array_distinct(F.transform("pairs", lambda p: p["i"])), lambda i: F.struct(F.size(F.filter("pairs", lambda p: p["i"] == i)).alias("n"), i.alias("i"))
    )
    rows = rows.withColumn("counted", counted).withColumn("best", F.array_max("counted"))
    one, several, none = F.size("named") == 1, F.size("named") > 1, F.size("named") == 0
    own = F.size(F.filter("pairs", lambda p: p["i"] == F.col("named")[0]))
    some_cue, articled = F.size("cues") > 0, F.size("articles") > 0
    enough = articled | ((own > 0) & (some_cue | (own >= 2)))
    most = F.coalesce(F.col("best.n"), F.lit(0))
    tie = F.size(F.filter("counted", lambda x: x["n"] == most)) > 1
    reason = (
        F.when(several, "ambiguous_instrument").when(one & enough, "domain_supported").when(one, "underspecified").when(articled, "ambiguous_instrument")
        .when(~some_cue | (most < 2), "out_of_domain").when(tie, "ambiguous_instrument").otherwise("domain_supported")
    )
    inferred = none & (reason == "domain_supported")
    instrument = F.when(one, F.col("named")[0]).when(inferred, F.col("best.i"))
    source = F.when(one, "explicit").when(inferred, "inferred_from_concepts")
    concepts = F.when(one, own).otherwise(most)
    return rows.select(
        query_key, instrument.alias("instrument"), source.alias("source"), F.size("named").alias("instruments"), F.size("cues").alias("cues"), "articles",
        concepts.alias("concepts"), reason.alias("reason"),
    )


def top_k(scores: DataFrame, query_key: str, k: int, min_score: float = MIN_SCORE, min_margin: float = MIN_MARGIN) -> DataFrame:
    """query_key, id, score, rank, margin, decision of the best k entries; the margin is taken over all scored entries."""
    w = Window.partitionBy(query_key).orderBy(F.col("score").desc(), "id")
    ranked = scores.withColumns({"rank": F.row_number().over(w), "margin": F.round(F.col("score") - F.lead("score").over(w), 6)})
    decision = (
        F.when(F.col("score") < min_score, "abstained").when(F.col("margin") < min_margin, "review").otherwise("supported")
    )
    return ranked.filter(F.col("rank") <= k).select(query_key, "id", "score", "rank", "margin", decision.alias("decision"))


def metrics(results: DataFrame, cases: DataFrame, case_key: str, k: int) -> DataFrame:
    """cases, hit rate, macro recall and reciprocal rank at k over cases that expect ids, and leakage of forbidden ids."""
    best = results.filter(F.col("rank") <= k).groupBy(case_key).agg(F.collect_list(F.struct("rank", "id")).alias("found"))  # k entries at most
    rows = cases.select(case_key, "expected_ids", "forbidden_ids").join(best, case_key, "left")
    found = F.coalesce(F.transform("found", lambda x: x["id"]), F.array().cast("array<string>"))
    right = F.size(F.array_intersect("expected_ids", found))
    first = F.array_min(F.transform(F.filter("found", lambda x: F.array_contains("expected_ids", x["id"])), lambda x: x["rank"]))
    expects = F.size("expected_ids") > 0
    return rows.agg(
        F.count("*").alias("cases"),
        F.bround(F.avg(F.when(expects, (right > 0).cast("int"))), 6).alias("hit_rate"),
        F.bround(F.avg(F.when(expects, right / F.size("expected_ids"))), 6).alias("recall"),
        F.bround(F.avg(F.when(expects, F.coalesce(1 / first, F.lit(0.0)))), 6).alias("mrr"),
        F.count_if(F.size(F.array_intersect("forbidden_ids", found)) > 0).alias("leaks"),
    )


# What a citation must have to be traced.
CITATION = ("id", "regulation", "celex", "article", "paragraph", "url", "source_checked_on", "source_status")


def judged_cases(decisions: DataFrame, cases: DataFrame, corpus: DataFrame, case_key: str) -> DataFrame:
    """One row per case: kind, status and what its results (of the retrieval pipeline) are worth.

    retrieval (positive or distractor), hit, recall, reciprocal_rank, covered, abstained, rejected (the first result is
    no forbidden one), leaking (a result of another instrument than the expected), results, traced (results whose entry
    has all of CITATION), status_matches. A retrieval case without expected ids has neither hit nor recall.
    """
    sound = F.lit(True)
    for c in CITATION:
        sound = sound & (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "")
    entries = corpus.select("id", F.col("instrument").alias("of"), sound.alias("sound"))
    result = F.when(F.col("id").isNotNull(), F.struct("rank", "id", "of", "sound"))
    grouped = decisions.join(small(entries), "id", "left").groupBy(case_key).agg(
        F.any_value("status").alias("status"), F.any_value("decision_reason").alias("decision_reason"), F.array_sort(F.collect_list(result)).alias("found")
    )  # k results at most
    rows = cases.select(case_key, "case_type", "expected_status", "expected_instrument", "expected_ids", "forbidden_ids").join(grouped, case_key, "left")
    rows = rows.withColumns({"found": F.coalesce("found", F.expr("filter(found, x -> false)")), "status": F.coalesce("status", F.lit("abstained"))})
    ids = F.coalesce(F.transform("found", lambda x: x["id"]), F.array().cast("array<string>"))
    rows = rows.withColumn("ids", ids).withColumn("retrieval", F.col("case_type").isin("positive", "distractor"))
    expected = F.size("expected_ids")
    first = F.array_min(F.transform(F.filter("found", lambda x: F.array_contains("expected_ids", x["id"])), lambda x: x["rank"]))
    right = F.size(F.array_intersect("expected_ids", "ids"))
    other = F.exists("found", lambda x: ~F.coalesce(x["of"] == F.col("expected_instrument"), F.lit(False)))
    forbidden_first = F.array_contains("forbidden_ids", F.get("ids", F.lit(0)))
    when = lambda c, kind: F.when(F.col("case_type") == kind, c)
    return rows.select(
        case_key, "case_type", "status", "decision_reason", "retrieval", F.when(F.col("retrieval"), (right > 0)).alias("hit"),
        F.when(F.col("retrieval"), F.coalesce(F.try_divide(right, expected), F.lit(0.0))).alias("recall"),
        F.when(F.col("retrieval"), F.coalesce(1 / first, F.lit(0.0))).alias("reciprocal_rank"),
        when(F.col("status") != "abstained", "positive").alias("covered"), when(F.col("status") == "abstained", "negative").alias("abstained"),
        when(~F.coalesce(forbidden_first, F.lit(False)), "distractor").alias("rejected"),
        F.when(F.col("expected_instrument").isNotNull(), F.coalesce(other, F.lit(False))).alias("leaking"),
        F.size("ids").alias("results"), F.size(F.filter("found", lambda x: x["sound"])).alias("traced"),
        F.coalesce(F.col("status") == F.col("expected_status"), F.lit(False)).alias("status_matches"),
    )


def evaluation(judged: DataFrame) -> DataFrame:
    """Counts of cases and the ten rates over judged_cases, 4 digits half-even; a rate without cases is 0."""
    rate = lambda c: F.coalesce(F.bround(F.avg(c.cast("double")), 4), F.lit(0.0))
    kind = lambda k: F.count_if(F.col("case_type") == k)
    return judged.agg(
        F.count("*").alias("cases"), kind("positive").alias("positive"), kind("negative").alias("negative"), kind("distractor").alias("distractor"),
        rate(F.col("hit")).alias("hit_rate"), rate(F.col("recall")).alias("recall"), rate(F.col("reciprocal_rank")).alias("mrr"),
        rate(F.col("covered")).alias("positive_coverage"), rate(F.col("abstained")).alias("negative_abstention"), rate(~F.col("abstained")).alias("false_support"),
        rate(F.col("rejected")).alias("distractor_rejection"), rate(F.col("leaking")).alias("instrument_leakage"),
        F.coalesce(F.bround(F.try_divide(F.sum("traced"), F.sum("results")), 4), F.lit(0.0)).alias("trace_coverage"), rate(F.col("status_matches")).alias("status_match"),
    )


# Limits of an accepted evaluation (rate, whether it is a least or a greatest value, limit).
ACCEPTANCE = (
    ("recall", "least", 0.75), ("negative_abstention", "least", 0.75), ("distractor_rejection", "least", 0.75), ("status_match", "least", 1.0),
    ("false_support", "greatest", 0.25), ("instrument_leakage", "greatest", 0.0),
)


def acceptance(evaluated: DataFrame, limits: tuple[tuple[str, str, float], ...] = ACCEPTANCE) -> DataFrame:
    """rate, bound, limit, observed, passed for every limit."""
    rows = F.array(*(F.struct(F.lit(r).alias("rate"), F.lit(b).alias("bound"), F.lit(x).alias("limit"), F.col(r).alias("observed")) for r, b, x in limits))
    spread = evaluated.select(F.explode(rows).alias("r")).select("r.*")
    passed = F.when(F.col("bound") == "least", F.col("observed") >= F.col("limit")).otherwise(F.col("observed") <= F.col("limit"))
    return spread.withColumn("passed", passed)
