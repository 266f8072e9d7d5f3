"""Retrieval operators on evaluation items, reference entries and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import pipelines, retrieval
from ledgerloom.operators.phrases import with_phrases
from ledgerloom.plans.registry import SPACE, Registry
from ledgerloom.session import table

registry = Registry()
query = registry.query

_WORDS = "regexp_extract_all({}, '[0-9a-z가-힣]+')"
_FORM = "trim(regexp_replace(lower({}), '[^0-9a-z가-힣]+', ' ', 'g'))"


def _grams(ws: str) -> str:
    one = "flatten(list_transform({w}, lambda w: list_transform(range(1, length(w) - {n} + 2), lambda i: substr(w, i, {n}))))"
    return f"list_concat({one.format(w=ws, n=2)}, {one.format(w=ws, n=3)})"


_TERMS_OF = lambda t: (_WORDS.format(f"lower({t})"), _grams(_WORDS.format(f"lower({t})")))
_W, _G = _TERMS_OF("t")

_NUMBER = "nullif(regexp_extract(lower(article), '\\b([0-9]+[a-z]?)\\b', 1), '')"
_FIELDS_SQL = f"""f0 AS (
    SELECT id, 'regulation' AS field, 5.0 AS w, 0.0 AS b, concat_ws(' ', instrument, regulation, celex) AS t FROM legal_corpus
    UNION ALL SELECT id, 'article', 8.0, 0.0, concat_ws(' ', article, paragraph, '제' || {_NUMBER} || '조', {_NUMBER} || '조') FROM legal_corpus
    UNION ALL SELECT id, 'title', 4.0, 0.2, title FROM legal_corpus UNION ALL SELECT id, 'keywords', 3.0, 0.2, array_to_string(keywords, ' ') FROM legal_corpus
    UNION ALL SELECT id, 'concepts', 4.0, 0.2, array_to_string(list_concat(map_keys(concepts), flatten(map_values(concepts))), ' ') FROM legal_corpus
    UNION ALL SELECT id, 'summary', 1.0, 0.75, summary_ko FROM legal_corpus),
f AS (SELECT id, field, w, b, {_FORM.format("t")} AS t FROM f0)"""

_SCORES_SQL = f"""{_FIELDS_SQL},
tk AS (SELECT id, field, w, b, 'word' AS channel, unnest({_W}) AS term FROM f UNION ALL SELECT id, field, w, b, 'gram', unnest({_G}) FROM f),
ln AS (SELECT id, field, 'word' AS channel, len({_W}) AS n FROM f UNION ALL SELECT id, field, 'gram', len({_G}) FROM f),
mn AS (SELECT field, channel, CASE WHEN avg(n) = 0 THEN 1 ELSE avg(n) END AS a FROM ln GROUP BY 1, 2),
tf AS (SELECT id, field, w, b, channel, term, count(*) AS tf FROM tk GROUP BY ALL),
dfs AS (SELECT channel, term, count(DISTINCT id) AS df FROM tk GROUP BY 1, 2),
qs AS (SELECT item_id, {_FORM.format("query")} AS t FROM eval_items),
q AS (SELECT item_id, channel, term, count(*) AS qtf FROM (
    SELECT item_id, 'word' AS channel, unnest({_W}) AS term FROM qs UNION ALL SELECT item_id, 'gram', unnest({_G}) FROM qs) x GROUP BY ALL),
pt AS (SELECT tf.id, tf.field, tf.channel, tf.term, w * tf / (1 - b + b * n / a) AS part
    FROM tf JOIN ln ON ln.id = tf.id AND ln.field = tf.field AND ln.channel = tf.channel JOIN mn ON mn.field = tf.field AND mn.channel = tf.channel),
wt AS (SELECT id, channel, term, sum(part) AS wtf FROM pt GROUP BY ALL),
ts AS (SELECT item_id, id, q.channel, q.term, wtf, ln(1 + ((SELECT count(DISTINCT id) FROM f) - df + 0.5) / (df + 0.5)) * 2.2 * wtf / (1.2 + wtf)
        * (1 + 0.1 * (least(qtf, 2) - 1)) * CASE WHEN q.channel = 'word' THEN 1.0 ELSE 0.18 END AS ts
    FROM q JOIN wt ON wt.channel = q.channel AND wt.term = q.term JOIN dfs ON dfs.channel = q.channel AND dfs.term = q.term),
scores AS (SELECT item_id, id, round(sum(ts), 6) AS score FROM ts GROUP BY ALL),
top AS (SELECT *, row_number() OVER s AS rank, round(score - lead(score) OVER s, 6) AS margin FROM scores WINDOW s AS (PARTITION BY item_id ORDER BY score DESC, id))"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items")


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "legal_corpus")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25f(_items(spark, d), retrieval.entry_fields(_corpus(spark, d)), "item_id", "query")


@query(f"SELECT item_id, term, count(*) AS n FROM (SELECT item_id, unnest({_WORDS.format('lower(query)')}) AS term FROM eval_items) x GROUP BY 1, 2")
def tokens(spark: SparkSession, d: str) -> DataFrame:
    spread = _items(spark, d).select("item_id", F.explode(text.words(F.col("query"))).alias("term"))
    return spread.groupBy("item_id", "term").agg(F.count("*").alias("n"))


@query(f"SELECT item_id, term, count(*) AS n FROM (SELECT item_id, unnest({_grams(_WORDS.format('lower(query)'))}) AS term FROM eval_items) x GROUP BY 1, 2")
def ngrams(spark: SparkSession, d: str) -> DataFrame:
    spread = _items(spark, d).select("item_id", F.explode(retrieval.terms(F.col("query"))).alias("t")).filter("t.channel = 'gram'")
    return spread.groupBy("item_id", F.col("t.term").alias("term")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, {_FORM.format('text')} AS form FROM documents")
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.search_form(F.col("text")).alias("form"))


@query()
def text_normalize_folded(spark: SparkSession, d: str) -> DataFrame:
    """The search form after compatibility folding, which SQL lacks."""
    folded = text.search_form(text.compatibility_fold(F.col("text")))
    return table(spark, d, "documents").select("doc_id", folded.alias("form"))


@query(f"SELECT DISTINCT cand_id, trim(regexp_replace(nfc_normalize(raw_label), '{SPACE}', ' ', 'g')) AS form FROM candidates")
def text_composed(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "candidates").select("cand_id", "raw_label").distinct()
    return rows.select("cand_id", text.composed(F.col("raw_label")).alias("form")).distinct()


_EDGES = "(regexp_matches({p}, '[^\\x00-\\x7f]') OR regexp_matches(asked, '(^|[^0-9a-z])' || {p} || '($|[^0-9a-z])'))"
_ALIAS_SQL = f"""al AS (SELECT DISTINCT id, instrument, concept, {_FORM.format('alias')} AS alias FROM (
    SELECT id, instrument, concept, unnest(aliases) AS alias FROM (
        SELECT id, instrument, unnest(map_keys(concepts)) AS concept, unnest(map_values(concepts)) AS aliases FROM legal_corpus) x) y),
ask AS (SELECT item_id, {_FORM.format('query || chr(32) || array_to_string(tags, chr(32))')} AS asked FROM eval_items),
hit AS (SELECT item_id, id, instrument, concept FROM ask JOIN al ON alias <> '' AND contains(asked, alias)
        AND {_EDGES.format(p="alias")})"""


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Queries with their tags, which name topics."""
    return _items(spark, d).select("item_id", F.concat_ws(" ", "query", F.concat_ws(" ", "tags")).alias("asked"))


@query(f"WITH {_ALIAS_SQL} SELECT item_id, id, count(DISTINCT concept) AS concepts FROM hit GROUP BY 1, 2")
def phrase_match(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.concept_hits(_asked(spark, d), _corpus(spark, d), "item_id", "asked").select("item_id", "id", "concepts")


_LIST = lambda xs: "(VALUES " + ", ".join(f"({x})" for x in xs) + ")"
_NAMES = _LIST(f"'{i}', '{a}'" for i, names in retrieval.INSTRUMENTS.items() for a in names)
_CUES = _LIST(f"'{c}'" for c in retrieval.CUES)
_REFERENCE = "(?:article|art\\.?)\\s*([0-9]+[a-z]?)|제\\s*([0-9]+[a-z]?)\\s*조"

_GATE_SQL = f"""per AS (SELECT item_id, instrument, count(DISTINCT concept) AS n FROM hit GROUP BY 1, 2),
best AS (SELECT item_id, max(n) AS n, arg_max(instrument, (n, instrument)) AS instrument FROM per GROUP BY 1),
tied AS (SELECT per.item_id, count(*) AS k FROM per JOIN best b ON b.item_id = per.item_id AND b.n = per.n GROUP BY 1),
ex AS (SELECT item_id, count(DISTINCT i) AS n, min(i) AS i FROM ask JOIN {_NAMES} z(i, a) ON contains(asked, a) AND {_EDGES.format(p="a")} GROUP BY 1),
cu AS (SELECT item_id, count(DISTINCT c) AS n FROM ask JOIN {_CUES} z(c) ON contains(asked, c) AND {_EDGES.format(p="c")} GROUP BY 1),
ar AS (SELECT item_id, list_sort(list_distinct(list_filter(list_concat(regexp_extract_all(asked, '{_REFERENCE}', 1), regexp_extract_all(asked, '{_REFERENCE}', 2)), lambda x: x <> ''))) AS articles FROM ask),
g0 AS (SELECT ask.item_id, coalesce(ex.n, 0) AS named, ex.i AS one, coalesce(cu.n, 0) AS cues, articles, coalesce(own.n, 0) AS own, coalesce(b.n, 0) AS most, b.instrument AS guess, coalesce(tied.k, 0) AS ties
    FROM ask LEFT JOIN ex ON ex.item_id = ask.item_id LEFT JOIN cu ON cu.item_id = ask.item_id LEFT JOIN ar ON ar.item_id = ask.item_id
    LEFT JOIN per own ON own.item_id = ask.item_id AND own.instrument = ex.i LEFT JOIN best b ON b.item_id = ask.item_id LEFT JOIN tied ON tied.item_id = ask.item_id),
g1 AS (SELECT *, CASE WHEN named > 1 THEN 'ambiguous_instrument'
        WHEN named = 1 THEN CASE WHEN len(articles) > 0 OR own > 0 AND (cues > 0 OR own >= 2) THEN 'domain_supported' ELSE 'underspecified' END
        WHEN len(articles) > 0 THEN 'ambiguous_instrument' WHEN cues = 0 OR most < 2 THEN 'out_of_domain' WHEN ties > 1 THEN 'ambiguous_instrument' ELSE 'domain_supported' END AS reason FROM g0),
gated AS (SELECT item_id, CASE WHEN named = 1 THEN one WHEN named = 0 AND reason = 'domain_supported' THEN guess END AS instrument,
        CASE WHEN named = 1 THEN 'explicit' WHEN named = 0 AND reason = 'domain_supported' THEN 'inferred_from_concepts' END AS source,
        CAST(named AS INT) AS instruments, CAST(cues AS INT) AS cues, articles, CAST(CASE WHEN named = 1 THEN own ELSE most END AS INT) AS concepts, reason FROM g1)"""


@query(f"WITH {_ALIAS_SQL}, {_GATE_SQL} SELECT * REPLACE (array_to_string(articles, ',') AS articles) FROM gated")
def query_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = retrieval.gate(_asked(spark, d), _corpus(spark, d), "item_id", "asked")
    return rows.withColumn("articles", F.array_join("articles", ","))


_DOC_TERMS = f"dt AS (SELECT doc_id, unnest({_WORDS.format('lower(text)')}) AS term FROM documents)"


def _document_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(text.words(F.col("text"))).alias("term"))


@query(f"WITH {_DOC_TERMS} SELECT term, count(DISTINCT doc_id) AS df FROM dt GROUP BY 1")
def doc_frequency(spark: SparkSession, d: str) -> DataFrame:
    distinct = table(spark, d, "documents").select(F.explode(F.array_distinct(text.words(F.col("text")))).alias("term"))
    return distinct.groupBy("term").agg(F.count("*").alias("df"))


@query(f"WITH {_DOC_TERMS}, n AS (SELECT count(*) AS n FROM documents) SELECT term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM (SELECT term, count(DISTINCT doc_id) AS df FROM dt GROUP BY 1) x, n")
def idf(spark: SparkSession, d: str) -> DataFrame:
    total = table(spark, d, "documents").agg(F.count("*").alias("total"))
    rows = doc_frequency(spark, d).crossJoin(F.broadcast(total))  # one row
    return rows.select("term", F.round(retrieval.idf(F.col("df"), F.col("total")), 6).alias("idf"))


@query(f"WITH {_FIELDS_SQL} SELECT field, round_even(avg(len({_W})), 6) AS words, round_even(avg(len({_G})), 6) AS grams FROM f GROUP BY 1")
def avg_field_len(spark: SparkSession, d: str) -> DataFrame:
    sizes = retrieval.lengths(retrieval.entry_fields(_corpus(spark, d)), "id")
    mean = lambda c: F.bround(F.avg(F.when(F.col("channel") == c, F.col("length"))), 6)
    return sizes.groupBy("field").agg(mean("word").alias("words"), mean("gram").alias("grams"))


@query(f"WITH {_SCORES_SQL} SELECT item_id, id, score FROM scores")
def bm25f_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)


@query(f"""WITH {_SCORES_SQL} SELECT item_id, id, score, rank, margin,
    CASE WHEN score < 2.0 THEN 'abstained' WHEN margin < 0.35 THEN 'review' ELSE 'supported' END AS decision FROM top WHERE rank <= 3""")
def retrieval_topk_margin(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.top_k(_scores(spark, d), "item_id", 3)


@query(f"""WITH {_SCORES_SQL}, b AS (SELECT item_id, list(id) AS ids, list({{'r': rank, 'id': id}}) AS rs FROM top WHERE rank <= 3 GROUP BY 1),
c AS (SELECT e.item_id, expected_ids, forbidden_ids, coalesce(ids, []) AS ids, list_min(list_transform(list_filter(rs, lambda x: list_contains(expected_ids, x.id)), lambda x: x.r)) AS first
      FROM eval_items e LEFT JOIN b ON b.item_id = e.item_id)
SELECT count(*) AS cases, round_even(avg(CASE WHEN len(expected_ids) > 0 THEN CASE WHEN len(list_intersect(expected_ids, ids)) > 0 THEN 1 ELSE 0 END END), 6) AS hit_rate,
    round_even(avg(CASE WHEN len(expected_ids) > 0 THEN len(list_intersect(expected_ids, ids)) / len(expected_ids) END), 6) AS recall,
    round_even(avg(CASE WHEN len(expected_ids) > 0 THEN coalesce(1 / first, 0) END), 6) AS mrr,
    count(*) FILTER (WHERE len(list_intersect(forbidden_ids, ids)) > 0) AS leaks FROM c""")
def ir_metrics(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.metrics(retrieval.top_k(_scores(spark, d), "item_id", 3), _items(spark, d), "item_id", 3)


@query(f"""WITH p AS (SELECT DISTINCT {_FORM.format('t')} AS phrase FROM (SELECT title AS t FROM legal_corpus UNION ALL SELECT summary_ko FROM legal_corpus
    UNION ALL SELECT unnest(keywords) FROM legal_corpus UNION ALL SELECT unnest(flatten(map_values(concepts))) FROM legal_corpus) x),
d AS (SELECT doc_id, replace({_FORM.format('text')}, ' ', '') AS compact FROM documents)
SELECT doc_id, phrase FROM d JOIN p ON length(replace(phrase, ' ', '')) >= 8 AND contains(compact, replace(phrase, ' ', ''))""")
def holdout_leakage(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    parts = (
        c.select(F.col("title").alias("t")).union(c.select("summary_ko")).union(c.select(F.explode("keywords")))
        .union(c.select(F.explode(F.flatten(F.map_values("concepts")))))
    )
    phrases = parts.select(text.folded_form(F.col("t")).alias("phrase")).distinct()
    phrases = phrases.withColumn("needle", F.replace(F.col("phrase"), F.lit(" "), F.lit(""))).filter(F.length("needle") >= 8)
    compact = F.replace(text.folded_form(F.col("text")), F.lit(" "), F.lit(""))
    rows = table(spark, d, "documents").select("doc_id", compact.alias("compact"))
    found = with_phrases(rows, ["doc_id"], F.col("compact"), phrases, "needle", "hits")
    return found.select("doc_id", F.explode("hits.phrase").alias("phrase"))


_DECIDED_SQL = f"""asked_items AS (SELECT item_id, query || ' ' || array_to_string(tags, ' ') AS query FROM eval_items),
{_SCORES_SQL.replace("FROM eval_items)", "FROM asked_items)", 1)}, {_ALIAS_SQL}, {_GATE_SQL},
con AS (SELECT item_id, id, count(DISTINCT concept) AS concepts FROM hit GROUP BY 1, 2),
num AS (SELECT id, instrument, {_NUMBER} AS article FROM legal_corpus),
kn AS (SELECT instrument, list(article) AS known FROM num WHERE article IS NOT NULL GROUP BY 1),
st AS (SELECT gated.*, CASE WHEN reason <> 'domain_supported' THEN reason
        WHEN len(list_filter(articles, lambda a: NOT list_contains(coalesce(known, []), a))) > 0 THEN 'article_not_in_corpus' END AS stopped FROM gated LEFT JOIN kn ON kn.instrument = gated.instrument),
tot AS (SELECT st.item_id, n.id, round(coalesce(s.score, 0) + 4 * coalesce(c.concepts, 0) + CASE WHEN list_contains(articles, article) THEN 12 ELSE 0 END, 6) AS score
        FROM st JOIN num n ON n.instrument = st.instrument LEFT JOIN scores s ON s.item_id = st.item_id AND s.id = n.id LEFT JOIN con c ON c.item_id = st.item_id AND c.id = n.id WHERE stopped IS NULL),
ord AS (SELECT *, row_number() OVER w AS rank, coalesce(lead(score) OVER w, 0) AS second, count(*) FILTER (WHERE score >= 2) OVER (PARTITION BY item_id) AS eligible FROM tot WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, id)),
top1 AS (SELECT item_id, score AS top_score, round(score - second, 6) AS margin, eligible FROM ord WHERE rank = 1),
dec AS (SELECT st.item_id, reason, instrument, stopped, top_score, margin, CASE WHEN stopped IS NOT NULL OR coalesce(eligible, 0) = 0 THEN 'abstained'
        WHEN eligible > 1 AND margin < 0.35 AND len(articles) = 0 THEN 'review' ELSE 'supported' END AS status FROM st LEFT JOIN top1 ON top1.item_id = st.item_id),
decided AS (SELECT d.item_id, reason, instrument, status, coalesce(stopped, CASE status WHEN 'abstained' THEN 'low_score' WHEN 'review' THEN 'low_ranking_margin' ELSE 'citation_supported' END) AS decision_reason,
        CASE WHEN stopped IS NULL THEN coalesce(top_score, 0) END AS top_score, CASE WHEN stopped IS NULL THEN coalesce(margin, 0) END AS margin, id, score, CAST(rank AS INT) AS rank
        FROM dec d LEFT JOIN ord o ON o.item_id = d.item_id AND o.rank <= 3 AND o.score >= 2 AND status <> 'abstained')"""


@query(f"WITH {_DECIDED_SQL} SELECT * FROM decided")
def retrieve_decisions(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.retrieve(_asked(spark, d), _corpus(spark, d), "item_id", "asked")


_JUDGED_SQL = f"""{_DECIDED_SQL},
fd AS (SELECT item_id, any_value(status) AS status, list(id ORDER BY rank) FILTER (WHERE id IS NOT NULL) AS ids FROM decided GROUP BY 1),
ju AS (SELECT e.*, status, coalesce(ids, []) AS ids FROM eval_items e JOIN fd ON fd.item_id = e.item_id),
jd AS (SELECT item_id, case_type, status, case_type IN ('positive', 'distractor') AS retrieval, len(list_intersect(expected_ids, ids)) AS good,
        list_min(list_transform(list_filter(range(1, len(ids) + 1), lambda i: list_contains(expected_ids, ids[i])), lambda i: i)) AS first,
        CASE WHEN case_type = 'distractor' THEN len(ids) = 0 OR NOT list_contains(forbidden_ids, ids[1]) END AS rejected, len(expected_ids) AS wanted,
        CASE WHEN expected_instrument IS NOT NULL THEN len(list_filter(ids, lambda i: split_part(i, '-', 1) <> expected_instrument)) > 0 END AS leaking,
        len(ids) AS results, status = expected_status AS matches FROM ju),
ev AS (SELECT count(*) AS cases, count(*) FILTER (WHERE case_type = 'positive') AS positive, count(*) FILTER (WHERE case_type = 'negative') AS negative, count(*) FILTER (WHERE case_type = 'distractor') AS distractor,
    coalesce(round_even(avg(CASE WHEN retrieval THEN CAST(good > 0 AS INT) END), 4), 0) AS hit_rate, coalesce(round_even(avg(CASE WHEN retrieval THEN coalesce(good / nullif(wanted, 0), 0) END), 4), 0) AS recall,
    coalesce(round_even(avg(CASE WHEN retrieval THEN coalesce(1 / first, 0) END), 4), 0) AS mrr, coalesce(round_even(avg(CASE WHEN case_type = 'positive' THEN CAST(status <> 'abstained' AS INT) END), 4), 0) AS positive_coverage,
    coalesce(round_even(avg(CASE WHEN case_type = 'negative' THEN CAST(status = 'abstained' AS INT) END), 4), 0) AS negative_abstention, coalesce(round_even(avg(CASE WHEN case_type = 'negative' THEN CAST(status <> 'abstained' AS INT) END), 4), 0) AS false_support,
    coalesce(round_even(avg(CAST(rejected AS INT)), 4), 0) AS distractor_rejection, coalesce(round_even(avg(CAST(leaking AS INT)), 4), 0) AS instrument_leakage,
    CASE WHEN sum(results) > 0 THEN 1.0 ELSE 0.0 END AS trace_coverage, round_even(avg(CAST(coalesce(matches, false) AS INT)), 4) AS status_match FROM jd)"""


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.judged_cases(retrieve_decisions(spark, d), _items(spark, d), _corpus(spark, d), "item_id")


@query(f"WITH {_JUDGED_SQL} SELECT * FROM ev")
def retrieval_evaluation(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.evaluation(_judged(spark, d))


@query(f"""WITH {_JUDGED_SQL}, u AS (UNPIVOT (SELECT recall, negative_abstention, distractor_rejection, status_match, false_support, instrument_leakage FROM ev) ON COLUMNS(*) INTO NAME rate VALUE observed)
SELECT rate, bound, CAST("limit" AS DOUBLE) AS "limit", observed, CASE WHEN bound = 'least' THEN observed >= "limit" ELSE observed <= "limit" END AS passed
FROM u JOIN (VALUES ('recall', 'least', 0.75), ('negative_abstention', 'least', 0.75), ('distractor_rejection', 'least', 0.75), ('status_match', 'least', 1.0), ('false_support', 'greatest', 0.25), ('instrument_leakage', 'greatest', 0.0)) z(r, bound, "limit") ON r = rate""")
def evaluation_acceptance(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.acceptance(retrieval.evaluation(_judged(spark, d)))


def _term_scores(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.term_scores(_items(spark, d), retrieval.entry_fields(_corpus(spark, d)), "item_id", "query")


@query(f"WITH {_SCORES_SQL} SELECT item_id, ts.id, field, round(sum(ts * part / wtf), 6) AS contribution FROM ts JOIN pt ON pt.id = ts.id AND pt.channel = ts.channel AND pt.term = ts.term GROUP BY ALL")
def field_contributions(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.field_contributions(_term_scores(spark, d), "item_id")


@query(f"WITH {_SCORES_SQL} SELECT item_id, id, row_number() OVER (PARTITION BY item_id, id ORDER BY round(ts, 6) DESC, channel, term) AS place, channel, term, round(ts, 6) AS score FROM ts")
def term_trace(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.term_trace(_term_scores(spark, d), "item_id")
