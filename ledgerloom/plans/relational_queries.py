"""Relational operators on the star schema, events, embeddings and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import relations
from ledgerloom.plans.registry import Registry
from ledgerloom.session import small, table
from ledgerloom.sources import manifests

registry = Registry()
query = registry.query

_AMOUNT = "CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(24,4))"
_INVENTORY_SQL = f"""r AS (SELECT p_brand, l_returnflag, {_AMOUNT} AS amount FROM lineitem JOIN part ON p_partkey = l_partkey),
inv AS (SELECT p_brand, l_returnflag, sum(amount) AS amount, GROUPING(p_brand, l_returnflag) AS level FROM r GROUP BY ROLLUP (p_brand, l_returnflag))"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return table(spark, d, "lineitem").join(parts, "l_partkey")


def _amount():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return relations.inventory(_items(spark, d), "p_brand", "l_returnflag", _amount())


@query(f"WITH {_INVENTORY_SQL} SELECT p_brand, l_returnflag, CAST(amount AS DOUBLE) AS amount, CAST(level AS BIGINT) AS level FROM inv")
def component_inventory(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).withColumn("amount", F.col("amount").cast("double"))


@query(f"""WITH a AS (SELECT l_returnflag, l_linestatus, GROUPING(l_returnflag, l_linestatus) AS g, sum({_AMOUNT}) AS amount FROM lineitem
    GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())),
t AS (SELECT 'l_returnflag' AS axis, sum(amount) AS total FROM a WHERE g = 1 UNION ALL SELECT 'l_linestatus', sum(amount) FROM a WHERE g = 2)
SELECT axis, CAST(total AS DOUBLE) AS total, total = (SELECT amount FROM a WHERE g = 3) AS agrees FROM t""")
def axis_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return relations.reconciled(relations.axes(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], _amount()))


@query("""SELECT p_brand, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(20,4)) * CAST(l_quantity AS DECIMAL(10,4))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(10,4))) AS DOUBLE), 6) AS intensity
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def weighted_intensity(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).groupBy("p_brand").agg(relations.weighted_mean("l_extendedprice", "l_quantity").alias("intensity"))


# A stored calculation as it might have been damaged: sums of one flag of some brands are off by 1, other brands' steps are gone.
_OFF, _GONE = "level = 0 AND l_returnflag = 'A' AND p_brand LIKE '%3'", "level = 1 AND p_brand LIKE '%5'"


@query(f"""WITH {_INVENTORY_SQL}, s AS (
    SELECT CASE level WHEN 0 THEN 'sum/' || p_brand || '/' || l_returnflag WHEN 1 THEN 'sum/' || p_brand ELSE 'sum' END AS id, CASE level WHEN 0 THEN 'sum/' || p_brand WHEN 1 THEN 'sum' END AS up,
           CASE WHEN {_OFF} THEN amount + 1 ELSE amount END AS amount FROM inv WHERE NOT coalesce({_GONE}, false)),
b AS (SELECT up, sum(amount) AS below, count(*) AS n FROM s WHERE up IS NOT NULL GROUP BY 1)
SELECT count(s.id) AS steps, CAST(coalesce(sum(n), 0) AS BIGINT) AS edges, CAST(coalesce(sum(n) FILTER (WHERE s.id IS NULL), 0) AS BIGINT) AS dangling,
    count(*) FILTER (WHERE s.id IS NOT NULL AND below <> amount) AS wrong_sums FROM s FULL JOIN b ON b.up = s.id""")
def trace_topology(spark: SparkSession, d: str) -> DataFrame:
    """What the check finds in a calculation graph that was damaged after it had been stored."""
    levels = _levels(spark, d).filter(f"NOT coalesce({_GONE}, false)").withColumn("amount", F.expr(f"CASE WHEN {_OFF} THEN amount + 1 ELSE amount END"))
    return relations.trace_check(relations.trace_steps(levels, "p_brand", "l_returnflag"))


@query(f"""WITH a AS (SELECT p_brand, sum({_AMOUNT}) AS actual, sum(CAST(p_retailprice * l_quantity AS DECIMAL(24,4))) AS standard FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT p_brand, CAST(actual AS DOUBLE) AS actual, CAST(standard AS DOUBLE) AS standard, CAST(actual - standard AS DOUBLE) AS difference FROM a""")
def default_comparison(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_retailprice")
    exact = lambda c: F.sum(c.cast("decimal(24,4)"))
    rows = table(spark, d, "lineitem").join(parts, "l_partkey").groupBy("p_brand").agg(exact(_amount()).alias("a"), exact(F.col("p_retailprice") * F.col("l_quantity")).alias("s"))
    return rows.select("p_brand", F.col("a").cast("double").alias("actual"), F.col("s").cast("double").alias("standard"), (F.col("a") - F.col("s")).cast("double").alias("difference"))


_STEPS = [round(0.2 + 0.05 * i, 2) for i in range(13)]


@query(f"""WITH t AS (SELECT unnest({_STEPS}) AS threshold), c AS (
    SELECT threshold, count(*) FILTER (WHERE s >= threshold AND a) AS tp, count(*) FILTER (WHERE s >= threshold AND NOT a) AS fp, count(*) FILTER (WHERE s < threshold AND a) AS fn
    FROM t, (SELECT l_quantity / 50 AS s, l_returnflag = 'R' AS a FROM lineitem) x GROUP BY 1),
m AS (SELECT threshold, coalesce(round_even(2 * tp / nullif(2 * tp + fp + fn, 0), 6), 0) AS f1, coalesce(round_even(tp / nullif(tp + fp + fn, 0), 6), 0) AS iou FROM c)
SELECT CAST(threshold AS DOUBLE) AS threshold, f1, iou FROM m ORDER BY f1 DESC, iou DESC, round(abs(threshold - 0.5), 6), threshold LIMIT 1""")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return relations.sweep(table(spark, d, "lineitem"), F.col("l_quantity") / 50, F.col("l_returnflag") == "R", _STEPS)


_DIM_SQL = "e AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS dim FROM embeddings)"


def _dims(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "x"))


@query(f"WITH {_DIM_SQL} SELECT CAST(dim AS INT) AS dim, round(avg(CAST(x AS DOUBLE)), 6) AS mean, round(greatest(stddev_samp(CAST(x AS DOUBLE)), 1e-6), 6) AS deviation FROM e GROUP BY 1")
def channel_norm(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x").cast("double")
    return _dims(spark, d).groupBy("dim").agg(F.round(F.avg(x), 6).alias("mean"), F.round(F.greatest(F.stddev_samp(x), F.lit(1e-6)), 6).alias("deviation"))


@query(f"WITH {_DIM_SQL} SELECT vec_id, CAST(dim // 8 AS INT) AS block, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM e GROUP BY 1, 2")
def block_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").withColumn("block", F.explode(F.sequence(F.lit(0), F.expr("(size(embedding) - 1) div 8").cast("int"))))
    part = F.slice("embedding", F.col("block") * 8 + 1, F.lit(8))
    mean = F.aggregate(part, F.lit(0.0), lambda s, x: s + x.cast("double"), lambda s: s / F.size(part))
    return rows.select("vec_id", "block", F.round(mean, 6).alias("mean"))


@query(f"""WITH {_DIM_SQL}, p AS (SELECT a.vec_id, CAST(a.x AS DOUBLE) AS x, CAST(b.x AS DOUBLE) AS y, t FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 AND b.dim = a.dim, unnest(range(8)) AS s(t))
SELECT vec_id, CAST(t AS INT) AS step, round(sqrt(sum((x + (y - x) * t / 7) ** 2)), 5) AS norm FROM p GROUP BY 1, 2""")
def lerp_path(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    steps = rows.join(after, "vec_id").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(7))))
    mixed = F.zip_with("embedding", "next", lambda a, b: a.cast("double") + (b.cast("double") - a.cast("double")) * F.col("step") / 7)
    norm = F.sqrt(F.aggregate(mixed, F.lit(0.0), lambda s, v: s + v * v))
    return steps.select("vec_id", "step", F.round(norm, 5).alias("norm"))


# A replay as it might have gone wrong: some vectors are missing, one value of others is off.
@query(f"""WITH {_DIM_SQL}, g AS (SELECT CAST(x AS DOUBLE) AS x, CASE WHEN vec_id % 101 = 3 THEN NULL WHEN vec_id % 50 = 7 AND dim = 5 THEN round(CAST(x AS DOUBLE), 3) + 0.25 ELSE round(CAST(x AS DOUBLE), 3) END AS y FROM e)
SELECT count(*) AS rows, count(*) FILTER (WHERE y IS NULL) AS unpaired, round(max(abs(x - y)), 6) AS largest, round(avg(abs(x - y)), 6) AS mean, bool_and(coalesce(abs(x - y) <= 0.001, false)) AS within FROM g""")
def replay_tolerance(spark: SparkSession, d: str) -> DataFrame:
    """What comparing embeddings with a damaged replay of them finds; arrays are compared within their row."""
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    off = lambda x, i: F.round(x, 3) + F.when((F.col("vec_id") % 50 == 7) & (i == 5), 0.25).otherwise(0.0)
    replayed = rows.filter("vec_id % 101 <> 3").select("vec_id", F.transform("x", off).alias("x"))
    return relations.replay_arrays(rows, replayed, ["vec_id"], "x", 0.001)


@query("""SELECT DISTINCT a.source FROM documents a WHERE a.source IS NOT NULL AND ascii(right(sha256(coalesce(a.case_id, '')), 1)) % 4 = 0
INTERSECT SELECT DISTINCT source FROM documents WHERE ascii(right(sha256(coalesce(case_id, '')), 1)) % 4 <> 0""")
def scene_leakage(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("source", (F.ascii(F.right(F.sha2(F.coalesce("case_id", F.lit("")), 256), F.lit(1))) % 4 == 0).alias("held"))
    return rows.filter("held AND source IS NOT NULL").select("source").intersect(rows.filter("NOT held").select("source"))


@query("""SELECT event_type, count(*) AS events, count(try_cast(json_extract_string(props, '$.k') AS BIGINT)) AS valid, CAST(sum(try_cast(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total,
    count(*) FILTER (WHERE list_sort(json_keys(props)) = ['k']) AS closed FROM events GROUP BY 1""")
def strict_json_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    rows = table(spark, d, "events").select("event_type", k.alias("k"), relations.closed_keys(F.col("props"), ["k"]).alias("closed"))
    return rows.groupBy("event_type").agg(F.count("*").alias("events"), F.count("k").alias("valid"), F.sum("k").alias("total"), F.count_if("closed").alias("closed"))


@query("""SELECT 'confidence' AS rule, count(*) FILTER (WHERE NOT coalesce(confidence BETWEEN 0 AND 1 AND NOT isnan(confidence), false)) AS violations FROM candidates
UNION ALL SELECT 'page', count(*) FILTER (WHERE NOT coalesce(page >= 1, false)) FROM candidates
UNION ALL SELECT 'label', count(*) FILTER (WHERE NOT coalesce(trim(raw_label) <> '', false)) FROM candidates
UNION ALL SELECT 'line_hash', count(*) FILTER (WHERE NOT coalesce(regexp_full_match(line_sha256, '[0-9a-f]{64}'), false)) FROM candidates
UNION ALL SELECT 'span', count(*) FILTER (WHERE NOT coalesce(source_span.alias_start <= source_span.alias_end AND source_span.alias_end <= source_span.value_start AND source_span.value_start <= source_span.value_end, false)) FROM candidates
UNION ALL SELECT 'line_text', count(*) FILTER (WHERE NOT coalesce(sha256(raw_line) = line_sha256, false)) FROM candidates
UNION ALL SELECT 'value_text', count(*) FILTER (WHERE NOT coalesce(substr(raw_line, source_span.value_start + 1, source_span.value_end - source_span.value_start) = raw_value, false)) FROM candidates""")
def contract_violations(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("source_span")
    value = F.substring("raw_line", s["value_start"] + 1, s["value_end"] - s["value_start"])
    rules = {
        "confidence": F.col("confidence").between(0, 1) & ~F.isnan("confidence"), "page": F.col("page") >= 1, "label": F.trim("raw_label") != "",
        "line_hash": F.col("line_sha256").rlike("^[0-9a-f]{64}$"),
        "span": (s["alias_start"] <= s["alias_end"]) & (s["alias_end"] <= s["value_start"]) & (s["value_start"] <= s["value_end"]),
        "line_text": F.sha2("raw_line", 256) == F.col("line_sha256"), "value_text": value == F.col("raw_value"),
    }
    return relations.violations(table(spark, d, "candidates"), rules)


@query("""SELECT r_name, n_name, count(s_suppkey) AS suppliers FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2""")
def source_binding(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").join(small(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    counts = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return nations.join(counts, "n_nationkey", "left").select("r_name", "n_name", F.coalesce("n", F.lit(0)).alias("suppliers"))


@query("""WITH d AS (SELECT unnest(['F', 'O', 'P', 'X']) AS status), c AS (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1)
SELECT coalesce(d.status, c.status) AS status, coalesce(n, 0) AS n, d.status IS NOT NULL AS declared FROM d FULL JOIN c ON c.status = d.status""")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    declared = spark.createDataFrame([(s, True) for s in "FOPX"], "status string, declared boolean")
    counts = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return counts.join(declared, "status", "full").select("status", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("declared", F.lit(False)).alias("declared"))


@query("SELECT file_name, regexp_replace(file_name, '_[^_]*_[^_]*$', '') AS scene, count(*) AS records FROM scene_lines GROUP BY 1")
def scene_id_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scene_lines").groupBy("file_name").agg(F.count("*").alias("records")).select("file_name", F.regexp_replace("file_name", "_[^_]*_[^_]*$", "").alias("scene"), "records")


@query()
def byte_manifest(spark: SparkSession, d: str) -> DataFrame:
    """file, bytes, sha256 of the files of all tables."""
    return manifests.byte_manifest(spark, [d])
