"""Sums with trace rows, reconciliation, tolerance replay, sweeps and contracts over plain relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inventory(df: DataFrame, item: str, component: str, amount: Column) -> DataFrame:
    """item, component, amount at three levels (null: summed over), by one rollup with exact decimals."""
    rows = df.select(item, component, amount.cast("decimal(24,4)").alias("amount"))
    return rows.rollup(item, component).agg(F.sum("amount").alias("amount"), F.grouping_id().alias("level"))


def axes(df: DataFrame, axis_names: list[str], amount: Column) -> DataFrame:
    """axis, part, amount: the same rows summed along independent axes, and in all, in one pass."""
    names = F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("part")) for a in axis_names), F.struct(F.lit("all").alias("axis"), F.lit("all").alias("part")))
    rows = df.groupBy(*axis_names).agg(F.sum(amount.cast("decimal(24,4)")).alias("amount"))  # few rows before they are spread
    return rows.select(F.explode(names).alias("a"), "amount").groupBy("a.axis", "a.part").agg(F.sum("amount").alias("amount"))


def reconciled(axis_rows: DataFrame) -> DataFrame:
    """axis, total, agrees: whether the parts of each axis add up to the whole, exactly."""
    totals = axis_rows.groupBy("axis").agg(F.sum("amount").alias("total"))
    whole = totals.filter("axis = 'all'").select(F.col("total").alias("whole"))
    return totals.filter("axis <> 'all'").crossJoin(F.broadcast(whole)).select("axis", F.col("total").cast("double").alias("total"), (F.col("total") == F.col("whole")).alias("agrees"))


def weighted_mean(value: str, weight: str) -> Column:
    product = F.col(value).cast("decimal(20,4)") * F.col(weight).cast("decimal(10,4)")
    return F.round(F.sum(product).cast("double") / F.nullif(F.sum(F.col(weight).cast("decimal(10,4)")).cast("double"), F.lit(0.0)), 6)


def trace_steps(levels: DataFrame, item: str, component: str) -> DataFrame:
    """step_id, parent_id, amount: inventory levels as nodes of a calculation graph, each derived into the level above."""
    name = lambda *xs: F.concat_ws("/", F.lit("sum"), *xs)
    step = F.when(F.col("level") == 0, name(F.col(item), F.col(component))).when(F.col("level") == 1, name(F.col(item))).otherwise(name())
    parent = F.when(F.col("level") == 0, name(F.col(item))).when(F.col("level") == 1, name())
    return levels.select(step.alias("step_id"), parent.alias("parent_id"), "amount", "level")


def trace_check(steps: DataFrame) -> DataFrame:
    """steps, edges, dangling (edges to no step) and wrong_sums (parents that are not the sum of their children)."""
    sums = steps.filter("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("step_id")).agg(F.sum("amount").alias("below"), F.count("*").alias("edges"))
    joined = steps.join(sums, "step_id", "full")
    return joined.agg(
        F.count("level").alias("steps"), F.sum(F.coalesce("edges", F.lit(0))).alias("edges"),
        F.sum(F.when(F.col("level").isNull(), F.col("edges")).otherwise(0)).alias("dangling"),
        F.count_if(F.col("level").isNotNull() & F.col("below").isNotNull() & (F.col("below") != F.col("amount"))).alias("wrong_sums"),
    )


def sweep(df: DataFrame, score: Column, actual: Column, thresholds: list[float]) -> DataFrame:
    """threshold, f1, iou of the best threshold: greatest f1, then iou, then nearest to the middle, then the least.

    Scores are counted per step between thresholds first, so that rows are not multiplied by thresholds.
    """
    steps = F.aggregate(F.array(*(F.lit(t) for t in thresholds)), F.lit(0), lambda n, t: n + (score >= t).cast("int"))
    counts = df.select(steps.alias("step"), actual.alias("actual")).groupBy("step").agg(F.count_if("actual").alias("pos"), F.count_if(~F.col("actual")).alias("neg"))
    limits = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(thresholds, 1))))
    grid = counts.select("*", limits.alias("l"))
    hit = F.col("step") >= F.col("l.i")
    table = grid.groupBy("l.threshold").agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"), F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    f1 = F.coalesce(F.bround(F.try_divide(2 * tp, 2 * tp + fp + fn), 6), F.lit(0.0))
    iou = F.coalesce(F.bround(F.try_divide(tp, tp + fp + fn), 6), F.lit(0.0))
    scored = table.select("threshold", f1.alias("f1"), iou.alias("iou"))
    order = F.struct("f1", "iou", F.round(-F.abs(F.col("threshold") - 0.5), 6), -F.col("threshold"))
    return scored.agg(F.max_by(F.struct("threshold", "f1", "iou"), order).alias("r")).select("r.*")


def replay(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """rows, unpaired, largest and mean absolute difference of two keyed numeric relations, and whether all is within tolerance."""
    joined = a.select(*keys, F.col(value).alias("x")).join(b.select(*keys, F.col(value).alias("y")), keys, "full")
    gap = F.abs(F.col("x") - F.col("y"))
    return joined.agg(
        F.count("*").alias("rows"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("unpaired"),
        F.round(F.max(gap), 6).alias("largest"), F.round(F.avg(gap), 6).alias("mean"),
        (F.bool_and(F.coalesce(gap <= tolerance, F.lit(False)))).alias("within"),
    )


def replay_arrays(a: DataFrame, b: DataFrame, keys: list[str], values: str, tolerance: float) -> DataFrame:
    """replay of keyed arrays of numbers, element by element: one row per key is joined, not one per element."""
    x, y = F.col("#x"), F.col("#y")
    joined = a.select(*keys, F.col(values).alias("#x")).join(b.select(*keys, F.col(values).alias("#y")), keys, "full")
    gaps = F.zip_with(F.coalesce(x, F.array().cast("array<double>")), F.coalesce(y, F.array().cast("array<double>")), lambda p, q: F.abs(p - q))
    per = joined.select(gaps.alias("g")).select(
        F.size("g").alias("n"), F.size(F.filter("g", lambda v: v.isNull())).alias("unpaired"), F.array_max("g").alias("largest"),
        F.aggregate("g", F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0))).alias("sum"), F.forall("g", lambda v: F.coalesce(v <= tolerance, F.lit(False))).alias("within"),
    )
    return per.agg(
        F.sum("n").alias("rows"), F.sum("unpaired").alias("unpaired"), F.round(F.max("largest"), 6).alias("largest"),
        F.round(F.try_divide(F.sum("sum"), F.sum(F.col("n") - F.col("unpaired"))), 6).alias("mean"), F.bool_and("within").alias("within"),
    )


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, violations: all rules counted in one pass; a rule that is null for a row is violated."""
    counts = df.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()))
    return counts.unpivot([], list(rules), "rule", "violations")


def closed_keys(json: Column, allowed: list[str]) -> Column:
    """Whether a JSON object has exactly the allowed keys; null text or no object counts as false."""
    keys = F.json_object_keys(json)
    names = F.array(*(F.lit(a) for a in allowed))
    return F.coalesce((F.size(F.array_except(keys, names)) == 0) & (F.size(F.array_except(names, keys)) == 0), F.lit(False))
