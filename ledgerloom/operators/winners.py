"""Winner selection with a full ledger: ranks, conflicts, required fields and re-derivation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import BROADCAST_ROWS, materialise, small


def latest_delivery(df: DataFrame, key: str, delivered: str) -> DataFrame:
    """One row per key: the last delivered, by aggregation, so that many copies of one key shuffle as one row."""
    row = F.struct(*df.columns)
    return df.groupBy(key).agg(F.max_by(row, F.col(delivered)).alias("r")).select("r.*")


def fallback_rank(df: DataFrame, authority: DataFrame, field: str, kind: str, default: int) -> DataFrame:
    """df with rank from (field, type), else from (any field, type), else default: two joins against small tables."""
    own = authority.filter("field IS NOT NULL AND document_type IS NOT NULL").select(
        F.col("field").alias("#f"), F.col("document_type").alias("#t"), F.col("authority_rank").alias("#own")
    )
    general = authority.filter("field IS NULL AND document_type IS NOT NULL").select(
        F.col("document_type").alias("#g"), F.col("authority_rank").alias("#general")
    )
    joined = df.join(small(own), (F.col(field) == F.col("#f")) & (F.col(kind) == F.col("#t")), "left").join(
        small(general), F.col(kind) == F.col("#g"), "left"
    )
    return joined.withColumn("rank", F.coalesce("#own", "#general", F.lit(default))).drop("#f", "#t", "#own", "#g", "#general")


#: Rows of the largest group that one task sorts by itself; larger groups are spread over tasks by range.
GROUP_ROWS = 1_000_000


def ranked(df: DataFrame, group: list[str], order: list[Column], group_rows: int = GROUP_ROWS) -> DataFrame:
    """Every row with its position in its group, whether it is selected, and the number of candidates.

    order must tell the rows of a group apart. Where a group has more than group_rows rows (pre-aggregated counts tell),
    rows are placed by range of group and order, so that a hot group spreads over many tasks; a row's position is then
    that within its part and the rows of the parts before. Both ways give the same rows.
    """
    largest = df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    whole = Window.partitionBy(*group)
    if largest <= group_rows:
        placed = df.withColumns({"position": F.row_number().over(whole.orderBy(*order)), "candidates": F.count(F.lit(1)).over(whole)})
        return placed.withColumn("selected", F.col("position") == 1)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(df.repartitionByRange(parts, *group, *order).withColumn("#part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("#part", *group).agg(F.count("*").alias("#n"))
    before = whole.orderBy("#part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part of a group
    offsets = sizes.select(
        F.col("#part").alias("#p"), *(F.col(g).alias(f"#{g}") for g in group), F.coalesce(F.sum("#n").over(before), F.lit(0)).alias("#before"), F.sum("#n").over(whole).alias("candidates")
    )
    same = [F.col("#part") == F.col("#p"), *(F.col(g).eqNullSafe(F.col(f"#{g}")) for g in group)]
    inner = ranged.withColumn("#k", F.row_number().over(Window.partitionBy("#part", *group).orderBy(*order)))
    joined = inner.join(offsets, same).withColumn("position", (F.col("#k") + F.col("#before")).cast("int"))
    return joined.select(*df.columns, "position", "candidates", (F.col("position") == 1).alias("selected"))


def winners(df: DataFrame, group: list[str], order: Column, columns: list[str]) -> DataFrame:
    """The row of greatest order per group, by aggregation instead of a window: partial results before the shuffle."""
    return df.groupBy(*group).agg(F.max_by(F.struct(*columns), order).alias("r"), F.count("*").alias("candidates")).select(*group, "r.*", "candidates")


def alternatives(df: DataFrame, group: list[str], order: Column, key: str, value: str, tolerance: Column) -> DataFrame:
    """group, key, value, winner, difference, kind of every row whose value is another than the winner's.

    kind is equivalent for a numeric difference within tolerance, else material (also between texts that are no
    numbers). Winners are found by aggregation and joined back, so that a hot group is never sorted in one task. Groups
    whose winner has no value have no alternatives; rows without a value are none.
    """
    best = df.groupBy(*group).agg(F.max_by(value, order).alias("winner"))
    same = [F.col(g).eqNullSafe(F.col(f"#{g}")) for g in group]
    joined = df.join(best.select(*(F.col(g).alias(f"#{g}") for g in group), "winner"), same)
    number = lambda c: F.expr(f"try_cast(`{c}` AS DECIMAL(28,10))")
    difference = F.abs(number(value) - number("winner"))
    kind = F.when(F.coalesce(difference <= tolerance, F.lit(False)), "equivalent").otherwise("material")
    return joined.filter(F.col(value) != F.col("winner")).select(*group, key, value, "winner", difference.alias("difference"), kind.alias("kind"))


def conflicts(df: DataFrame, group: list[str], order: Column, key: str, value: str, tolerance: Column) -> DataFrame:
    """Per group: candidates, numbers of material and equivalent alternatives to the winning value, and the largest difference."""
    kinds = alternatives(df, group, order, key, value, tolerance).groupBy(*group).agg(
        F.count_if(F.col("kind") == "material").alias("m"), F.count_if(F.col("kind") == "equivalent").alias("e"), F.max("difference").cast("double").alias("largest_difference")
    )
    counts = df.groupBy(*group).agg(F.count("*").alias("candidates"))
    same = [F.col(g).eqNullSafe(F.col(f"#{g}")) for g in group]
    joined = counts.join(kinds.select(*(F.col(g).alias(f"#{g}") for g in group), "m", "e", "largest_difference"), same, "left")
    return joined.select(*group, "candidates", F.coalesce("m", F.lit(0)).alias("material"), F.coalesce("e", F.lit(0)).alias("equivalent"), "largest_difference")


def required_ledger(entities: DataFrame, required: DataFrame, present: DataFrame, entity: str, item: str) -> DataFrame:
    """entity, item, passed for every required item (a small list) of every entity."""
    names = sorted(r[0] for r in required.select(item).dropna().distinct().limit(BROADCAST_ROWS + 1).collect())
    if len(names) > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} required items")
    have = present.select(entity, item).distinct().withColumn("passed", F.lit(True))
    needed = entities.select(entity).distinct().withColumn(item, F.explode(F.array(*map(F.lit, names)).cast("array<string>")))
    return needed.join(have, [entity, item], "left").fillna(False, ["passed"])


def rederived(stored: DataFrame, source: DataFrame, group: list[str], order: list[Column], key: str, column: str) -> DataFrame:
    """group, key, stored, derived of every row whose stored position is not the one derived from source, or is on one side only."""
    again = ranked(source, group, order).select(*group, key, F.col("position").alias("derived"))
    joined = stored.select(*group, key, F.col(column).alias("stored")).join(again, [*group, key], "full")
    return joined.filter(~F.col("stored").eqNullSafe(F.col("derived")))
