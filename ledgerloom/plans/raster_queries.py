"""Raster operators on the good pixels of scene lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import raster, rejects, scene_contracts
from ledgerloom.plans.problems import SQL as _PROBLEM_SQL
from ledgerloom.plans.registry import Registry
from ledgerloom.session import small, table

registry = Registry()
query = registry.query

# An example transform, tile size, thresholds and held-out tiles.
TRANSFORM = ("300000", "10", "0", "4100000", "0", "-10")
TILE = (8, 16)
FOREST, LOSS = "0.45", "0.25"

_PIXELS_SQL = f"""raw AS ({_PROBLEM_SQL["p3_pixels"]}),
px AS (SELECT DISTINCT ON (s.scene_id, r.row, r.col) s.scene_id, r.* FROM raw r JOIN scene_lines s ON s.raw_id = r.raw_id ORDER BY s.scene_id, r.row, r.col, r.raw_id DESC),
v AS (SELECT *, list_filter([
        CASE WHEN red_before = -9999 OR nir_before = -9999 THEN 'nodata_before' END, CASE WHEN qa_before <> 'clear' THEN 'qa_before:' || qa_before END,
        CASE WHEN red_after = -9999 OR nir_after = -9999 THEN 'nodata_after' END, CASE WHEN qa_after <> 'clear' THEN 'qa_after:' || qa_after END], lambda x: x IS NOT NULL) AS reasons FROM px),
n AS (SELECT *, len(reasons) = 0 AS valid,
        CASE WHEN len(reasons) = 0 THEN (nir_before - red_before) / nullif(nir_before + red_before, 0) END AS before,
        CASE WHEN len(reasons) = 0 THEN (nir_after - red_after) / nullif(nir_after + red_after, 0) END AS after,
        'tile-r' || lpad(CAST((row // 8) * 8 AS VARCHAR), 4, '0') || '-c' || lpad(CAST((col // 16) * 16 AS VARCHAR), 4, '0') AS tile FROM v),
x AS (SELECT *, coalesce(CAST(nir_before AS DECIMAL(10,6)) - CAST(red_before AS DECIMAL(10,6)) >= 0.45 * (CAST(nir_before AS DECIMAL(10,6)) + CAST(red_before AS DECIMAL(10,6)))
        AND before - after >= 0.25, false) AND valid AS loss, valid AND (red_after > red_before) AS reference FROM n)"""


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    """The last good record of every cell, with mask reasons, index before and after, tile and flags."""
    lines = table(spark, d, "scene_lines")
    good = rejects.split_records(lines, keys=("raw_id", "scene_id")).filter("reason IS NULL AND row IS NOT NULL AND col IS NOT NULL").drop("reason")
    row = F.struct(*good.columns)
    once = good.groupBy("scene_id", "row", "col").agg(F.max_by(row, "raw_id").alias("r")).select("r.*")
    rows = once.withColumn("reasons", raster.mask_reasons(rejects.NODATA)).withColumn("valid", F.size("reasons") == 0)
    # The index is guarded by validity inside the expression: a masked pixel may have a zero denominator.
    for when in ("before", "after"):
        rows = rows.withColumn(when, F.when(F.col("valid"), raster.index(F.col(f"red_{when}"), F.col(f"nir_{when}"))))
    rows = rows.withColumn("tile", raster.tile_id(F.col("row"), F.col("col"), *TILE))
    flag = F.coalesce(raster.loss(F.col("before"), F.col("after"), FOREST, LOSS), F.lit(False))
    return rows.withColumns({"loss": flag & F.col("valid"), "reference": F.col("valid") & (F.col("red_after") > F.col("red_before"))})


@query(f"WITH {_PIXELS_SQL} SELECT scene_id, row, col, round(before + 1e-9, 6) AS before, round(after + 1e-9, 6) AS after FROM x WHERE valid AND before IS NOT NULL AND after IS NOT NULL")
def ndvi(spark: SparkSession, d: str) -> DataFrame:
    rows = _pixels(spark, d).filter("valid AND before IS NOT NULL AND after IS NOT NULL")
    nudged = lambda c: F.round(F.col(c).cast("double") + 1e-9, 6).alias(c)  # noqa: E731 - ties don't hang on the last bit
    return rows.select("scene_id", "row", "col", nudged("before"), nudged("after"))


@query(f"WITH {_PIXELS_SQL} SELECT scene_id, count(*) AS pixels, count(*) FILTER (WHERE valid) AS valid, count(*) FILTER (WHERE loss) AS loss FROM x GROUP BY 1")
def loss_flag(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d).groupBy("scene_id").agg(F.count("*").alias("pixels"), F.count_if("valid").alias("valid"), F.count_if("loss").alias("loss"))


@query(f"WITH {_PIXELS_SQL} SELECT scene_id, row, col, array_to_string(reasons, '|') AS reasons FROM x WHERE NOT valid")
def mask_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d).filter(~F.col("valid")).select("scene_id", "row", "col", F.concat_ws("|", "reasons").alias("reasons"))


@query(f"WITH {_PIXELS_SQL} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM x) y GROUP BY 1")
def mask_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"WITH {_PIXELS_SQL} SELECT scene_id, tile, count(*) AS pixels, count(*) FILTER (WHERE valid) AS valid FROM x GROUP BY 1, 2")
def tile_summary(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d).groupBy("scene_id", "tile").agg(F.count("*").alias("pixels"), F.count_if("valid").alias("valid"))


@query(f"""WITH {_PIXELS_SQL}, h AS (SELECT DISTINCT tile FROM x WHERE ascii(right(sha256(tile), 1)) % 4 = 0)
SELECT count(*) FILTER (WHERE h.tile IS NULL) AS train, count(*) FILTER (WHERE h.tile IS NOT NULL) AS holdout,
       count(*) FILTER (WHERE h.tile IS NOT NULL AND NOT valid) AS masked_holdout FROM x LEFT JOIN h ON h.tile = x.tile""")
def spatial_holdout_split(spark: SparkSession, d: str) -> DataFrame:
    held = F.ascii(F.right(F.sha2("tile", 256), F.lit(1))) % 4 == 0
    return _pixels(spark, d).agg(F.count_if(~held).alias("train"), F.count_if(held).alias("holdout"), F.count_if(held & ~F.col("valid")).alias("masked_holdout"))


_COUNTS = """count(*) FILTER (WHERE reference AND loss) AS tp, count(*) FILTER (WHERE NOT reference AND loss) AS fp,
count(*) FILTER (WHERE reference AND NOT loss) AS fn, count(*) FILTER (WHERE NOT reference AND NOT loss) AS tn"""


@query(f"WITH {_PIXELS_SQL} SELECT scene_id, {_COUNTS} FROM x WHERE valid GROUP BY 1")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d).filter("valid").groupBy("scene_id").agg(*raster.confusion(F.col("reference"), F.col("loss")))


@query(f"""WITH {_PIXELS_SQL}, c AS (SELECT scene_id, {_COUNTS} FROM x WHERE valid GROUP BY 1),
s AS (SELECT *, round_even(tp / nullif(tp + fp, 0), 6) AS precision, round_even(tp / nullif(tp + fn, 0), 6) AS recall,
        round_even(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round_even(tp / nullif(tp + fp + fn, 0), 6) AS iou FROM c)
SELECT *, concat_ws(',', CASE WHEN precision IS NULL THEN 'precision' END, CASE WHEN recall IS NULL THEN 'recall' END, CASE WHEN f1 IS NULL THEN 'f1' END, CASE WHEN iou IS NULL THEN 'iou' END) AS undefined FROM s""")
def binary_metrics(spark: SparkSession, d: str) -> DataFrame:
    return raster.mask_scores(confusion_matrix(spark, d))


@query(f"""WITH {_PIXELS_SQL}, b AS (SELECT scene_id, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM x GROUP BY 1),
g AS (SELECT scene_id, row, unnest(range(c0, c1 + 1)) AS col FROM (SELECT scene_id, c0, c1, unnest(range(r0, r1 + 1)) AS row FROM b) y)
SELECT scene_id, row, col FROM g WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.scene_id = g.scene_id AND x.row = g.row AND x.col = g.col)""")
def grid_completeness(spark: SparkSession, d: str) -> DataFrame:
    return raster.grid_gaps(_pixels(spark, d), "scene_id")


@query(f"""WITH {_PIXELS_SQL}, k AS (SELECT DISTINCT scene_id, row, col FROM x), b AS (SELECT scene_id, min(col) AS lo, max(col) AS hi FROM k GROUP BY 1),
r AS (SELECT k.*, lo, hi, lead(col) OVER w AS nx, lag(col) OVER w AS pv FROM k JOIN b ON b.scene_id = k.scene_id WINDOW w AS (PARTITION BY k.scene_id, row ORDER BY col)),
m AS (SELECT DISTINCT scene_id, row FROM k), q AS (SELECT *, lead(row) OVER (PARTITION BY scene_id ORDER BY row) AS nr FROM m)
SELECT scene_id, row, row AS row_end, lo AS col, col - 1 AS col_end FROM r WHERE pv IS NULL AND col > lo
UNION ALL SELECT scene_id, row, row, col + 1, coalesce(nx - 1, hi) FROM r WHERE col + 1 <= coalesce(nx - 1, hi)
UNION ALL SELECT q.scene_id, row + 1, nr - 1, lo, hi FROM q JOIN b ON b.scene_id = q.scene_id WHERE nr > row + 1""")
def grid_gap_runs(spark: SparkSession, d: str) -> DataFrame:
    return raster.gap_runs(_pixels(spark, d), "scene_id")


@query(f"""WITH RECURSIVE {_PIXELS_SQL}, c AS MATERIALIZED (SELECT scene_id, row, col FROM x WHERE loss),
t AS (SELECT scene_id, row, col, row AS r0, col AS c0 FROM c
      UNION SELECT n.scene_id, n.row, n.col, t.r0, t.c0 FROM t JOIN c n ON n.scene_id = t.scene_id AND abs(n.row - t.row) + abs(n.col - t.col) = 1),
m AS (SELECT scene_id, row, col, min(r0 * 2147483648 + c0) AS label FROM t GROUP BY 1, 2, 3)
SELECT scene_id, row, col, CAST(dense_rank() OVER (PARTITION BY scene_id ORDER BY label) AS INT) AS region FROM m""")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return raster.components(_pixels(spark, d).filter("loss"), "scene_id")


@query(f"""WITH RECURSIVE {_PIXELS_SQL}, c AS MATERIALIZED (SELECT scene_id, row, col FROM x WHERE loss),
t AS (SELECT scene_id, row, col, row AS r0, col AS c0 FROM c
      UNION SELECT n.scene_id, n.row, n.col, t.r0, t.c0 FROM t JOIN c n ON n.scene_id = t.scene_id AND abs(n.row - t.row) <= 1 AND abs(n.col - t.col) <= 1),
m AS (SELECT scene_id, row, col, min(r0 * 2147483648 + c0) AS label FROM t GROUP BY 1, 2, 3)
SELECT scene_id, CAST(dense_rank() OVER (PARTITION BY scene_id ORDER BY label) AS INT) AS region, count(*) AS cells, CAST(count(*) * 100 AS BIGINT) AS area FROM m GROUP BY scene_id, label""")
def region_sizes(spark: SparkSession, d: str) -> DataFrame:
    regions = raster.components(_pixels(spark, d).filter("loss"), "scene_id", 8)
    return regions.groupBy("scene_id", "region").agg(F.count("*").alias("cells"), (F.count("*") * 100).alias("area"))


@query(f"WITH {_PIXELS_SQL} SELECT scene_id, row, col, CAST(300000 + col * 10 AS DOUBLE) AS x, CAST(4100000 - row * 10 AS DOUBLE) AS y, CAST(300000 + (col + 1) * 10 AS DOUBLE) AS x_max, CAST(4100000 - (row + 1) * 10 AS DOUBLE) AS y_min FROM x")
def affine_coords(spark: SparkSession, d: str) -> DataFrame:
    points = raster.corners(F.col("row"), F.col("col"), TRANSFORM)
    xs, ys = [p[0].cast("double") for p in points], [p[1].cast("double") for p in points]
    return _pixels(spark, d).select("scene_id", "row", "col", F.least(*xs).alias("x"), F.greatest(*ys).alias("y"), F.greatest(*xs).alias("x_max"), F.least(*ys).alias("y_min"))


@query(f"""WITH {_PIXELS_SQL} SELECT scene_id, row, col, array_to_string([x0 || ' ' || y0, x0 || ' ' || y1, x1 || ' ' || y1, x1 || ' ' || y0, x0 || ' ' || y0], ',') AS ring
FROM (SELECT scene_id, row, col, 300000 + col * 10 AS x0, 300010 + col * 10 AS x1, 4100000 - row * 10 AS y0, 4099990 - row * 10 AS y1 FROM x WHERE loss) p""")
def pixel_polygon(spark: SparkSession, d: str) -> DataFrame:
    shape = raster.ring(raster.corners(F.col("row"), F.col("col"), TRANSFORM))
    flat = F.array_join(F.transform(shape, lambda p: F.concat_ws(" ", p[0].cast("long").cast("string"), p[1].cast("long").cast("string"))), ",")
    return _pixels(spark, d).filter("loss").select("scene_id", "row", "col", flat.alias("ring"))


@query(f"WITH {_PIXELS_SQL} SELECT count(*) AS pixels, count(*) FILTER (WHERE loss) AS loss, round_even(count(*) FILTER (WHERE loss) / count(*), 4) AS loss_share, CAST(100 * count(*) FILTER (WHERE loss) AS BIGINT) AS area, round(avg(before), 4) AS mean_before, round(avg(after), 4) AS mean_after FROM x WHERE valid")
def forest_summary(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d).filter("valid").agg(
        F.count("*").alias("pixels"), F.count_if("loss").alias("loss"), F.bround(F.count_if("loss") / F.count("*"), 4).alias("loss_share"),
        (F.count_if("loss") * 100).alias("area"), F.round(F.avg(F.col("before").cast("double")), 4).alias("mean_before"), F.round(F.avg(F.col("after").cast("double")), 4).alias("mean_after"),
    )


@query("""SELECT scene_id, CAST(epoch(acquired_after) - epoch(acquired_before) AS BIGINT) AS elapsed, CAST(least(g, 366 - g) AS INT) AS day_gap, season_label IS NOT NULL AND least(g, 366 - g) <= 30 AS comparable
FROM (SELECT *, abs(date_diff('day', make_date(2000, month(acquired_before), day(acquired_before)), make_date(2000, month(acquired_after), day(acquired_after)))) AS g FROM scenes) x""")
def seasonal_pair(spark: SparkSession, d: str) -> DataFrame:
    gap = raster.day_gap(F.col("acquired_before"), F.col("acquired_after"))
    seconds = F.expr("unix_timestamp(cast(acquired_after as timestamp)) - unix_timestamp(cast(acquired_before as timestamp))")
    return table(spark, d, "scenes").select("scene_id", seconds.alias("elapsed"), gap.alias("day_gap"), (F.col("season_label").isNotNull() & (gap <= 30)).alias("comparable"))


@query(f"WITH {_PIXELS_SQL} (SELECT scene_id, row, col, 'both' AS part FROM x WHERE loss INTERSECT SELECT scene_id, row, col, 'both' FROM x WHERE reference) UNION ALL (SELECT scene_id, row, col, 'only_predicted' FROM x WHERE loss EXCEPT SELECT scene_id, row, col, 'only_predicted' FROM x WHERE reference)")
def set_difference_masks(spark: SparkSession, d: str) -> DataFrame:
    part = F.when(F.col("reference"), "both").otherwise("only_predicted")
    return _pixels(spark, d).filter("loss").select("scene_id", "row", "col", part.alias("part"))  # both flags stand in one row


@query(f"""WITH {_PIXELS_SQL} SELECT s.crs, count(*) AS pixels, count(*) FILTER (WHERE valid) AS valid FROM x JOIN scenes s ON s.scene_id = x.scene_id GROUP BY 1""")
def scene_binding(spark: SparkSession, d: str) -> DataFrame:
    scenes = table(spark, d, "scenes").select("scene_id", "crs")
    return _pixels(spark, d).join(small(scenes), "scene_id").groupBy("crs").agg(F.count("*").alias("pixels"), F.count_if("valid").alias("valid"))


@query()
def geojson_features(spark: SparkSession, d: str) -> DataFrame:
    """One GeoJSON feature per cell of loss."""
    shape = raster.ring(raster.corners(F.col("row"), F.col("col"), TRANSFORM))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(shape).alias("coordinates"))
    properties = F.struct("row", "col", F.round(F.col("before").cast("double"), 6).alias("before"), F.round(F.col("after").cast("double"), 6).alias("after"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))
    return _pixels(spark, d).filter("loss").select("scene_id", F.to_json(feature).alias("feature"))


# A declared grid for contracts, and where its upper left corner lies, in degrees.
GRID = (64, 64)
ORIGIN, CELL = ("127.5", "36.5"), ("0.0001", "0.0001")
_SECONDS = "(epoch(acquired_after) - epoch(acquired_before))"
_GAP = "abs(date_diff('day', make_date(2000, month(acquired_before), day(acquired_before)), make_date(2000, month(acquired_after), day(acquired_after))))"


@query(f"""SELECT scene_id, unnest(list_filter([
    CASE WHEN NOT coalesce(regexp_full_match(crs, 'EPSG:[0-9]{{4,5}}'), false) THEN 'crs_malformed' END, CASE WHEN try_cast(nodata AS DECIMAL(20,6)) IS NULL THEN 'nodata_no_number' END,
    CASE WHEN try_cast(nodata AS DECIMAL(20,6)) BETWEEN 0 AND 1 THEN 'nodata_within_range' END, CASE WHEN season_label IS NULL THEN 'label_missing' END,
    CASE WHEN acquired_before IS NULL OR acquired_after IS NULL THEN 'time_missing' END, CASE WHEN {_SECONDS} <= 0 THEN 'times_out_of_order' END,
    CASE WHEN least({_GAP}, 366 - {_GAP}) > 30 THEN 'day_gap_too_wide' END, CASE WHEN {_SECONDS} > 0 AND NOT {_SECONDS} BETWEEN 86400 AND 400 * 86400 THEN 'elapsed_out_of_window' END], lambda x: x IS NOT NULL)) AS error FROM scenes""")
def scene_contract(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "scenes").withColumns({"label_before": F.col("season_label"), "label_after": F.col("season_label")})
    return scene_contracts.scene_errors(rows, "scene_id", scene_contracts.Season(30, 1, 400))


@query(f"""WITH {_PIXELS_SQL.split("v AS")[0].rstrip().rstrip(",")}, a AS (SELECT s.scene_id, r.* FROM raw r JOIN scene_lines s ON s.raw_id = r.raw_id WHERE r.row IS NOT NULL AND r.col IS NOT NULL),
e AS (SELECT scene_id, row, col, unnest(list_filter([CASE WHEN row >= {GRID[0]} OR col >= {GRID[1]} THEN 'outside_grid' END,
    CASE WHEN red_before = 0 AND nir_before = 0 THEN 'zero_sum:before' END, CASE WHEN red_after = 0 AND nir_after = 0 THEN 'zero_sum:after' END], lambda x: x IS NOT NULL)) AS error FROM a
    UNION ALL SELECT scene_id, row, col, 'repeated_cell' FROM a GROUP BY 1, 2, 3 HAVING count(*) > 1)
SELECT DISTINCT * FROM e""")
def pixel_contract(spark: SparkSession, d: str) -> DataFrame:
    """Every good record against the declared grid; bands out of range never get past the reading of records."""
    good = rejects.split_records(table(spark, d, "scene_lines"), keys=("raw_id", "scene_id")).filter("reason IS NULL AND row IS NOT NULL AND col IS NOT NULL")
    return scene_contracts.pixel_errors(good, "scene_id", *GRID, rejects.NODATA)


@query(f"""WITH {_PIXELS_SQL}, c AS (SELECT scene_id, count(*) FILTER (WHERE row < {GRID[0]} AND col < {GRID[1]}) AS inside, count(*) FILTER (WHERE NOT (row < {GRID[0]} AND col < {GRID[1]})) AS outside, CAST(0 AS BIGINT) AS repeated FROM x GROUP BY 1)
SELECT *, {GRID[0] * GRID[1]} - inside AS missing, inside = {GRID[0] * GRID[1]} AND outside = 0 AS complete FROM c""")
def grid_contract(spark: SparkSession, d: str) -> DataFrame:
    return scene_contracts.grid_check(_pixels(spark, d), "scene_id", *GRID)


@query(f"""WITH {_PIXELS_SQL}, g AS (SELECT scene_id, r * {TILE[0]} AS r, c * {TILE[1]} AS c FROM (SELECT DISTINCT scene_id FROM x) z, unnest(range({-(-GRID[0] // TILE[0])})) AS a(r), unnest(range({-(-GRID[1] // TILE[1])})) AS b(c)),
tn AS (SELECT scene_id, tile, count(*) AS pixels, count(*) FILTER (WHERE valid) AS valid FROM x GROUP BY 1, 2)
SELECT g.scene_id, 'tile-r' || lpad(CAST(r AS VARCHAR), 4, '0') || '-c' || lpad(CAST(c AS VARCHAR), 4, '0') AS tile, coalesce(pixels, 0) AS pixels, coalesce(valid, 0) AS valid
FROM g LEFT JOIN tn ON tn.scene_id = g.scene_id AND tn.tile = 'tile-r' || lpad(CAST(r AS VARCHAR), 4, '0') || '-c' || lpad(CAST(c AS VARCHAR), 4, '0')""")
def tile_grid(spark: SparkSession, d: str) -> DataFrame:
    return scene_contracts.tile_counts(_pixels(spark, d), "scene_id", *GRID, *TILE)


@query()
def cell_features(spark: SparkSession, d: str) -> DataFrame:
    """One GeoJSON feature per valid cell, with its region and the class of its prediction."""
    pixels = _pixels(spark, d).filter("valid")
    regions = raster.components(pixels.filter("loss"), "scene_id")
    return scene_contracts.cell_features(pixels, regions, "scene_id", ORIGIN, CELL)


@query("""SELECT s.scene_id, EXISTS (SELECT 1 FROM trade_case_documents t WHERE t.case_id = s.case_id) AS bound FROM scenes s""")
def scene_cases(spark: SparkSession, d: str) -> DataFrame:
    return scene_contracts.bound_cases(table(spark, d, "scenes"), table(spark, d, "trade_case_documents"), "scene_id")
