"""Contracts of raster cases: transforms, acquisitions, pixels against a declared grid, tiles and cell features."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import raster
from ledgerloom.session import small

BANDS = ("red_before", "nir_before", "red_after", "nir_after")
DAY = 86_400


def utc_time(text: Column) -> Column:
    """A whole-second UTC time written as 2024-01-31T23:59:59Z, null for any other text or no such time."""
    parts = F.concat_ws(" ", F.substring(text, 1, 10), F.substring(text, 12, 8))
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"), F.try_to_timestamp(parts, F.lit("yyyy-MM-dd HH:mm:ss")))


def iso_date(text: Column) -> Column:
    """A calendar date written as 2024-01-31, null for any other text or no such day."""
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text.try_cast("date"))


@dataclass(frozen=True)
class Affine:
    """Six coefficients in the order x origin, width, row rotation, y origin, column rotation, height, as exact texts."""

    coefficients: tuple[str, ...]

    def __post_init__(self) -> None:
        if len(self.coefficients) != 6:
            raise ValueError("a transform has six coefficients")
        if self.determinant == 0:
            raise ValueError("a transform must be invertible")

    @property
    def determinant(self) -> Decimal:
        _, width, row_rotation, _, col_rotation, height = map(Decimal, self.coefficients)
        return width * height - row_rotation * col_rotation

    @property
    def area(self) -> Decimal:
        return abs(self.determinant)

    def at(self, row: int, col: int) -> tuple[Decimal, Decimal]:
        x, width, row_rotation, y, col_rotation, height = map(Decimal, self.coefficients)
        return x + col * width + row * row_rotation, y + col * col_rotation + row * height

    def bbox(self, rows: int, cols: int) -> list[float]:
        """West, south, east, north of a grid, whichever way the transform turns it."""
        corners = [self.at(r, c) for r in (0, rows) for c in (0, cols)]
        xs, ys = [x for x, _ in corners], [y for _, y in corners]
        return [float(v) for v in (min(xs), min(ys), max(xs), max(ys))]


@dataclass(frozen=True)
class Season:
    """How far two acquisitions may lie apart: days of the year at most, days elapsed at least and at most."""

    most_day_gap: int = 30
    least_days: int = 1
    most_days: int = 3650

    def __post_init__(self) -> None:
        if not (0 < self.most_day_gap <= 183 and 0 < self.least_days <= self.most_days):
            raise ValueError("bounds of a season contradict each other")


def scene_errors(scenes: DataFrame, key: str, season: Season = Season()) -> DataFrame:
    """key, error of scenes (key, crs, nodata as text, label_before, label_after, acquired_before, acquired_after).

    Errors: crs_malformed, nodata_no_number, nodata_within_range (of reflectance, 0 to 1), label_missing,
    labels_differ, time_missing, times_out_of_order, day_gap_too_wide, elapsed_out_of_window.
    """
    nodata = F.col("nodata").try_cast("decimal(20,6)")
    before, after = F.col("acquired_before"), F.col("acquired_after")
    seconds = F.unix_timestamp(after.cast("timestamp")) - F.unix_timestamp(before.cast("timestamp"))
    labels = F.col("label_before").isNotNull() & F.col("label_after").isNotNull()
    timed = before.isNotNull() & after.isNotNull()
    rules = {
        "crs_malformed": ~F.coalesce(F.col("crs").rlike("^EPSG:[0-9]{4,5}$"), F.lit(False)), "nodata_no_number": nodata.isNull(), "nodata_within_range": nodata.between(0, 1),
        "label_missing": ~labels, "labels_differ": labels & (F.col("label_before") != F.col("label_after")), "time_missing": ~timed, "times_out_of_order": seconds <= 0,
        "day_gap_too_wide": raster.day_gap(before, after) > season.most_day_gap, "elapsed_out_of_window": (seconds > 0) & ~seconds.between(season.least_days * DAY, season.most_days * DAY),
    }
    found = F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules.items())))
    return scenes.select(key, F.explode(found).alias("error"))


def pixel_errors(pixels: DataFrame, group: str, rows: int, cols: int, nodata: float) -> DataFrame:
    """group, row, col, error of pixels: outside_grid, repeated_cell, out_of_range:band, zero_sum:when (red and nir are
    both 0, so that they have no index). A repeated cell is reported once."""
    outside = (F.col("row") < 0) | (F.col("row") >= rows) | (F.col("col") < 0) | (F.col("col") >= cols)
    ranged = [F.when(~F.coalesce(F.col(b).between(0, 1) | (F.col(b) == nodata), F.lit(False)), F.lit(f"out_of_range:{b}")) for b in BANDS]
    zero = [F.when((F.col(f"red_{w}") == 0) & (F.col(f"nir_{w}") == 0), F.lit(f"zero_sum:{w}")) for w in ("before", "after")]
    own = pixels.select(group, "row", "col", F.explode(F.array_compact(F.array(F.when(outside, "outside_grid"), *ranged, *zero))).alias("error"))
    twice = pixels.groupBy(group, "row", "col").count().filter("count > 1").select(group, "row", "col", F.lit("repeated_cell").alias("error"))
    return own.unionByName(twice).distinct()


def grid_check(pixels: DataFrame, group: str, rows: int, cols: int) -> DataFrame:
    """group, inside, outside, repeated, missing, complete of every group against a grid of rows x cols, without
    generating it: missing cells are counted by what is there. raster.gap_runs lists them."""
    per_cell = pixels.groupBy(group, "row", "col").agg(F.count("*").alias("n"))
    inside = F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)
    counts = per_cell.groupBy(group).agg(F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"), F.count_if(F.col("n") > 1).alias("repeated"))
    missing = F.lit(rows * cols) - F.col("inside")
    return counts.select("*", missing.alias("missing"), ((missing == 0) & (F.col("outside") == 0) & (F.col("repeated") == 0)).alias("complete"))


def tile_counts(pixels: DataFrame, group: str, rows: int, cols: int, height: int, width: int) -> DataFrame:
    """group, tile, pixels, valid of every tile of the grid of every group, also of those without a pixel."""
    tile = raster.tile_id(F.col("row"), F.col("col"), height, width)
    counts = pixels.groupBy(group, tile.alias("tile")).agg(F.count("*").alias("pixels"), F.count_if("valid").alias("valid"))
    corner = lambda n, step: F.sequence(F.lit(0), F.lit(n - 1), F.lit(step))
    grid = pixels.select(group).distinct().withColumn("row", F.explode(corner(rows, height))).withColumn("col", F.explode(corner(cols, width)))
    every = grid.select(group, tile.alias("tile"))
    return every.join(counts, [group, "tile"], "left").fillna(0, ["pixels", "valid"])


def cell_features(pixels: DataFrame, regions: DataFrame, group: str, origin: tuple[str, str], size: tuple[str, str]) -> DataFrame:
    """group, row, col, feature: a GeoJSON feature for every pixel (loss, reference, before, after) in degrees, with its
    region, if it lies in one, and the class of its prediction.

    origin is longitude and latitude of the upper left corner, size width and height of a cell. Rings run
    counter-clockwise from the upper left corner.
    """
    west = F.lit(origin[0]).cast("decimal(18,9)") + F.col("col") * F.lit(size[0]).cast("decimal(18,9)")
    north = F.lit(origin[1]).cast("decimal(18,9)") - F.col("row") * F.lit(size[1]).cast("decimal(18,9)")
    east, south = west + F.lit(size[0]).cast("decimal(18,9)"), north - F.lit(size[1]).cast("decimal(18,9)")
    point = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    ring = F.array(point(west, north), point(west, south), point(east, south), point(east, north), point(west, north))
    joined = pixels.join(regions.select(group, "row", "col", "region"), [group, "row", "col"], "left")
    kind = (
        F.when(F.col("loss") & F.col("reference"), "tp").when(F.col("loss"), "fp").when(F.col("reference"), "fn").otherwise("tn")
    )
    six = lambda c: F.round(F.col(c).cast("double"), 6).alias(c)
    properties = F.struct("row", "col", F.col("loss").alias("predicted_loss"), F.col("reference").alias("reference_loss"), kind.alias("confusion_class"), "region", six("before"), six("after"))
    feature = F.struct(
        F.lit("Feature").alias("type"), F.format_string("cell-r%03d-c%03d", "row", "col").alias("id"), properties.alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
    )
    return joined.select(group, "row", "col", F.to_json(feature).alias("feature"))


def bound_cases(scenes: DataFrame, cases: DataFrame, key: str) -> DataFrame:
    """key, bound: whether the case that a scene names is there; scenes without a case are unbound."""
    known = cases.select(F.col("case_id").alias("#case")).distinct().withColumn("#there", F.lit(True))
    joined = scenes.select(key, "case_id").join(small(known), F.col("case_id") == F.col("#case"), "left")
    return joined.select(key, F.coalesce("#there", F.lit(False)).alias("bound"))
