"""Raster change masks as keyed rows: vegetation index, masking, tiles, geometry, components and confusion."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import discard, materialise

BAND, INDEX = "decimal(10,6)", "decimal(38,30)"


def index(red: Column, nir: Column) -> Column:
    """(nir - red) / (nir + red) in decimals, null where the sum is 0; typed so that the quotient keeps 30 digits."""
    r, n = red.cast(BAND), nir.cast(BAND)
    total = F.nullif(n + r, F.lit(0))
    return ((n - r).cast("decimal(31,29)") / total.cast("decimal(7,6)")).cast(INDEX)


def loss(before: Column, after: Column, least_before: str, least_loss: str) -> Column:
    """Loss of cover: dense before, and lower by at least least_loss; both bounds inclusive, on unrounded values."""
    return (before >= F.lit(least_before).cast("decimal(4,2)")) & (before - after >= F.lit(least_loss).cast("decimal(4,2)"))


def mask_reasons(nodata: float) -> Column:
    """Ordered reasons why a pixel is masked, as an array; empty for valid pixels."""
    missing = lambda a, b: (F.col(a) == nodata) | (F.col(b) == nodata)
    qa = lambda c, when: F.when(F.col(c) != "clear", F.concat(F.lit(f"qa_{when}:"), F.col(c)))
    return F.array_compact(
        F.array(
            F.when(missing("red_before", "nir_before"), "nodata_before"), qa("qa_before", "before"),
            F.when(missing("red_after", "nir_after"), "nodata_after"), qa("qa_after", "after"),
        )
    )


def tile_id(row: Column, col: Column, height: int, width: int) -> Column:
    """Identifier of the tile that holds a cell: arithmetic instead of a containment join."""
    return F.format_string("tile-r%04d-c%04d", F.floor(row / height) * height, F.floor(col / width) * width)


def corners(row: Column, col: Column, transform: tuple[str, ...]) -> list[tuple[Column, Column]]:
    """(x, y) of the four corners of a cell under six affine coefficients, counter-clockwise in cell space."""
    x0, pw, rr, y0, cr, ph = (F.lit(t).cast("decimal(18,6)") for t in transform)

    def at(r: Column, c: Column) -> tuple[Column, Column]:
        return x0 + c * pw + r * rr, y0 + c * cr + r * ph

    return [at(row, col), at(row + 1, col), at(row + 1, col + 1), at(row, col + 1)]


def ring(points: list[tuple[Column, Column]]) -> Column:
    """Closed counter-clockwise ring of points, by the sign of the shoelace sum."""
    pts = [F.array(x.cast("double"), y.cast("double")) for x, y in points]
    area = sum((a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1], strict=True)), F.lit(0))
    forward, backward = F.array(*pts, pts[0]), F.array(pts[0], *reversed(pts[1:]), pts[0])
    return F.when(area >= 0, forward).otherwise(backward)


def confusion(actual: Column, predicted: Column) -> list[Column]:
    """tp, fp, fn, tn over all rows."""
    return [
        F.count_if(actual & predicted).alias("tp"), F.count_if(~actual & predicted).alias("fp"),
        F.count_if(actual & ~predicted).alias("fn"), F.count_if(~actual & ~predicted).alias("tn"),
    ]


def mask_scores(counts: DataFrame) -> DataFrame:
    """counts with precision, recall, f1 and iou, null where undefined, and the list of undefined ones."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    scores = {"precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn), "f1": F.try_divide(2 * tp, 2 * tp + fp + fn), "iou": F.try_divide(tp, tp + fp + fn)}
    rows = counts.withColumns({k: F.bround(v, 6) for k, v in scores.items()})
    return rows.withColumn("undefined", F.concat_ws(",", *(F.when(F.col(k).isNull(), k) for k in scores)))


def gap_runs(cells: DataFrame, group: str) -> DataFrame:
    """group, row, row_end, col, col_end: rectangles that cells lack of the bounding grid of their group.

    Runs are found between neighbours, so that the work follows the cells and not the grid: a stray row number of a
    thousand million is one run. Missing cells of a row are runs of one row, missing rows are runs of the whole width.
    """
    cells = cells.select(group, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).distinct()
    bounds = cells.groupBy(group).agg(F.min("col").alias("low"), F.max("col").alias("high"))
    line = Window.partitionBy(group, "row").orderBy("col")
    rows = cells.withColumns({"next": F.lead("col").over(line), "before": F.lag("col").over(line)}).join(bounds, group)
    run = lambda a, b: F.struct(a.alias("col"), b.alias("col_end"))
    found = F.array(
        F.when(F.col("before").isNull(), run(F.col("low"), F.col("col") - 1)), run(F.col("col") + 1, F.coalesce(F.col("next") - 1, F.col("high")))
    )
    within = rows.select(group, "row", F.col("row").alias("row_end"), F.explode(F.array_compact(found)).alias("r")).filter("r.col <= r.col_end")
    present = cells.select(group, "row").distinct().withColumn("next", F.lead("row").over(Window.partitionBy(group).orderBy("row")))
    absent = present.filter("next > row + 1").join(bounds, group).select(group, (F.col("row") + 1).alias("row"), (F.col("next") - 1).alias("row_end"), F.col("low").alias("col"), F.col("high").alias("col_end"))
    return within.select(group, "row", "row_end", "r.col", "r.col_end").unionByName(absent)


def grid_gaps(cells: DataFrame, group: str) -> DataFrame:
    """group, row, col of the cells missing from the bounding grid of each group: the runs, cell by cell."""
    rows = gap_runs(cells, group).withColumn("row", F.explode(F.sequence("row", "row_end")))
    return rows.select(group, "row", F.explode(F.sequence("col", "col_end")).alias("col"))


#: Rows and columns of the tiles within which cells are connected at once; a task holds one tile.
COMPONENT_TILE = 512


def _tile_components(group: str, connectivity: int):
    """Label of each cell of one tile: its component's first cell in the tile, by hooking and pointer jumping on arrays."""
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])

    def connect(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values(["row", "col"], ignore_index=True)
        row, col = cells["row"].to_numpy(), cells["col"].to_numpy()
        r, c = row - row.min(), col - col.min() + 1
        width = int(c.max()) + 2  # a column on either side keeps neighbours of different rows apart
        keys = r * width + c
        label = np.arange(len(cells))
        here, there = [], []
        for a, b in steps:
            at = np.searchsorted(keys, keys + a * width + b)
            hit = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == keys + a * width + b)
            here.append(np.flatnonzero(hit))
            there.append(at[hit])
        u, v = np.concatenate(here), np.concatenate(there)
        while len(u):
            x, y = label[u], label[v]
            open_ = x != y
            if not open_.any():
                break
            u, v, x, y = u[open_], v[open_], x[open_], y[open_]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
        return pd.DataFrame({group: cells[group], "row": row, "col": col, "first_row": row[label], "first_col": col[label]})

    return connect


def components(cells: DataFrame, group: str, connectivity: int = 4, rounds: int = 60, tile: int = COMPONENT_TILE) -> DataFrame:
    """group, row, col, region: connected cells of each group, numbered row-major by their first cell.

    Cells are connected within tiles first, a bounded piece per task, so that a large group spreads over many tasks.
    Only cells along the borders of tiles are joined to their neighbours; the pieces so linked are merged by taking the
    least label of the neighbours and the label of that label, in rounds that grow with the logarithm of the pieces in a
    row. Lineage is cut in shared storage each round, and the table of the round before deleted; rounds bounds a runaway
    loop by an error. Cells may have any row and column numbers; repeated cells count once.
    """
    kind = cells.schema[group].dataType.simpleString()
    base = cells.select(group, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).distinct()
    tiled = base.withColumns({"tr": F.floor(F.col("row") / tile), "tc": F.floor(F.col("col") / tile)})
    schema = f"`{group}` {kind}, row long, col long, first_row long, first_col long"
    local = tiled.groupBy(group, "tr", "tc").applyInPandas(_tile_components(group, connectivity), schema)
    first = F.struct(F.col("first_row").alias("row"), F.col("first_col").alias("col"))
    pieces = materialise(local.select(group, "row", "col", first.alias("piece")), "pieces")
    # Border cells meet their neighbours in other tiles; each link of two pieces once.
    offsets = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    edge_r, edge_c = F.pmod("row", F.lit(tile)), F.pmod("col", F.lit(tile))
    border = pieces.filter((edge_r == 0) | (edge_r == tile - 1) | (edge_c == 0) | (edge_c == tile - 1))
    around = F.array(*(F.struct((F.col("row") + a).alias("r"), (F.col("col") + b).alias("c")) for a, b in offsets))
    reach = border.select(group, F.col("piece").alias("a"), F.explode(around).alias("n")).select(group, "a", F.col("n.r").alias("row"), F.col("n.c").alias("col"))
    links = reach.join(border.select(group, "row", "col", F.col("piece").alias("b")), [group, "row", "col"]).filter("a <> b").select(group, "a", "b").distinct()
    edges = materialise(links.union(links.select(group, "b", "a")).distinct(), "links")
    label = materialise(edges.select(group, F.col("a").alias("piece")).distinct().withColumn("label", F.col("piece")), "labels")
    for _ in range(rounds if edges.limit(1).count() else 0):
        theirs = label.select(group, F.col("piece").alias("b"), F.col("label").alias("theirs"))
        near = edges.join(theirs, [group, "b"]).groupBy(group, F.col("a").alias("piece")).agg(F.min("theirs").alias("near"))
        lower = label.join(near, [group, "piece"]).select(group, "piece", "label", F.least("label", "near").alias("lower"))
        jump = label.select(group, F.col("piece").alias("lower"), F.col("label").alias("jumped"))
        stepped = lower.join(jump, [group, "lower"], "left").select(group, "piece", F.least("lower", "jumped").alias("fresh"), "label")
        updated = materialise(stepped.select(group, "piece", F.col("fresh").alias("label"), (F.col("fresh") != F.col("label")).alias("moved")), "labels")
        discard(label)
        label = updated
        if label.filter("moved").limit(1).count() == 0:
            break
    else:
        if edges.limit(1).count():
            raise RuntimeError("components did not settle; raise rounds")
    discard(edges)
    merged = pieces.join(label.select(group, "piece", "label"), [group, "piece"], "left").select(group, "row", "col", F.coalesce("label", "piece").alias("label"))
    numbered = merged.select(group, "label").distinct().withColumn("region", F.row_number().over(Window.partitionBy(group).orderBy("label")))
    return merged.join(numbered, [group, "label"]).select(group, "row", "col", "region")


def day_gap(a: Column, b: Column) -> Column:
    """Circular distance of two calendar days, both mapped to a leap year."""
    day = lambda x: F.make_date(F.lit(2000), F.month(x), F.day(x))
    gap = F.abs(F.datediff(day(a), day(b)))
    return F.least(gap, F.lit(366) - gap)
