"""Byte-stable outputs of small results: canonical JSON, GeoJSON, SVG and HTML tables. Data goes to Parquet."""

from __future__ import annotations

import hashlib
import html
import json
from pathlib import Path

from pyspark.sql import DataFrame

#: Rows that a report may have; larger results belong in a table.
MOST_ROWS = 100_000


def rows_of(df: DataFrame, order: list[str]) -> list[dict]:
    """Rows as plain objects in a stable order; more than MOST_ROWS are an error."""
    rows = df.orderBy(*order).limit(MOST_ROWS + 1).toJSON().collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows; write a table instead")
    return [json.loads(r) for r in rows]


def pretty(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2, allow_nan=False) + "\n"


def compact(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def digest(value: object) -> str:
    return hashlib.sha256(compact(value).encode()).hexdigest()


def write_json(df: DataFrame, path: str | Path, order: list[str]) -> dict[str, object]:
    """Write rows as canonical JSON; returns bytes and sha256."""
    data = pretty(rows_of(df, order)).encode()
    Path(path).write_bytes(data)
    return {"bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}


def feature_collection(features: DataFrame, order: list[str]) -> str:
    """GeoJSON of a column feature that holds one feature's text per row."""
    rows = features.orderBy(*order).select("feature").limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} features")
    return pretty({"type": "FeatureCollection", "features": [json.loads(r.feature) for r in rows]})


def svg_grid(cells: DataFrame, size: int = 12) -> str:
    """A picture of row, col, fill cells; more than MOST_ROWS are an error."""
    rows = cells.select("row", "col", "fill").orderBy("row", "col").limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} cells")
    body = "".join(f'<rect x="{r.col * size}" y="{r.row * size}" width="{size}" height="{size}" fill="{html.escape(r.fill)}"/>\n' for r in rows)
    width, height = (max((r.col for r in rows), default=-1) + 1) * size, (max((r.row for r in rows), default=-1) + 1) * size
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">\n{body}</svg>\n'


def html_table(df: DataFrame, order: list[str], title: str) -> str:
    rows = rows_of(df, order)
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(r.get(c, '')))}</td>" for c in df.columns) + "</tr>\n" for r in rows)
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><table><tr>{head}</tr>\n{body}</table>\n'
