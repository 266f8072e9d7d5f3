"""Manifest-driven cases: a strict JSON manifest names grid files, which are checked and read together."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.sources.grids import read_grid
from ledgerloom.sources.manifests import contained
from ledgerloom.sources.strict_json import loads


@dataclass(frozen=True)
class Case:
    """The manifest, its tables by name, the rows that broke their contract, and byte evidence of every file."""

    manifest: dict
    tables: dict[str, DataFrame]
    violations: dict[str, DataFrame]
    evidence: dict[str, dict[str, object]]


def load_case(spark: SparkSession, path: str | Path, tables: dict[str, dict[str, str]]) -> Case:
    """Read the files that the manifest's object files names (table -> relative path); tables gives their columns.

    Exactly the declared tables must be named; a path that leaves the manifest's folder is an error.
    """
    manifest = loads(Path(path).read_bytes())
    files = manifest.get("files") if isinstance(manifest, dict) else None
    if not isinstance(files, dict) or set(files) != set(tables):
        raise ValueError(f"files must name exactly {sorted(tables)}")
    found, broken, evidence = {}, {}, {}
    for name, columns in tables.items():
        file = contained(Path(path).parent, files[name])
        data = file.read_bytes()
        evidence[name] = {"bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}
        found[name], broken[name] = read_grid(spark, str(file), columns)
    return Case(manifest, found, broken, evidence)
