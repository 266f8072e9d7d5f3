"""Byte manifests: name, size and hash of files, read and hashed on the executors."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def byte_manifest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, bytes, sha256 of every file under paths, at any depth. Files of more than 2 GB are beyond binaryFile."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    name = F.regexp_extract("path", "([^/]+/)?[^/]+$", 0)
    return files.select(name.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def contained(base: str | Path, relative: str) -> Path:
    """The path of a manifest-relative file; leaving the folder of the manifest is an error."""
    folder = Path(base).resolve()
    target = (folder / relative).resolve()
    if Path(relative).is_absolute() or not target.is_relative_to(folder):
        raise ValueError(f"{relative} leaves {folder}")
    return target
