"""Grid tables in CSV with an exact header, and arrays in NPY files."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_grid(spark: SparkSession, path: str, columns: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(typed rows, violations) of a CSV file whose header must be exactly columns (name -> Spark type).

    A violation is a row with a blank cell or one that is no value of its type: column, row text and reason.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    raw = spark.read.csv(path, schema=schema, header=True, enforceSchema=False, mode="FAILFAST")
    header = spark.read.text(path).limit(1).first()
    if header is None or [c.strip() for c in header[0].lstrip("﻿").split(",")] != list(columns):
        raise ValueError(f"the header is not {','.join(columns)}")
    reasons = F.array_compact(
        F.array(
            *(
                F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.concat(F.lit("blank:"), F.lit(c)))
                .when(F.col(c).try_cast(kind).isNull(), F.concat(F.lit("type:"), F.lit(c)))
                for c, kind in columns.items()
            )
        )
    )
    checked = raw.withColumn("reasons", reasons)
    good = checked.filter(F.size("reasons") == 0).select(*(F.col(c).cast(kind).alias(c) for c, kind in columns.items()))
    bad = checked.filter(F.size("reasons") > 0).select(F.concat_ws(",", *columns).alias("record"), "reasons")
    return good, bad


def duplicate_cells(cells: DataFrame) -> DataFrame:
    """row, col that occur more than once."""
    return cells.groupBy("row", "col").count().filter("count > 1").select("row", "col")


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """file, shape, kind, finite, sha256 and values (flattened, as doubles) of NPY files; pickled arrays are refused."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"), "content")

    def load(batches):
        for b in batches:
            arrays = [np.load(io.BytesIO(c), allow_pickle=False) for c in b["content"]]
            yield pd.DataFrame(
                {
                    "file": b["file"],
                    "sha256": b["sha256"],
                    "shape": [list(a.shape) for a in arrays],
                    "kind": [a.dtype.str for a in arrays],
                    "finite": [bool(np.isfinite(a).all()) for a in arrays],
                    "values": [a.astype(float).ravel().tolist() for a in arrays],
                }
            )

    return files.mapInPandas(load, "file string, sha256 string, shape array<int>, kind string, finite boolean, values array<double>")
