"""Line sources: word tables of recognisers, page text and JSON lines, all as (page, line, text, confidence) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators import evidence

# The columns of a recogniser's word table.
WORD_COLUMNS = "level page_num block_num par_num line_num word_num left top width height conf text".split()
LINE_SCHEMA = "struct<line:int,text:string,confidence:double,page:int>"
JSON_SCHEMA = f"struct<pages:array<struct<page:int,lines:array<{LINE_SCHEMA}>>>,lines:array<{LINE_SCHEMA}>>"


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """file, page, line, text, confidence of tab-separated word tables: words of level 5 joined to lines, renumbered per page.

    Confidence is the mean of the words' percents over 100, rounded half-even to 6 digits. A missing column or a word
    that occurs twice in a file is an error.
    """
    raw = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', inferSchema=False)
    names = [c.lstrip("\ufeff") for c in raw.columns]
    if missing := set(WORD_COLUMNS) - set(names):
        raise ValueError(f"columns missing: {sorted(missing)}")
    raw = raw.select("*", F.col("_metadata.file_path").alias("#file")).toDF(*names, "file")
    ints = [c for c in WORD_COLUMNS if c.endswith("_num")]
    words = raw.filter((F.trim("level") == "5") & (F.trim(F.coalesce("text", F.lit(""))) != "")).select(
        "file", *(F.col(c).cast("int").alias(c) for c in ints), F.col("conf").cast("double").alias("conf"), F.trim("text").alias("text")
    )
    twice = words.groupBy("file", *ints).count().filter("count > 1")
    if twice.limit(1).count():
        raise ValueError("a word occurs twice")
    lines = evidence.words_to_lines(words, ["file", "page_num", "block_num", "par_num", "line_num"], "word_num", "text", "conf")
    order = Window.partitionBy("file", "page_num").orderBy("block_num", "par_num", "line_num")
    return lines.select("file", F.col("page_num").alias("page"), F.row_number().over(order).alias("line"), "text", "confidence")


def read_pages(spark: SparkSession, path: str, confidence: float = 0.0) -> DataFrame:
    """file, page, line, text, confidence of plain text: form feeds end pages, blank lines are dropped."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return evidence.pages_of(files, "file", "value").select("file", "page", "line", "text", F.lit(confidence).alias("confidence"))


def read_json_lines(spark: SparkSession, path: str, scale: str = "unit", default: float = 0.0) -> DataFrame:
    """file, page, line, text, confidence of nested or flat JSON lines, or a bare list; missing line numbers are counted
    on within the page of a file.

    scale is unit (0 to 1) or percent. A line whose page contradicts its parent is an error.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    text = F.when(F.ltrim("value").startswith("["), F.concat(F.lit('{"lines":'), F.col("value"), F.lit("}"))).otherwise(F.col("value"))
    doc = files.select("file", F.from_json(text, JSON_SCHEMA).alias("d"))
    nested = doc.select("file", F.posexplode("d.pages").alias("i", "p")).select("file", "i", F.coalesce("p.page", F.col("i") + 1).alias("page"), F.posexplode("p.lines").alias("k", "l"))
    flat = doc.filter("d.pages IS NULL").select("file", F.lit(0).alias("i"), F.posexplode("d.lines").alias("k", "l")).select("file", "i", F.coalesce("l.page", F.lit(1)).alias("page"), "k", "l")
    rows = nested.unionByName(flat).select("file", "page", "i", "k", "l.line", "l.text", "l.confidence", F.col("l.page").alias("own"))
    if rows.filter("own IS NOT NULL AND own <> page").limit(1).count():
        raise ValueError("a line contradicts the page it stands in")
    numbered = evidence.auto_numbers(rows, ["file", "page"], ["i", "k"], "line")
    factor = 100.0 if scale == "percent" else 1.0
    return numbered.select("file", "page", F.col("state").cast("int").alias("line"), "text", F.coalesce(F.col("confidence") / factor, F.lit(default)).alias("confidence"))


def read_ocr(spark: SparkSession, path: str, kind: str, **options: object) -> DataFrame:
    """Lines of any of the formats words, pages and json; path may name a folder of files."""
    readers = {"words": read_words, "pages": read_pages, "json": read_json_lines}
    if kind not in readers:
        raise ValueError(f"unknown format {kind}; known are {sorted(readers)}")
    return readers[kind](spark, path, **options)


def to_bundles(lines: DataFrame, document_type: str, language: str) -> DataFrame:
    """document_id (the file's name), document_type, language, pages: one nested document per file of lines.

    A (page, line) that occurs twice in a file is an error.
    """
    if lines.groupBy("file", "page", "line").count().filter("count > 1").limit(1).count():
        raise ValueError("a line occurs twice")
    pages = lines.groupBy("file", "page").agg(F.array_sort(F.collect_list(F.struct("line", "text", "confidence"))).alias("lines"))
    bundles = pages.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("page", "lines"))).alias("pages"))
    name = F.element_at(F.split("file", "/"), -1)
    return bundles.select(name.alias("document_id"), F.lit(document_type).alias("document_type"), F.lit(language).alias("language"), "pages")


def to_bundle(lines: DataFrame, document_id: str, document_type: str, language: str) -> DataFrame:
    """The nested document of the lines of one file; lines of several files, one that occurs twice, or none is an error."""
    files = lines.select("file").distinct().limit(2).count()
    if files != 1:
        raise ValueError("there is no line" if files == 0 else "lines of several files; use to_bundles")
    return to_bundles(lines, document_type, language).withColumn("document_id", F.lit(document_id))
