"""A catalogue of landed CSV files: path, size and header, from the first block of each.

Files are listed with their sizes by Spark, and tasks open each one for its first block only. What is then scanned
are the files that a reader accepts, so rejected files are not read, and no row ever holds the paths of a header.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidewatch.session import cut_lineage

#: Bytes that are read of a file to find its header; more only if the header is longer.
BLOCK = 64 * 1024
SCHEMA = "path string, size bigint, header string"


def _opened(path: str):
    """The file system of a path and the path inside it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path)


def header_of(path: str, size: int) -> list[str] | None:
    """Column names of a CSV file; None if it is empty. Quoted names may hold commas and line ends."""
    store, place = _opened(path)
    with store.open_input_file(place) as file:
        block = BLOCK
        while True:
            file.seek(0)
            text = file.read(block).decode("utf-8-sig", errors="replace")
            lines = io.StringIO(text, newline="")
            names = next(csv.reader(lines, skipinitialspace=True), None)
            # A header that reaches the end of the block may go on behind it.
            if lines.tell() < len(text) or block >= size:
                return names
            block *= 4


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for files in batches:
        found = [header_of(p, n) for p, n in zip(files["path"], files["length"], strict=True)]
        yield pd.DataFrame({"path": files["path"], "size": files["length"], "header": [None if h is None else json.dumps(h) for h in found]})


def listed(spark: SparkSession, glob: str) -> DataFrame:
    """(path, length) of the files of a glob; their content is not read."""
    try:
        return spark.read.format("binaryFile").load(glob).select("path", "length")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing):
            raise FileNotFoundError(f"no file matches {glob}") from missing
        raise


def file_catalogue(spark: SparkSession, glob: str) -> DataFrame:
    """(path, size, header) per file that isn't empty, ``header`` being a JSON array of names; written once."""
    files = listed(spark, glob)
    first = files.first()
    if first is None:
        raise FileNotFoundError(f"no file matches {glob}")
    try:
        _opened(first["path"])
        found = files.mapInPandas(_headers, SCHEMA)
    except (ValueError, NotImplementedError, OSError):
        # A store that only Spark can open: first lines are taken from a scan.
        found = files.select("path", F.col("length").alias("size")).join(_scanned_headers(spark, glob), "path")
    return cut_lineage(found.filter("header is not null"), "file-catalogue")


def _scanned_headers(spark: SparkSession, glob: str) -> DataFrame:
    lines = spark.read.text(glob).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    first = lines.filter("start = 0").withColumn("_n", F.monotonically_increasing_id()).groupBy("path").agg(F.min_by("value", "_n").alias("line"))
    names = F.udf(lambda line: json.dumps(next(csv.reader([line.lstrip("﻿")], skipinitialspace=True))), "string")
    return first.select(F.url_decode("path").alias("path"), names("line").alias("header"))


def _escaped(path: str) -> str:
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def _split_size(spark: SparkSession) -> int:
    return int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))


def scan_csv(spark: SparkSession, files: DataFrame, names: Sequence[str], multi_line: bool | None = None) -> DataFrame:
    """The rows of catalogued files of one header, as text columns.

    Fields with line ends need a file read by one task. Files below the size of a split are one task anyway; larger
    ones are split unless a line of theirs has an odd number of quotes. ``multi_line`` says so instead of looking.
    """
    schema = StructType([StructField(n, StringType()) for n in names])
    limit = _split_size(spark)
    whole, split = [], []
    for r in files.select("path", "size").toLocalIterator():
        (whole if multi_line or (multi_line is None and r["size"] <= limit) else split).append(r["path"])
    if split and multi_line is None:
        lines = spark.read.text([_escaped(p) for p in split]).select(F.url_decode("_metadata.file_path").alias("path"), "value")
        odd = lines.filter(F.regexp_count("value", F.lit('"')) % 2 == 1).select("path").distinct()
        broken = {r["path"] for r in odd.toLocalIterator()}
        whole, split = whole + [p for p in split if p in broken], [p for p in split if p not in broken]
    frames = [
        spark.read.schema(schema).option("header", True).option("multiLine", many).option("escape", '"').csv([_escaped(p) for p in sorted(paths)])
        for paths, many in ((whole, True), (split, False)) if paths
    ]
    if not frames:
        return spark.createDataFrame([], schema)
    return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
