"""CSV captures: tolerant reading, combining files with different headers, writing datasets."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowrill.schema import CANONICAL_COLUMNS, text_schema

CORRUPT = "_corrupt_record"


def _scan(spark: SparkSession, paths, columns: list[str], encoding: str) -> DataFrame:
    schema = text_schema(columns).add(CORRUPT, T.StringType())
    # Column pruning inside the CSV parser would skip the field-count check, so that the same row
    # would be malformed for one query and fine for another.
    return (
        spark.read.schema(schema)
        .option("header", "true")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("encoding", encoding)
        .option("columnPruning", "false")
        .option("ignoreLeadingWhiteSpace", "true")
        .option("ignoreTrailingWhiteSpace", "true")
        .csv(paths)
    )


def _parsed(columns: list[str]):
    """Always true, but refers to a data column: Spark refuses scans of the corrupt column only."""
    return F.length(F.coalesce(F.col(f"`{columns[0]}`"), F.lit(""))) >= 0


def read_flows(
    spark: SparkSession,
    path: str | list[str],
    columns: list[str] | None = None,
    encoding: str = "UTF-8",
) -> DataFrame:
    """A capture as text columns; rows with a wrong number of fields are skipped.

    Values stay text: :func:`flowrill.operators.clean.coerce_flows` types them without failing.
    """
    columns = columns or CANONICAL_COLUMNS
    rows = _scan(spark, path, columns, encoding)
    return rows.where(F.col(CORRUPT).isNull() & _parsed(columns)).drop(CORRUPT)


def read_malformed(
    spark: SparkSession,
    path: str | list[str],
    columns: list[str] | None = None,
    encoding: str = "UTF-8",
) -> DataFrame:
    """The rows that :func:`read_flows` skips, as ``raw_line`` with the file they came from."""
    columns = columns or CANONICAL_COLUMNS
    rows = _scan(spark, path, columns, encoding)
    return rows.where(F.col(CORRUPT).isNotNull() & _parsed(columns)).select(
        F.col(CORRUPT).alias("raw_line"), F.col("_metadata.file_path").alias("source_file")
    )


def _list_csv(directory: str) -> tuple[fs.FileSystem, list[str], str]:
    filesystem, root = fs.FileSystem.from_uri(directory) if "://" in directory else (
        fs.LocalFileSystem(), directory)
    prefix = directory.split("://", 1)[0] + "://" if "://" in directory else ""
    names = [
        info.path
        for info in filesystem.get_file_info(fs.FileSelector(root))
        if info.is_file and info.path.endswith(".csv")
    ]
    return filesystem, sorted(names), prefix


def _header(filesystem: fs.FileSystem, path: str, encoding: str) -> tuple[str, ...]:
    """Column names of a capture; repeated ones get ``.1``, ``.2``, ... in order."""
    with filesystem.open_input_stream(path) as stream:
        head = b""
        while True:  # a line end inside quotes does not end the header
            block = stream.read(65536)
            head += block
            end = head.find(b"\n")
            while end >= 0 and head.count(b'"', 0, end) % 2:
                end = head.find(b"\n", end + 1)
            if end >= 0 or not block:
                break
    text = (head if end < 0 else head[:end]).decode(encoding).lstrip("\ufeff").rstrip("\r")
    return unique_names(name.strip() for name in next(csv.reader(io.StringIO(text, newline="")), []))


def unique_names(names: Iterable[str]) -> tuple[str, ...]:
    """Names in order, repeated ones numbered: ``a, a, a`` become ``a, a.1, a.2``."""
    seen: dict[str, int] = {}
    out: list[str] = []
    for name in names:
        number = seen.get(name, 0)
        seen[name] = number + 1
        out.append(f"{name}.{number}" if number else name)
    return tuple(out)


def combine_captures(spark: SparkSession, directory: str, encoding: str = "UTF-8") -> DataFrame:
    """All ``*.csv`` files of a folder as one table, columns matched by name, missing ones null.

    The driver reads only the header line of each file; files that share a header are one scan.
    """
    filesystem, paths, prefix = _list_csv(directory)
    if not paths:
        raise FileNotFoundError(f"no CSV files in {directory}")
    with ThreadPoolExecutor(16) as pool:
        headers = list(pool.map(lambda p: _header(filesystem, p, encoding), paths))
    groups: dict[tuple[str, ...], list[str]] = {}
    for header, path in zip(headers, paths):
        groups.setdefault(header, []).append(prefix + path)
    parts = [
        read_flows(spark, files, list(header), encoding) for header, files in sorted(groups.items())
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def label_capture(df: DataFrame, label: str, column: str = "label") -> DataFrame:
    """Give every row of a capture the same label."""
    return df.withColumn(column, F.lit(label))


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a cleaned, balanced or combined set, replacing an earlier one.

    The target must lie outside the input folder, otherwise a second run would read its own output.
    """
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.format(fmt).save(path)
