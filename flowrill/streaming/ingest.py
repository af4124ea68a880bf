"""From raw capture lines to typed flows, with malformed lines kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowrill.operators.clean import coerce_flows
from flowrill.schema import CANONICAL_COLUMNS

CORRUPT = "_corrupt_record"
ORIGIN = ["source_file", "position"]


def parse_lines(lines: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Add ``fields`` (text per column) and ``malformed``.

    A line is malformed when its number of fields is wrong, or its file's header is not the
    expected one.
    """
    columns = columns or CANONICAL_COLUMNS
    ddl = ", ".join(f"`{c}` string" for c in columns) + f", `{CORRUPT}` string"
    fields = F.from_csv(
        "line", ddl,
        {
            "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT,
            "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true",
        },
    )
    parsed = lines.withColumn("fields", fields)
    wrong = F.col(f"fields.{CORRUPT}").isNotNull() | ~F.col("header_ok")
    return parsed.withColumn("malformed", F.coalesce(wrong, F.lit(True)))


def stored_lines(spark: SparkSession, parsed: DataFrame, path: str) -> DataFrame:
    """The parsed lines from a table, written here, that holds what is read of them later.

    Of a well-formed line that is the fields, of a malformed one the line. Reading it takes only the
    columns asked for, and the session given adapts plans to sizes.
    """
    good = ~F.col("malformed")
    kept = parsed.select(
        *ORIGIN, "malformed", F.when(good, F.col("fields")).alias("fields"), F.when(~good, F.col("line")).alias("line")
    )
    kept.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(kept.schema).parquet(path)


def malformed_lines(parsed: DataFrame) -> DataFrame:
    """Lines for the quarantine table, with where they came from."""
    return parsed.where("malformed").select(*ORIGIN, "line")


def typed_lines(parsed: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Typed flows of the well-formed lines."""
    columns = columns or CANONICAL_COLUMNS
    good = parsed.where("not malformed")
    return coerce_flows(good.select(*[F.col(f"fields.`{c}`").alias(c) for c in columns]))
