"""Column bookkeeping shared by the operators.

Operators pack the rows they are given into one struct, so that columns of any name, also such as
an operator adds itself, do not get in its way. In a result the operator's columns win.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowrill.session import delete_path, shared_dir

ROW = "row"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_KEPT: dict[str, Any] = {}


def kept(name: str, make: Callable[[], Any]) -> Any:
    """What a worker process keeps from task to task. It keeps one thing only: asking for another lets go
    of it, so a worker that serves several operators does not hold what all of them keep."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not use yet."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def packed(df: DataFrame) -> DataFrame:
    """All columns as one struct named ``row``."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW))


def unpacked(df: DataFrame, *added: str) -> DataFrame:
    """The packed columns again, followed by the ``added`` ones, which win over equal names."""
    taken = {c.lower() for c in added}
    fields = [f.name for f in df.schema[ROW].dataType.fields if f.name.lower() not in taken]
    return df.select(*[F.col(ROW).getField(c).alias(c) for c in fields], *added)


def with_fields(df: DataFrame, *fields: T.StructField) -> T.StructType:
    return T.StructType([*df.schema.fields, *fields])


def stored(
    df: DataFrame, name: str, compression: str | None = None, by: str | None = None
) -> tuple[DataFrame, str]:
    """The frame written to a new table in the shared folder and read again; and the table's path.
    Rows with each value of ``by`` are in a folder of their own, which can be deleted alone.

    Cuts lineage: what a lost executor held is read again, not computed again. So the write's shuffle
    files serve nothing any more and go at its end, not when the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path, before = shared_dir(spark, name), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, partitionBy=by, compression=compression)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def discard(*paths: str) -> None:
    """Delete tables of :func:`stored` that nothing reads any more."""
    for path in paths:
        delete_path(SparkSession.active(), path)
