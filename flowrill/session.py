"""Session settings the operators are designed for, and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# AQE re-plans joins, merges small and splits skewed shuffle partitions at run time.
# The window limit threshold lets per-key top-n windows up to 1100 rows prune before the shuffle.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.windowGroupLimitThreshold": "1100",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    app_name: str = "flowrill",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **conf: str,
) -> SparkSession:
    """Session with :data:`RECOMMENDED_CONF`; on a cluster leave ``master`` to spark-submit.

    ``shuffle_partitions`` should be a small multiple of the executor cores (and large enough
    for a partition to stay near 200 MB); AQE then merges what turns out to be small.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    settings = dict(RECOMMENDED_CONF)
    if shuffle_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names the folder. Only on one machine may it be unset; a temporary
    folder is used there. On a cluster executors would each write to a disk of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="flowrill-")
    return f"{qualified(spark, base).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, so that workers open the one that Spark's readers open."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return re.sub("^file:/(?!/)", "file:///", uri)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the file system Spark resolves it to."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if it does not exist."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def move_path(spark: SparkSession, old: str, new: str) -> None:
    """Give a file a new place; one that is there is replaced."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(old).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path(new).getParent())
    system.delete(path(new), False)
    if not system.rename(path(old), path(new)):
        raise OSError(f"cannot move {old} to {new}")


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it exists, in the file system Spark resolves it to."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Have the shuffle files of what is written within removed at each write's end, not when the driver
    happens to collect garbage. For writes that are read again from where they went."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Give the session a checkpoint folder when the cluster has not named one."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "checkpoint"))
