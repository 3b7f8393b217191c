"""Tables that a plan writes once and reads again, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_local: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's own checkpoint folder; only local sessions without either get a temporary one."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if at:
        return at.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = tempfile.mkdtemp(prefix="waymark-tables-")
    return _local[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """A path that is free; it is removed when the process ends."""
    path = f"{folder(spark)}/waymark-{name}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def stored(rows: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """rows written as Parquet and read back: later plans read the table instead of computing it again, also after an executor is lost."""
    path = new_path(rows.sparkSession, name)
    out = rows.write.partitionBy(*partition_by) if partition_by else rows.write
    out.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def remove_all() -> None:
    while _made:
        spark, path = _made.pop()
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session may have ended before
            continue


atexit.register(remove_all)
