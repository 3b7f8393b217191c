"""File sources and sinks with declared schemas."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("csv", "parquet", "json", "orc")
_MONTH = re.compile(r"\d{6}")


def format_of(path: str, fmt: str | None) -> str:
    found = (fmt or path.rsplit(".", 1)[-1]).lower()
    if found not in FORMATS:
        raise ValueError(f"unsupported format {found}; one of {FORMATS}")
    return found


def month(token: str) -> str:
    """A month as YYYYMM, or an error."""
    if not _MONTH.fullmatch(token) or not 1 <= int(token[4:]) <= 12:
        raise ValueError(f"not a month: {token}")
    return token


def months(first: str, last: str) -> list[str]:
    a, b = (int(m[:4]) * 12 + int(m[4:]) - 1 for m in (month(first), month(last)))
    return [f"{k // 12}{k % 12 + 1:02d}" for k in range(a, b + 1)]


def schema_of(fields: list[str] | dict | None) -> T.StructType | None:
    """All-text schema of a list of names, or the DDL of a dict."""
    if not fields:
        return None
    if isinstance(fields, dict):
        return T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in fields.items()))
    return T.StructType([T.StructField(n, T.StringType()) for n in fields])


def read_table(spark: SparkSession, path, fmt: str | None = None, options: dict | None = None, fields=None, order: bool = False) -> DataFrame:
    """A file, folder or glob. CSV is text only, never inferred. ``order`` adds file_name and seq, a number
    that grows from row to row of a file, also where the file is read in several parts."""
    fmt = format_of(path if isinstance(path, str) else path[0], fmt)
    options = {k: "iso-8859-1" if k == "encoding" and str(v).lower() in ("latin1", "latin-1") else v for k, v in (options or {}).items()}
    reader = spark.read.format(fmt).options(**({"header": "true"} if fmt == "csv" else {}) | options)
    schema = schema_of(fields)
    if schema is not None:
        reader = reader.schema(schema)
    try:
        rows = reader.load(path)
    except Exception as e:
        if schema is not None and "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)  # an empty glob is an empty table of the declared schema
        raise
    if order:
        # parts of a file begin at least a MB apart; inside a part the lower 33 bits of the id count the task's rows
        part = F.shiftleft(F.shiftright(F.col("_metadata.file_block_start"), 20), 33)
        rows = rows.withColumns({"file_name": F.col("_metadata.file_name"), "seq": part + F.monotonically_increasing_id().bitwiseAND(2**33 - 1)})
    return rows


def write_table(rows: DataFrame, path: str, fmt: str = "parquet", partition_by=None, mode: str = "overwrite") -> None:
    """Overwrites a table; with partitions, only those that rows holds."""
    out = rows.write.format(format_of(path, fmt)).mode(mode)
    if fmt == "csv":
        out = out.option("header", "true")
    if partition_by:
        out = out.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by)).option("partitionOverwriteMode", "dynamic")
    out.save(path)


def write_arrays(rows: DataFrame, path: str, columns: list[str], records: int = 100_000) -> None:
    """Dense feature rows as float arrays in Parquet, in files of a bounded number of records."""
    rows.select(F.array(*[F.col(c).cast("float") for c in columns]).alias("x")).write.mode("overwrite").option("maxRecordsPerFile", records).parquet(path)
