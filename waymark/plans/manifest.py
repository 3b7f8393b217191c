"""Tables described by manifests: sources, one transform, renames, drops, typing, checks, a sink and its lineage.

The order is fixed: transform, rename, drop, normalise, checks, write. Columns declared in a
manifest are the enforced schema of its sources where they are texts (CSV is read as text only).
"""

from __future__ import annotations

import datetime as dt
import fnmatch
import logging
import re
from collections.abc import Callable
from inspect import signature
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import finite
from ..sources.files import read_table, write_table
from . import checks

log = logging.getLogger(__name__)
TRANSFORMS: dict[str, Callable] = {}
KINDS = {"str": "string", "float": "double", "int": "bigint", "datetime": "timestamp_ntz", "bool": "boolean"}
WHITE = r"^\s+|\s+$"


def transform(name: str):
    """Registers a function of (sources, wildcards, params), or of any part of them, that returns a DataFrame."""

    def add(fn):
        TRANSFORMS[name] = fn
        return fn

    return add


def typed(c, kind: str):
    """A text column as a kind; what does not parse is NULL. Fractions are no whole numbers."""
    if kind not in KINDS:
        raise ValueError(f"unknown type {kind}")
    if kind == "int":
        x = c.try_cast("double")
        return F.when(x == F.floor(x), x.try_cast("bigint"))
    if kind == "datetime":
        return F.try_to_timestamp(c.cast("string")).cast("timestamp_ntz")
    return finite(c.try_cast("double")) if kind == "float" else c.try_cast(KINDS[kind])


def split_column(rows: DataFrame, column: str, delimiter: str, into: dict[str, str]) -> DataFrame:
    """One text column into typed ones, appended last; the rest of the text stays in the last."""
    parts = F.split(F.col(column).cast("string"), re.escape(delimiter), len(into))
    return rows.withColumns({n: typed(F.regexp_replace(F.get(parts, F.lit(k)), WHITE, ""), kind) for k, (n, kind) in enumerate(into.items())}).drop(column)


def drop_columns(rows: DataFrame, patterns: list[str]) -> DataFrame:
    """Without the columns of these exact names or ``*`` patterns."""
    return rows.drop(*[c for c in rows.columns if any(fnmatch.fnmatchcase(c, p) for p in patterns)])


def normalise(rows: DataFrame, rules: list[dict]) -> DataFrame:
    """rules: {column, split: {delimiter, into}} or {column, strip, upper, type}."""
    for r in rules:
        c = r["column"]
        if c not in rows.columns:
            continue
        if "split" in r:
            rows = split_column(rows, c, r["split"]["delimiter"], r["split"]["into"])
            continue
        value = F.col(c)
        if r.get("strip"):
            value = F.regexp_replace(value.cast("string"), WHITE, "")
        if r.get("upper"):
            value = F.upper(value.cast("string"))
        if "type" in r:
            value = typed(value, r["type"])
        rows = rows.withColumn(c, value)
    return rows


def run_checks(rows: DataFrame, rules: list[dict]) -> None:
    """{unique: [..]} and {not_null: [..]} are errors, {range: {column, min, max}} is a warning."""
    for r in rules:
        if "unique" in r:
            checks.assert_unique(rows, r["unique"])
        if "not_null" in r:
            checks.assert_not_null(rows, r["not_null"])
        if "range" in r:
            x = r["range"]
            if n := checks.outside_range(rows, x["column"], x.get("min"), x.get("max")).first().outside:
                log.warning("%d values of %s outside [%s, %s]", n, x["column"], x.get("min"), x.get("max"))


def _clean(x):
    """Keys and texts without a byte-order mark."""
    if isinstance(x, dict):
        return {_clean(k): _clean(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_clean(v) for v in x]
    return x.replace("\ufeff", "") if isinstance(x, str) else x


def load(path: str) -> dict:
    """A manifest file in UTF-8, UTF-16 or Latin-1."""
    raw = Path(path).read_bytes()
    for encoding in ("utf-16",) if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else ("utf-8-sig", "latin-1"):
        try:
            return _clean(yaml.safe_load(raw.decode(encoding)))
        except UnicodeDecodeError:
            continue
    raise ValueError(f"cannot decode {path}")


def listed(folder: str) -> list[str]:
    return sorted(str(p) for p in Path(folder).glob("*.y*ml"))


def validate(m: dict) -> None:
    sources = m.get("sources") or []
    if not sources:
        raise ValueError("a manifest needs a source")
    if len(sources) > 1 and not m.get("transform"):
        raise ValueError("several sources need a transform")
    if m.get("transform") and m["transform"] not in TRANSFORMS:
        raise ValueError(f"no transform {m['transform']}")
    if not m.get("output"):
        raise ValueError("a manifest needs an output")


def build(spark: SparkSession, m: dict, wildcards: dict | None = None) -> DataFrame:
    """The manifest's table as a lazy plan, without its checks and its sink."""
    validate(m)
    fill = lambda p: _filled(p, wildcards)
    found = {s["name"]: read_table(spark, fill(s["path"]), s.get("format"), s.get("options"), s.get("fields")) for s in m["sources"]}
    if m.get("transform"):
        fn, given = TRANSFORMS[m["transform"]], {"sources": found, "wildcards": wildcards or {}, "params": m.get("params") or {}}
        rows = fn(**{k: v for k, v in given.items() if k in signature(fn).parameters})
        if not isinstance(rows, DataFrame):
            raise TypeError(f"transform {m['transform']} returned {type(rows).__name__}")
    else:
        rows = next(iter(found.values()))
    rows = rows.withColumnsRenamed({a: b for a, b in (m.get("rename") or {}).items() if a in rows.columns})
    return normalise(drop_columns(rows, m.get("drop") or []), m.get("normalise") or [])


def _filled(path: str, wildcards: dict | None) -> str:
    for token, value in (wildcards or {}).items():
        path = path.replace("{" + token + "}", str(value))
    return path


def execute(spark: SparkSession, path: str, wildcards: dict | None = None) -> dict:
    """Builds, checks and writes one table; the row count of the lineage comes from the write itself."""
    m = load(path)
    rows = build(spark, m, wildcards)
    run_checks(rows, m.get("checks") or [])
    seen, out = Observation(), m["output"]
    target = _filled(out["path"], wildcards)
    write_table(rows.observe(seen, F.count(F.lit(1)).alias("rows")), target, out.get("format", "parquet"), out.get("partition_by"))
    lineage = {"dataset": m.get("id"), "manifest": str(path), "written_at": dt.datetime.now(dt.UTC).isoformat(), "path": target, "rows": seen.get["rows"], "wildcards": wildcards or {}}
    if m.get("lineage"):
        at = Path(_filled(m["lineage"], wildcards))
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(yaml.safe_dump(lineage, sort_keys=False))
    return lineage
