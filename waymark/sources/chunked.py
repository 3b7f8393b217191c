"""A data source for services that give hourly values of a few stations at a time.

``spark.read.format("station_chunks")`` plans one partition for each chunk of stations; a task asks the service for its
chunk, tries again where that fails, and checks what comes back. Options: ``stations`` (ids, separated by commas), ``first`` and
``last`` (days, both included), ``chunk`` (stations of a request), ``retries``, ``wait`` (seconds before the next try, doubled each time)
and ``fetch``, the function that asks: ``module:function``, called as fetch(stations, first, last, options) and giving (op_id, time, value) rows.
"""

from __future__ import annotations

import calendar
import datetime as dt
import importlib
import time

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import month

SCHEMA = "op_id bigint, time timestamp_ntz, value double"
CHUNK, RETRIES, WAIT = 100, 3, 1.0


def day_range(first_month: str, last_month: str) -> tuple[dt.date, dt.date]:
    """From the day before the first month to the day after the last one, so that every hour has a neighbour."""
    a, b = month(first_month), month(last_month)
    start = dt.date(int(a[:4]), int(a[4:]), 1)
    end = dt.date(int(b[:4]), int(b[4:]), calendar.monthrange(int(b[:4]), int(b[4:]))[1])
    if start > end:
        raise ValueError(f"{first_month} is after {last_month}")
    return start - dt.timedelta(days=1), end + dt.timedelta(days=1)


class Chunk(InputPartition):
    def __init__(self, stations: list[int]):
        super().__init__(stations)
        self.stations = stations


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        self.stations = sorted({int(s) for s in self.options["stations"].split(",") if s.strip()})
        self.first, self.last = (dt.date.fromisoformat(self.options[k]) for k in ("first", "last"))

    def partitions(self):
        size = int(self.options.get("chunk", CHUNK))
        return [Chunk(self.stations[k : k + size]) for k in range(0, len(self.stations), size)]

    def read(self, partition):
        if partition is None:  # no stations, no partitions
            return
        module, _, name = self.options["fetch"].partition(":")
        fetch = getattr(importlib.import_module(module), name)
        tries, wait = 1 + int(self.options.get("retries", RETRIES)), float(self.options.get("wait", WAIT))
        for k in range(tries):
            try:
                rows = list(fetch(partition.stations, self.first, self.last, self.options))
                break
            except Exception as e:  # noqa: BLE001  whatever a service may raise is tried again
                if k + 1 == tries:
                    raise RuntimeError(f"stations {partition.stations}: no answer in {tries} tries") from e
                time.sleep(wait * 2**k)
        asked = set(partition.stations)
        for op_id, at, value in rows:
            if op_id not in asked or not self.first <= at.date() <= self.last:
                raise ValueError(f"the service gave station {op_id} at {at}, which was not asked for")
            yield op_id, at, value


class StationChunks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "station_chunks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_chunks(spark: SparkSession, stations: list[int], first: dt.date, last: dt.date, fetch: str, **options):
    """(op_id, time, value) of the stations and days, as the source gives them."""
    spark.dataSource.register(StationChunks)
    given = {"stations": ",".join(map(str, stations)), "first": first.isoformat(), "last": last.isoformat(), "fetch": fetch} | {k: str(v) for k, v in options.items()}
    return spark.read.format("station_chunks").options(**given).load()


def from_folder(stations, first: dt.date, last: dt.date, options: dict):
    """A stand-in for a service: a folder of Parquet (op_id, time, value) by station, in any store that Arrow opens."""
    import pyarrow.dataset as ds
    import pyarrow.fs as pafs

    store, root = pafs.FileSystem.from_uri(options["folder"])
    for s in stations:
        at = f"{root}/station={s}"
        if store.get_file_info(at).type == pafs.FileType.NotFound:
            continue
        rows = ds.dataset(at, filesystem=store, format="parquet").to_table(columns=["time", "value"]).to_pylist()
        yield from ((s, r["time"], r["value"]) for r in rows if first <= r["time"].date() <= last)
