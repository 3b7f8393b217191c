"""What the corpus operators share: shared-folder tables, word rules, connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of every contract, and A-Z with a-z.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
#: The id that a null doc_id counts as: larger than any other.
LAST_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or else the context's own checkpoint folder; local masters without either get a temporary one."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    context = spark.sparkContext
    if (at := context.getCheckpointDir()) is not None:
        return at.rstrip("/")
    if not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = tempfile.mkdtemp(prefix="waymark-")
    return _own_dirs[context.applicationId]


_written: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; release() or the end of the process removes it."""
    path = f"{shared_dir(spark)}/waymark-{name}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(keep: DataFrame | None = None) -> None:
    """Removes the intermediate tables written so far, but for the files that ``keep`` reads.

    Results that were not yet written or collected need them."""
    kept = [f.partition(":")[2].lstrip("/") for f in keep.inputFiles()] if keep is not None else []
    left = []
    while _written:
        spark, path = _written.pop()
        if any(f.startswith(path.partition(":")[2].lstrip("/") or path.lstrip("/")) for f in kept):
            left.append((spark, path))
            continue
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended already
            continue
    _written.extend(left)


atexit.register(release)


class Cache(dict):
    """``make(key)``, remembered for the last ``limit`` to twice as many bytes of different keys."""

    def __init__(self, make, limit: int):
        self.make, self.limit, self.old, self.bytes = make, limit, {}, 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.bytes += len(key) + 180  # the entry and two small objects
        if self.bytes > self.limit:
            self.old, self.bytes = dict(self), 0
            self.clear()
        self[key] = value
        return value


_worker: dict[str, dict] = {}


def worker_state(owner: str) -> dict:
    """What ``owner`` keeps in this Python worker from task to task. A worker serves one operator at a time, so what others kept is freed."""
    if owner not in _worker:
        if _worker:
            _worker.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)
        _worker[owner] = {}
    return _worker[owner]


#: Bytes of a batch sent to Python; Spark's own default lets a batch of long texts grow to 64 MB, which Python holds several times.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Limits Arrow batches by bytes for this session, unless it has a tighter limit."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(name))
    if now is None or not 0 < int(now[1]) <= BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def written(df: DataFrame, name: str, *partition_by: str, codec: str = "uncompressed") -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts lineage and survives lost executors.

    Most tables hold hashes and ids, which do not compress; a codec also holds native buffers for each open file."""
    small_batches(df.sparkSession)
    path = new_path(df.sparkSession, name)
    out = df.write.option("compression", codec)
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(columns, name: str) -> str:
    """A column name that none of ``columns`` has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def range_sorted(df: DataFrame, order: list, rows: int, rows_each: int, name: str) -> DataFrame:
    """df as a table, range-sorted by the columns ``order``, with ``range``, the number of the range. At least one range for each place of the session."""
    ranges = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // rows_each))
    return written(df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()), name)


def running(ranged: DataFrame, order: list, **sums: Column) -> DataFrame:
    """What ``range_sorted`` made with a running sum (its own row included) of each expression over the whole order.

    Totals by range, a prefix sum over these (a row for each range), then running sums inside each range: no window holds all rows."""
    totals = ranged.groupBy("range").agg(*[F.sum(e).alias(k) for k, e in sums.items()])
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select(F.col("range").alias("ahead_range"), *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"ahead_{k}") for k in sums])
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = ranged.withColumns({k: F.sum(e).over(inside) for k, e in sums.items()})
    out = own.join(ahead, F.col("range") == F.col("ahead_range"))
    return out.withColumns({k: F.col(k) + F.col(f"ahead_{k}") for k in sums}).drop("ahead_range", *[f"ahead_{k}" for k in sums])


def hash2(c: Column) -> Column:
    """128 bits of a value, as two longs."""
    return F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(7), c).alias("b"))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, component): the smallest id reachable over edges (src, dst), for each id that has an edge.

    Alternates large-star and small-star rounds over the edge table; each round is one or
    two aggregations whose per-key state is a minimum, so a hub costs no more than its rows.
    Every round is a table in the shared folder. Nothing is gathered on the driver but two sums.
    """
    spark = edges.sparkSession
    now = written(
        edges.where("src is not null and dst is not null and src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct(),
        "edges",
    )
    before = None
    for _ in range(rounds):
        # large star: a node's larger neighbours move to its smallest neighbour (or itself)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        # small star: a node and its smaller neighbours move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        now = written(small, "edges")
        state = now.agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or state.n == 0:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
