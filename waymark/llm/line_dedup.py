"""Line dedup over levelled sorted runs of line hashes.

Lines are reduced to 128-bit key hashes once. Batches then pass in the order of doc_id: the
keys of each are merge-anti-joined with the runs (bucketed, sorted tables, so that a growing
state is never shuffled again), and those that no run holds become a run of level 0, with the
smallest doc_id of the batch as their owner. ``fanout`` runs of a level are compacted into one
of the next. In the end each key is in one run, and the lines whose owner is another document go.

A run has as many buckets as the table's lines ask for, each one file. Keys with more than
one in ``HOT_SHARE`` of all lines (fewer than that many can have that; a bounded sample finds
them) meet their owner by broadcast, so a very common line is no hot task; the others by shuffle.

Defined cases: a null or empty text is one empty line. Keys under ``min_chars`` code points
never count. A null doc_id counts as the largest id. Rows that share a doc_id are one
document for ownership and each keeps its own row. An empty table gives an empty result. Lines
and texts may be of any length. Extra columns pass through ``dedup_lines``; those with an
output's name are replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, LAST_ID, hash2, lower_ascii, new_path, remove, written

MIN_CHARS, BATCHES, FANOUT = 10, 4, 2
#: Lines for each bucket of a run, and the most buckets that Spark allows.
BUCKET_LINES, MOST_BUCKETS = 2_000_000, 100_000
#: A line is hot with more than one in so many of a sample of at most so many lines.
HOT_SHARE, HOT_SAMPLE = 10_000, 1_000_000
#: Hashes do not compress; a codec would only hold native buffers for every open file.
CODEC = "uncompressed"


def line_key(line):
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


class LineRuns:
    """Runs of line keys (a, b, owner), each one a bucketed and sorted table, by level."""

    def __init__(self, spark, buckets: int, fanout: int = FANOUT):
        self.spark, self.buckets, self.fanout, self.levels = spark, buckets, fanout, {}

    def _write(self, keys: DataFrame) -> tuple[str, str]:
        name, path = f"line_run_{uuid.uuid4().hex[:12]}", new_path(self.spark, "run")
        bucket = F.pmod(F.hash("a", "b"), F.lit(self.buckets))  # what bucketBy deals by: one task, and so one file, for each
        (
            keys.select("a", "b", "owner").repartition(self.buckets, bucket)
            .write.bucketBy(self.buckets, "a", "b").sortBy("a", "b").option("compression", CODEC).option("path", path).saveAsTable(name)
        )
        return name, path

    def _drop(self, run: tuple[str, str]) -> None:
        self.spark.sql(f"drop table if exists {run[0]}")
        remove(self.spark, run[1])

    @property
    def runs(self) -> list[tuple[str, str]]:
        return [run for level in sorted(self.levels, reverse=True) for run in self.levels[level]]

    def _union(self, runs) -> DataFrame:
        every = self.spark.table(runs[0][0])
        for name, _ in runs[1:]:
            every = every.unionByName(self.spark.table(name))
        return every

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Rows of keys whose (a, b) no run holds: one merge anti-join for each run."""
        for name, _ in self.runs:
            keys = keys.join(self.spark.table(name).select("a", "b").hint("merge"), ["a", "b"], "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """The keys that no run holds, as a new run of level 0; full levels are merged into one run of the next level."""
        self.levels.setdefault(0, []).append(self._write(self.unseen(keys)))
        level = 0
        while len(self.levels.get(level, [])) >= self.fanout:
            old = self.levels.pop(level)
            self.levels.setdefault(level + 1, []).append(self._write(self._union(old)))
            for run in old:
                self._drop(run)
            level += 1

    def owners(self) -> DataFrame:
        """(a, b, owner) of every key added so far; each is in one run."""
        return self._union(self.runs)

    def close(self) -> None:
        for run in self.runs:
            self._drop(run)
        self.levels = {}


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT, buckets: int | None = None, hot_share: int = HOT_SHARE) -> DataFrame:
    """(did, th, drops): for each document (id and text hash) the sorted 0-based positions of lines that go."""
    spark = docs.sparkSession
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("did"), F.col("text"))
    cuts = [c for c in dict.fromkeys(ids.approxQuantile("did", [i / batches for i in range(1, batches)], 0.001))] if batches > 1 else []
    batch = sum(((F.col("did") > F.lit(int(c))).cast("int") for c in cuts), F.lit(0))
    lines = (
        ids.select("did", F.xxhash64("text").alias("th"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
        .select("did", "th", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("did", "th", "pos", hash2(F.col("key")).alias("h"), batch.alias("batch"))
        .select("did", "th", "pos", "h.a", "h.b", "batch")
    )
    lines = written(lines, "lines", "batch", codec=CODEC)
    count = lines.count()
    runs = LineRuns(spark, buckets or min(MOST_BUCKETS, max(spark.sparkContext.defaultParallelism, -(-count // BUCKET_LINES))), fanout)
    for k in range(len(cuts) + 1):
        runs.add(lines.where(F.col("batch") == k).groupBy("a", "b").agg(F.min("did").alias("owner")))
    every = -(-count // HOT_SAMPLE)
    sample = lines.where(F.pmod(F.xxhash64("did", "pos"), F.lit(max(1, every))) == 0)
    hot = written(sample.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") > max(1, count // max(1, every) // hot_share)).select("a", "b"), "hot", codec=CODEC)
    owners, away = runs.owners(), F.col("did") != F.col("owner")
    hot_owners = written(owners.join(F.broadcast(hot), ["a", "b"]), "hotowners", codec=CODEC)
    common = lines.join(F.broadcast(hot_owners), ["a", "b"]).where(away).select("did", "th", "pos")
    others = lines.join(F.broadcast(hot), ["a", "b"], "left_anti").join(owners.hint("merge"), ["a", "b"]).where(away).select("did", "th", "pos")
    drops = written(others.unionByName(common), "drops", codec=CODEC)
    runs.close()
    return drops.groupBy("did", "th").agg(F.sort_array(F.collect_set("pos")).alias("drops"))


def dedup_lines(docs: DataFrame, text_out: str = "text", **how) -> DataFrame:
    """docs with the kept lines as ``text_out``, plus n_lines and n_dropped (both long)."""
    drops = dropped_lines(docs, **how)
    d, th = "__did", "__th"
    rows = docs.withColumns({d: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), th: F.xxhash64("text")})
    drops = drops.select(F.col("did").alias(d), F.col("th").alias(th), F.col("drops").alias("__drops"))
    rows = rows.join(drops, [d, th], "left").withColumns({"__lines": F.split(F.coalesce("text", F.lit("")), "\n"), "__m": F.coalesce(F.size("__drops"), F.lit(0))})
    # the lines between two dropped positions are one slice: linear in the lines of a document
    start = lambda i: F.when(i == 0, 1).otherwise(F.get("__drops", i - 1) + 2)
    end = lambda i: F.coalesce(F.get("__drops", i), F.size("__lines"))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.col("__m")), lambda i: F.slice("__lines", start(i), end(i) - start(i) + 1)))
    text = F.when(F.coalesce(F.size("__drops"), F.lit(0)) <= 0, F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n"))
    return rows.withColumns({text_out: text, "n_lines": F.size("__lines").cast("long"), "n_dropped": F.greatest("__m", F.lit(0)).cast("long")}).drop(d, th, "__drops", "__lines", "__m")


def digest(docs: DataFrame, **how) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256."""
    out = dedup_lines(docs.select("doc_id", "text"), text_out="kept", **how)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: A chr(10)-split, trimmed and lower-cased line of at least 10 code points belongs to the smallest doc_id that holds it.
ORACLE = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), o AS (
  SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), m AS (
  SELECT k.*, o.owner IS NOT NULL AND o.owner <> k.doc_id AS gone FROM k LEFT JOIN o ON k.key = o.key AND length(k.key) >= 10
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
