"""Substring dedup by super-k-mers of words.

A window is ``window`` consecutive words. Its minimiser is the least hash among the runs of
``seed`` words in it. Consecutive windows with one minimiser travel as one packed string (the
words they span) to the minimiser's bucket, where equal windows meet whatever text is around
them; sorting a bucket's windows finds, exactly, those that start earlier elsewhere.

Equal packed strings are combined before the shuffle and again in the bucket's stream: only
the earliest one's windows are compared. A bucket with more than ``bucket_windows`` different
windows is not held by a task: a bounded number of its windows is known by 128-bit hash, the
others go on as rows and a distributed minimum decides them. Nothing is dropped or capped.

A minimiser of few words may head a large share of all windows. A sample of the documents tells
which ones would hold more than ``hot_windows`` windows; their windows are dealt by a second
minimiser of longer runs as well. What is dealt depends on the words of a window alone, so equal
windows still meet: the sample decides where work is done, never a result.

Defined cases: a null or empty text has no words. Texts of fewer words than a window keep all.
A null doc_id counts as the largest id. Rows with one doc_id and one text start at the same
places, so neither is earlier; with another text they count as the same document. An empty
table gives an empty result. Extra columns pass through
``dedup_substrings``; those with an output's name are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, Cache, worker_state, written

WINDOW, SEED = 20, 2
#: Windows that a task holds of one bucket; times so many more are known by hash before any is passed on.
BUCKET_WINDOWS, KNOWN = 20_000, 10
CACHE_BYTES = 24 << 20
#: Minimisers that would head more windows than this are split; the share of documents that are read to tell, and the slots they are counted in.
HOT_WINDOWS, SAMPLE, SLOTS = 250_000, 0.01, 1 << 20


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, through a cache that lives as long as the Python worker serves operators on words."""
    kept = worker_state("words")
    if not kept:
        kept["hash"] = Cache(xxhash.xxh64_intdigest, CACHE_BYTES)
    return np.fromiter(map(kept["hash"].__getitem__, words), np.uint64, len(words))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """A well-mixed hash of each run of k neighbouring values."""
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def slide_min(x: np.ndarray, span: int) -> np.ndarray:
    """The least of each ``span`` neighbouring values."""
    width = 1
    while 2 * width <= span:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = span - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def minimisers(h: np.ndarray, window: int, seed: int) -> np.ndarray:
    """32 bits of each window's minimiser: enough to deal by, as equal ones of different seeds only share a bucket."""
    return (slide_min(rolling(h, seed), window - seed + 1) >> np.uint64(32)).astype(np.uint32)


def super_kmers(words: list[bytes], window: int = WINDOW, seed: int = SEED, hot: np.ndarray | None = None):
    """(bucket, first window, windows, may hold a window twice) of each run of windows of one bucket.

    The bucket is the minimiser, mixed with that of longer runs of words where ``hot`` holds its slot."""
    n = len(words) - window + 1
    if n <= 0:
        return
    h = word_hashes(words)
    minis = minimisers(h, window, seed)
    if hot is not None:
        crowded = hot[minis & np.uint32(SLOTS - 1)]
        if crowded.any():
            second = minimisers(h, window, max(seed, window // 3))
            minis = np.where(crowded, (minis ^ second * np.uint32(0x9E3779B1)) * np.uint32(0x85EBCA6B), minis)
    ends = np.append(np.flatnonzero(minis[1:] != minis[:-1]) + 1, n)
    starts = np.append(0, ends[:-1])
    again = len(np.unique(rolling(h, window))) < n
    minis = minis.view(np.int32)
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        yield int(minis[s]), s, e - s, again


def _slots(window: int, seed: int):
    def run(batches):
        """How many windows each slot of minimisers has, batch by batch."""
        for batch in batches:
            n = np.zeros(SLOTS, np.int64)
            for text in batch.column(0):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                if len(words) >= window:
                    slot, times = np.unique(minimisers(word_hashes(words), window, seed) & np.uint32(SLOTS - 1), return_counts=True)
                    n[slot] += times
            slot = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(n[slot])], ["slot", "n"])

    return run


def hot_slots(docs: DataFrame, window: int, seed: int, hot_windows: int, sample: float) -> np.ndarray | None:
    """Which slots of minimisers head more than ``hot_windows`` windows, by a sample of the documents; at most SLOTS bits."""
    rows = docs.select(F.col("text").cast("string").alias("text"))
    rows = rows.sample(sample, seed=7) if sample < 1 else rows
    counts = rows.mapInArrow(_slots(window, seed), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = [r.slot for r in counts.where(F.col("n") > hot_windows * sample).select("slot").collect()]  # at most SLOTS rows
    if not found:
        return None
    hot = np.zeros(SLOTS, bool)
    hot[found] = True
    return np.packbits(hot)


#: What travels: ``at`` is the start, then whether the document may hold a window twice; ``tag`` tells apart texts of one doc_id.
#: ``packed`` is the words, or a blank and the number of windows where a copy is known already: such a row is dealt by its place.
ROW = pa.schema([("mini", pa.int32()), ("did", pa.int64()), ("at", pa.int64()), ("tag", pa.int64()), ("packed", pa.binary())])
MARK = pa.schema([("did", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
#: doc_ids with several texts are known by a hash of so many values, up to a number that is shipped to the tasks.
ID_HASHES, MOST_HASHES = 1 << 20, 2_000


def text_tag(docs: DataFrame):
    """A column that tells apart the texts of one doc_id: the text's hash where the doc_id may have several texts, else 0, which costs no bytes."""
    did, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), F.xxhash64("text")
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_HASHES)).cast("int")
    texts = docs.groupBy(did.alias("__id")).agg(F.min(text).alias("lo"), F.max(text).alias("hi")).where("lo <> hi")
    shared = [r.h for r in texts.select(spot(F.col("__id")).alias("h")).distinct().limit(MOST_HASHES + 1).collect()]
    if len(shared) > MOST_HASHES:
        return text
    return F.when(spot(did).isin(shared), text).otherwise(F.lit(0).cast("long"))


def _packer(window: int, seed: int, bits: np.ndarray | None):
    def run(batches):
        """Super-k-mers of each document; of copies inside a part of a few MB only the earliest keeps its words."""
        hot = None if bits is None else np.unpackbits(bits).astype(bool)
        first: dict[bytes, int] = {}
        cols: list[list] = [[] for _ in ROW]
        size = 0
        last, end = -1, None  # the latest mark and where it ends: neighbouring marks of a text are one row

        def flush():
            nonlocal cols, size, last, end
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, ROW, strict=True)], schema=ROW)
            cols, size, last, end = [[] for _ in ROW], 0, -1, None
            first.clear()
            return out

        for batch in batches:
            for did, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                for mini, s, n, again in super_kmers(words, window, seed, hot):
                    packed = b" ".join(words[s : s + n + window - 1])
                    key = xxhash.xxh3_128_digest(packed)
                    at = s << 1 | again
                    k = first.get(key)
                    if k is None:
                        first[key] = len(cols[0])
                        row = (mini, did, at, tag, packed)
                    else:
                        there, here = (cols[1][k], cols[2][k] >> 1), (did, s)
                        if there == here and cols[3][k] == tag:
                            continue
                        row = (mini, did, at, tag, packed)  # of two texts at one place neither is earlier
                        if here < there:  # the later one becomes the mark
                            row = (mini, cols[1][k], cols[2][k], cols[3][k], packed)
                            cols[1][k], cols[2][k], cols[3][k] = did, at, tag
                        if there != here:
                            start = row[2] >> 1
                            if end == (row[1], row[3], start):
                                end = (row[1], row[3], start + n)
                                cols[4][last] = b" %d" % (start + n - (cols[2][last] >> 1))
                                continue
                            last, end = len(cols[0]), (row[1], row[3], start + n)
                            row = (((row[1] ^ row[2]) & 0xFFFFFFFF) - (1 << 31), *row[1:4], b" %d" % n)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                    size += len(row[4]) + 60
                    if size > 8 << 20:
                        yield flush()
        yield flush()

    return run


class _Bucket:
    """The rows of one minimiser, in the order of (did, start).

    Up to ``limit`` windows are held and sorted. Beyond that, windows are looked up by 128-bit hash among the
    first ``limit * KNOWN`` different ones, which are the earliest by the order of the rows; windows that are
    none of these are passed on and can only equal each other.
    """

    def __init__(self, window: int, limit: int, out: list[list]):
        self.window, self.limit, self.out = window, limit, out
        self.reset(None)

    def reset(self, mini) -> None:
        self.mini, self.seen, self.rows, self.windows, self.known = mini, {}, [], 0, None

    def mark(self, did, tag, start, n, a=None, b=None) -> None:
        for c, v in zip(self.out, (did, tag, start, n, a, b), strict=True):
            c.append(v)

    def _each(self, did, start, n, packed):
        words = packed.split(b" ")
        for i in range(n):
            yield xxhash.xxh3_128_intdigest(b" ".join(words[i : i + self.window])), (did, start + i)

    def _look_up(self, did, tag, start, n, packed) -> None:
        known, most = self.known, self.limit * KNOWN
        for d, at in self._each(did, start, n, packed):
            first = known.get(d)
            if first is not None:
                if first != at:
                    self.mark(did, tag, at[1], 1)
            elif len(known) < most:
                known[d] = at
            else:
                self.mark(did, tag, at[1], 1, (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63))

    def add(self, did, tag, start, n, packed) -> None:
        if self.known is not None:
            return self._look_up(did, tag, start, n, packed)
        key = xxhash.xxh3_128_digest(packed)
        at = self.seen.setdefault(key, (did, start))
        if at != (did, start):
            return self.mark(did, tag, start, n)
        self.rows.append((did, tag, start, n, packed))
        self.windows += n
        if self.windows > self.limit:
            self.close()
            self.known = {}
            for did, _, start, n, packed in self.rows:
                for d, where in self._each(did, start, n, packed):
                    self.known.setdefault(d, where)
            self.rows, self.seen = [], {}
        return None

    def close(self) -> None:
        """Sorts the windows of what was held and marks all but the earliest of equal ones."""
        if len(self.rows) == 1 and self.rows[0][3] == 1:
            return
        every = []
        for k, (did, _, start, n, packed) in enumerate(self.rows):
            words = packed.split(b" ")
            every += [(b" ".join(words[i : i + self.window]), did, start + i, k) for i in range(n)]
        every.sort()
        before = first = None
        for text, did, start, k in every:
            if text != before:
                before, first = text, (did, start)
            elif (did, start) != first:
                self.mark(did, self.rows[k][1], start, 1)


def _bucketer(window: int, limit: int):
    def run(batches):
        """Rows come sorted by minimiser, did and start. A minimiser with one row has nothing to compare."""
        out: list[list] = [[] for _ in MARK]
        bucket = _Bucket(window, limit, out)

        def taken():
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, MARK, strict=True)], schema=MARK)
            for c in out:
                c.clear()
            return batch

        def known(packed):
            return np.asarray(pc.starts_with(packed, b" ").to_numpy(zero_copy_only=False), bool)

        def rows(table):
            minis = table.column(0).to_numpy()
            near = (table.column(2).to_numpy() & 1).astype(bool)
            same = minis[1:] == minis[:-1]
            near[1:] |= same
            near[:-1] |= same
            if len(minis):
                near[0] = near[-1] = True  # may belong with a neighbouring batch
            picked = table.take(pa.array(np.flatnonzero(near | known(table.column(4)))))
            yield from zip(*(c.to_pylist() for c in picked.columns), strict=True)

        for batch in batches:
            for mini, did, at, tag, packed in rows(batch):
                start = at >> 1
                if packed[:1] == b" ":
                    bucket.mark(did, tag, start, int(packed))
                    continue
                if mini != bucket.mini:
                    bucket.close()
                    bucket.reset(mini)
                bucket.add(did, tag, start, packed.count(b" ") + 2 - window, packed)
                if len(out[0]) > 100_000:
                    yield taken()
            yield taken()
        bucket.close()
        yield taken()

    return run


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def repeated_windows(docs: DataFrame, window: int = WINDOW, seed: int = SEED, bucket_windows: int = BUCKET_WINDOWS, tag=None, hot_windows: int = HOT_WINDOWS, sample: float = SAMPLE) -> DataFrame:
    """(did, tag, spans): per document (id and tag of its text), the (start, n) runs of windows that start earlier elsewhere."""
    tag = text_tag(docs) if tag is None else tag
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("did"), tag.alias("tag"), F.col("text").cast("string").alias("text"))
    hot = hot_slots(rows, window, seed, hot_windows, sample)
    packed = rows.mapInArrow(_packer(window, seed, hot), _ddl(ROW)).repartition("mini").sortWithinPartitions("mini", "did", "at")
    marks = written(packed.mapInArrow(_bucketer(window, bucket_windows), _ddl(MARK)), "marks", codec="uncompressed")
    large = marks.where("a is not null")
    first = large.groupBy("a", "b").agg(F.min(F.struct("did", "start")).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    late = large.join(first, ["a", "b"]).where(F.struct("did", "start") > F.col("first")).select("did", "tag", "start", "n")
    every = marks.where("a is null").select("did", "tag", "start", "n").unionByName(late)
    return every.groupBy("did", "tag").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def dedup_substrings(docs: DataFrame, window: int = WINDOW, text_out: str = "text", **how) -> DataFrame:
    """docs with the kept words joined by one blank as ``text_out``, plus n_words, n_removed and kept_sha256."""
    tag = text_tag(docs)
    spans = repeated_windows(docs, window, tag=tag, **how).select(F.col("did").alias("__did"), F.col("tag").alias("__tag"), F.col("spans").alias("__spans"))
    rows = docs.withColumns({"__did": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), "__tag": tag}).join(spans, ["__did", "__tag"], "left")

    @F.pandas_udf("text string, n_words long, n_removed long, sha string")
    def keep(texts, starts, lengths):
        import pandas as pd

        out = []
        for text, ss, ns in zip(texts, starts, lengths, strict=True):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            kept = words
            if ss is not None and len(ss):
                edge = np.zeros(len(words) + 1, np.int32)
                ss, ns = np.asarray(ss), np.asarray(ns)
                np.add.at(edge, ss, 1)
                np.add.at(edge, ss + ns + window - 1, -1)
                kept = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
            joined = b" ".join(kept)
            out.append((joined.decode("utf-8", "replace"), len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest()))
        return pd.DataFrame(out, columns=["text", "n_words", "n_removed", "sha"])

    rows = rows.withColumn("__k", keep("text", F.col("__spans.start"), F.col("__spans.n")))
    return rows.withColumns({text_out: F.col("__k.text"), "n_words": F.col("__k.n_words"), "n_removed": F.col("__k.n_removed"), "kept_sha256": F.col("__k.sha")}).drop("__did", "__tag", "__spans", "__k")


def digest(docs: DataFrame, **how) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    return dedup_substrings(docs.select("doc_id", "text"), **how).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), k AS (
  SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 19 <= len(ws) THEN array_to_string(ws[i : i + 19], ' ') END AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)
), f AS (
  SELECT doc_id, i, word, win IS NOT NULL AND (doc_id, i) <> (first_value((doc_id, i)) OVER (PARTITION BY win ORDER BY doc_id, i)) AS late FROM k
), g AS (
  SELECT doc_id, i, word, bool_or(late) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f
), o AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM g GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN o USING (doc_id)
"""
