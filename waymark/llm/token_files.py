"""Token ids as flat binary files with 64-bit document offsets, to be memory-mapped.

A data set is a folder of shards and an index. Shard ``name`` is three files without headers, all
little-endian: ``name.ids``, the ids of its documents one after the other (16-bit unsigned, or 32-bit for
vocabularies of more than 65,536), ``name.off``, a 64-bit offset into them for each document and one
for the end, and ``name.doc``, the 64-bit doc_ids. The index is a Parquet table with a row for each
shard: its documents and ids, and how many come in the shards before it (its bases), as prefix sums
over the shards' totals. A document's place in the whole is its shard's base plus its offset.

Documents are range-sorted by doc_id (text hash and row number after it, so that one id that holds
many rows is split as well); each task encodes its range and writes it as a stream, so neither a shard nor a
document is held whole beyond a batch. A file's name has the attempt in it and counts only when the index names it: a lost or
repeated task leaves a file that nobody reads.

Defined cases: a null or empty text is the end id alone. A null doc_id counts as the largest and comes
last; it is null again when read. Rows that share a doc_id each have their own place, in the order of
their texts' hashes. Texts may be of any length. An empty table has an index without rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LAST_ID, new_path, small_batches, worker_state, written
from .packing import _chunks, token_ids, vocabulary_path

END_ID = 1
#: Bytes of text for each shard; ids read, or turned into a result, at a time.
SHARD_BYTES, READ_IDS = 64 << 20, 1 << 20
#: Bytes of the cache of words in each Python worker, if no packing made one before.
CACHE_WORDS = 64 << 20


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path (local, hdfs, s3, gs, ...) and the path in it."""
    return pafs.FileSystem.from_uri(path)


def encode(texts: list, path: str, end_id: int) -> list[bytes]:
    """Each text's ids with the end id. A vocabulary whose words end at white space goes word by word through a cache, any other text by text."""
    kept = worker_state("packing")
    if kept.get("kind") != path:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        by_word = getattr(tokenizer.model, "end_of_word_suffix", None) and tokenizer.get_vocab_size() <= 1 << 16
        kept.update(kind=path, tokenizer=None if by_word else tokenizer)
    if (tokenizer := kept["tokenizer"]) is None:
        return token_ids(texts, path, end_id, CACHE_WORDS)
    kind = id_type(tokenizer.get_vocab_size())
    return [np.array([*x.ids, end_id], kind).tobytes() for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def write_tokens(docs: DataFrame, to: str, vocabulary: str | None = None, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes docs(doc_id, text) as a data set in the folder ``to``, which all executors must reach; returns its index."""
    from tokenizers import Tokenizer

    spark, path = docs.sparkSession, vocabulary or vocabulary_path()
    small_batches(spark)
    kind = id_type(Tokenizer.from_file(path).get_vocab_size())
    width = int(kind[-1])
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("did"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.count("*").alias("docs"), F.sum(F.octet_length("text")).alias("bytes")).first()
    shards = max(1, min(size.docs, max(math.ceil((size.bytes or 0) / shard_bytes), spark.sparkContext.defaultParallelism)))
    key = ["did", "th", "row"]
    rows = rows.withColumns({"th": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    store, root = filesystem(to)
    store.create_dir(root, recursive=True)

    def write(batches):
        """One shard for each partition that has rows, and its totals."""
        store, root = filesystem(to)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"
        files, count, at = None, 0, 0
        for batch in batches:
            for ids, texts in _chunks(pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["did", "text"])):
                if files is None:
                    files = [store.open_output_stream(f"{root}/{name}.{x}") for x in ("ids", "off", "doc")]
                packed = encode(texts, path, end_id)
                sizes = np.fromiter((len(x) // width for x in packed), np.int64, len(packed))
                files[0].write(b"".join(packed))
                files[1].write((at + np.cumsum(sizes) - sizes).astype("<u8").tobytes())
                files[2].write(np.array(ids, "<i8").tobytes())
                count, at = count + len(ids), at + int(sizes.sum())
        if files is not None:
            files[1].write(np.array([at], "<u8").tobytes())
            for f in files:
                f.close()
            yield pa.RecordBatch.from_pylist([{"shard": TaskContext.get().partitionId(), "name": name, "docs": count, "tokens": at}])

    made = rows.repartitionByRange(shards, *key).sortWithinPartitions(*key).select("did", "text").mapInArrow(write, "shard long, name string, docs long, tokens long")
    made = written(made, "shards")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # a row for each shard
    ahead = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long")
    index = made.select("shard", "name", "docs", "tokens", ahead("docs").alias("docs_before"), ahead("tokens").alias("tokens_before"), F.lit(kind).alias("kind"))
    index.coalesce(1).write.parquet(f"{to}/index")
    return spark.read.schema(index.schema).parquet(f"{to}/index")


class Shard:
    """One shard's arrays: mapped into memory where the store is local, else read by ranges."""

    def __init__(self, store: pafs.FileSystem, root: str, name: str, kind: str):
        self.store, self.at, self.kinds = store, f"{root}/{name}", {"ids": kind, "off": "<u8", "doc": "<i8"}
        self.open = {}

    def read(self, part: str, start: int, end: int) -> np.ndarray:
        kind = self.kinds[part]
        if isinstance(self.store, pafs.LocalFileSystem):
            if part not in self.open:
                self.open[part] = np.memmap(f"{self.at}.{part}", kind, "r")
            return self.open[part][start:end]
        if part not in self.open:
            self.open[part] = self.store.open_input_file(f"{self.at}.{part}")
        width = int(kind[-1])
        return np.frombuffer(self.open[part].read_at((end - start) * width, start * width), kind)


def crc32_of(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4"))


def read_tokens(spark: SparkSession, path: str, of_ids=lambda ids: ids.astype("<u4").tobytes(), kind: str = "binary", column: str = "ids") -> DataFrame:
    """A row for each document of a data set: doc_id, start, n_tokens and its ids (little-endian 32-bit), or what ``of_ids`` makes of them."""
    index = spark.read.parquet(f"{path}/index")
    shards = index.count()
    to = pa.binary() if kind == "binary" else pa.int64()

    def read(batches):
        store, root = filesystem(path)
        for row in (r for b in batches for r in b.to_pylist()):
            shard, at = Shard(store, root, row["name"], row["kind"]), 0
            while at < row["docs"]:
                offsets = shard.read("off", at, min(at + 10_000, row["docs"]) + 1).astype(np.int64)
                n = max(1, int(np.searchsorted(offsets, offsets[0] + READ_IDS, "right")) - 1)  # at least one document, then as many as READ_IDS holds
                offsets = offsets[: n + 1]
                ids = shard.read("ids", int(offsets[0]), int(offsets[-1]))
                cells = [of_ids(ids[s:e]) for s, e in zip((offsets[:-1] - offsets[0]).tolist(), (offsets[1:] - offsets[0]).tolist(), strict=True)]
                doc = shard.read("doc", at, at + n)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(doc), mask=np.array(doc == LAST_ID)), pa.array(row["tokens_before"] + offsets[:-1]), pa.array(np.diff(offsets)), pa.array(cells, to)], ["doc_id", "start", "n_tokens", column])
                at += n

    return index.repartition(max(1, shards)).mapInArrow(read, f"doc_id long, start long, n_tokens long, {column} {kind}")


class Tokens:
    """A data set as a trainer reads it: any document, or any stretch of the whole, by place. Holds the index and open maps only."""

    def __init__(self, path: str):
        store, root = filesystem(path)
        self.rows = sorted(pq.read_table(f"{root}/index", filesystem=store).to_pylist(), key=lambda r: r["shard"])
        self.docs_before, self.tokens_before = (np.array([r[k] for r in self.rows], np.int64) for k in ("docs_before", "tokens_before"))
        self.shards = [Shard(store, root, r["name"], r["kind"]) for r in self.rows]

    def __len__(self) -> int:
        return self.rows[-1]["docs_before"] + self.rows[-1]["docs"] if self.rows else 0

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document of the order."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        s = int(np.searchsorted(self.docs_before, k, "right")) - 1
        own = k - self.rows[s]["docs_before"]
        a, b = self.shards[s].read("off", own, own + 2).tolist()
        return self.shards[s].read("ids", a, b)

    def stretch(self, start: int, end: int) -> np.ndarray:
        """The ids from place ``start`` up to ``end`` of the whole, across documents and shards."""
        parts, s = [], max(0, int(np.searchsorted(self.tokens_before, start, "right")) - 1)
        while s < len(self.rows) and self.rows[s]["tokens_before"] < end:
            base = self.rows[s]["tokens_before"]
            parts.append(self.shards[s].read("ids", max(0, start - base), min(end - base, self.rows[s]["tokens"])))
            s += 1
        return np.concatenate(parts) if parts else np.zeros(0, "<u2")


def digest(docs: DataFrame, to: str | None = None, **how) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    to = to or new_path(spark, "dataset")
    write_tokens(docs.select("doc_id", "text"), to, **how)
    return read_tokens(spark, to, of_ids=crc32_of, kind="long", column="ids_crc32")
