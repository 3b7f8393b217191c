"""Packing by concatenate and cut: fixed windows over one long stream of token ids.

Pass 1 tokenises each document once and writes its ids with their place inside the
partition. Prefix sums over the partitions' token totals turn that place into a global
offset. Pass 2 cuts the stream every ``length`` ids; a document that crosses a cut leaves a
boundary record on both sides. All sequences but the last are full.

Plain texts are cut by the vocabulary's rules and their parts merged by its model, through a
bounded cache, so a part costs one lookup however often it occurs. Any other text is tokenised
word by word (the vocabulary's words never span white space), also through a cache; words that
are not plain go through the whole tokenizer.

Defined cases: a null or empty text is the end id alone. Very long texts are cut like any
other. Rows that share a doc_id are packed each on its own. A null doc_id stays null. An
empty table gives no pieces. Extra columns are ignored. Ties there are none: every row has its place.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Cache, worker_state, written

LENGTH, END_ID = 4096, 2
#: Bytes of the caches of words and of parts of words, in each Python worker.
CACHE_WORDS, CACHE_PARTS = 16 << 20, 64 << 20
#: Partition totals up to this many rows (24 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: What the vocabulary's own rules make of lower-case Latin-1 text: contractions, letters, single digits, the rest; white space parts them.
_LETTERS, _DIGITS = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_LETTERS}{_DIGITS}\t-\r ]+")
_PLAIN = re.compile(r"[\x21-\x7e\xa1-\xff]*")
_PLAIN_BYTES = bytes([*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0xA1, 0x100)])


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The byte-level alphabet: visible bytes stand for themselves, the others for the characters from 256 on."""
    visible, more = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}, iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(more)) for b in range(256)]


def _plain(text: str) -> bool:
    """Whether a text is printable Latin-1 and white space without anything like a special token."""
    try:
        return not text.encode("latin-1").translate(None, _PLAIN_BYTES) and "<|" not in text
    except UnicodeEncodeError:
        return False


def _caches(path: str, limit: int = CACHE_WORDS) -> tuple[Cache, Cache]:
    """Ids by part (lower-case text) and by word (bytes without white space), kept while the Python worker packs; limit: bytes of the cache of words, when it is made."""
    kept = worker_state("packing")
    if kept.get("path") == path:
        return kept["parts"], kept["words"]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer, letters = Tokenizer.from_file(path), _byte_letters()
    merge = tokenizer.model.tokenize
    pack = lambda ids: struct.pack(f"<{len(ids)}H", *ids)
    parts = Cache(lambda part: pack([t.id for t in merge(part if part.isascii() else "".join([letters[b] for b in part.encode()]))]), CACHE_PARTS)

    def word(raw: bytes) -> bytes:
        text = raw.decode("utf-8", "replace")
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(parts.__getitem__, _PARTS.findall(text.lower())))
        return pack(tokenizer.encode(text, add_special_tokens=False).ids)

    kept.update(path=path, parts=parts, words=Cache(word, limit))
    return kept["parts"], kept["words"]


def token_ids(texts, path: str, end_id: int = END_ID, limit: int = CACHE_WORDS) -> list[bytes]:
    """Each text's ids with the end id, as little-endian 16-bit numbers."""
    parts, words = (c.__getitem__ for c in _caches(path, limit))
    end, out = struct.pack("<H", end_id), []
    for text in texts:
        text = text or ""
        if _plain(text):
            out.append(b"".join(map(parts, _PARTS.findall(text.lower()))) + end)
            continue
        raw = text.encode("utf-8", "surrogatepass")
        raw = raw if b"<|" in raw else raw.lower()  # special tokens are told by their case
        out.append(b"".join(map(words, raw.split())) + end)
    return out


def _chunks(batch: pa.RecordBatch, limit: int = 2 << 20):
    """(ids, texts) of a few MB each, so that one batch of long texts stays small."""
    ids, texts, size = [], [], 0
    for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        t = t.as_py()
        ids.append(i)
        texts.append(t)
        size += len(t or "")
        if size >= limit:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def tokenised(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(pid, doc_id, local_start, doc_tokens, ids): ids as little-endian 16-bit binary, starts within pid."""
    path = path or vocabulary_path()

    def run(batches):
        pid, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for ids, texts in _chunks(batch):
                packed = token_ids(texts, path, end_id)
                counts = np.fromiter((len(p) // 2 for p in packed), np.int64, len(packed))
                starts = at + np.cumsum(counts) - counts
                at += int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), pid, np.int64)), pa.array(ids, pa.int64()), pa.array(starts), pa.array(counts), pa.array(packed, pa.binary())],
                    ["pid", "doc_id", "local_start", "doc_tokens", "ids"],
                )

    schema = "pid long, doc_id long, local_start long, doc_tokens long, ids binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, path: str | None = None, of_ids=bytes, kind: str = "binary", column: str = "ids") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ids is little-endian 16-bit binary; ``of_ids`` may turn it into something else (``kind``, ``column``).
    """
    tokens = written(tokenised(docs, path, end_id), "tokens", codec="zstd")
    totals = tokens.groupBy("pid").agg(F.sum("doc_tokens").alias("n"))
    before = W.orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = written(totals.select(F.col("pid").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("ahead")), "offsets")
    if offsets.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    placed = tokens.join(offsets, tokens.pid == offsets.p).select("doc_id", (F.col("ahead") + F.col("local_start")).alias("at"), "doc_tokens", "ids")

    names = ("doc_id", "start", "length", column, "doc_tokens", "sequence_id", "offset")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary() if kind == "binary" else pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def cut(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            doc_ids, ats, counts = (batch.column(k).to_pylist() for k in range(3))
            for d, at, n, ids in zip(doc_ids, ats, counts, batch.column(3), strict=True):
                ids, start = memoryview(ids.as_buffer()), 0
                while start < n:
                    seq, off = divmod(at + start, length)
                    m = min(length - off, n - start)
                    for col, v in zip(rows, (d, start, m, of_ids(ids[2 * start : 2 * (start + m)]), n, seq, off), strict=True):
                        col.append(v)
                    start += m
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, kinds, strict=True)], list(names))

    return placed.mapInArrow(cut, ", ".join(f"{n} {kind if n == column else 'long'}" for n in names))


def crc32_of(ids) -> int:
    """CRC-32 of 16-bit ids written as little-endian 32-bit numbers."""
    return zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4"))


def digest(docs: DataFrame, **how) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(docs, of_ids=crc32_of, kind="long", column="ids_crc32", **how)
