"""Fill-in-the-middle: documents cut at line ends into prefix, middle and suffix, found by rank and select.

A batch of texts is one stretch of bytes. One packed bit vector marks the last byte of every
line, another the first byte of every code point; each has a directory of the ones ahead of
every block of 512 bits. The ones between a text's ends are its number of lines n; two ranks
drawn from the hash of its id are selected to give the two byte cuts; code points are counted
by rank as well. No text is split into lines, and nothing is sought in it but the sentinels.

Lines are ``[^\\n]*\\n|[^\\n]+``. The draws are the first four 32-bit groups of sha256("seed:doc_id"):
the prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) lines, the middle after the
larger, h3 decides whether the text is transformed, h4 which of the two orders it gets.

Defined cases: a null or empty text has no line, and is plain with an empty output. A text that holds a
sentinel stays plain, so that every output can be undone. A null doc_id draws as the largest id. Rows
that share a doc_id share the draws, not the cuts. Texts may be of any length. An empty
table gives an empty result. Extra columns pass through; those with an output's name are replaced.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, fresh, small_batches

#: The sentinels, the seed, and the shares (in percent) of transformed texts and of these in suffix-first order.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = 7, 100, 50
BLOCK_WORDS = 8  # 64-bit words of a block of the directory


class Bits:
    """A packed bit vector that answers rank and select through the number of ones ahead of each block."""

    def __init__(self, marks: np.ndarray):
        blocks = len(marks) // (64 * BLOCK_WORDS) + 1  # one more bit than marks has a place, for the rank of the end
        raw = np.zeros(blocks * 8 * BLOCK_WORDS, np.uint8)
        bits = np.packbits(marks, bitorder="little")
        raw[: len(bits)] = bits
        self.words = raw.view("<u8").reshape(blocks, BLOCK_WORDS)
        ones = np.bitwise_count(self.words).sum(1, dtype=np.int64)
        self.ahead = np.concatenate([[0], np.cumsum(ones)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many ones lie before each place."""
        block, inside = np.divmod(at, 64 * BLOCK_WORDS)
        word, bit = np.divmod(inside, 64)
        counts = np.bitwise_count(self.words[block]).astype(np.int64)
        whole = np.where(np.arange(BLOCK_WORDS) < word[:, None], counts, 0).sum(1)
        below = (np.uint64(1) << bit.astype(np.uint64)) - np.uint64(1)
        return self.ahead[block] + whole + np.bitwise_count(self.words[block, word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of each k-th one, k from 1."""
        block = np.searchsorted(self.ahead, k, "left") - 1
        left = k - self.ahead[block]
        upto = np.cumsum(np.bitwise_count(self.words[block]), axis=1, dtype=np.int64)
        word = (upto < left[:, None]).sum(1)
        left = left - np.where(word > 0, np.take_along_axis(upto, np.maximum(word - 1, 0)[:, None], 1)[:, 0], 0)
        own = self.words[block, word]
        bits = (own[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        bit = (np.cumsum(bits, axis=1) < left[:, None]).sum(1)
        return block * (64 * BLOCK_WORDS) + word * 64 + bit


def draws(doc_id: int | None, seed: int) -> tuple[int, ...]:
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{LAST_ID if doc_id is None else doc_id}".encode()).digest()[:16])


def cut_batch(ids: pa.Array, texts: pa.Array, seed: int, rate: int, spm: int) -> dict[str, list]:
    """n, form, prefix_chars, middle_chars and output (bytes) of each text."""
    flat = pc.fill_null(texts.cast(pa.large_binary()), b"")
    ends = np.frombuffer(flat.buffers()[1], "<i8")[flat.offset : flat.offset + len(flat) + 1]
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    starts, ends = ends[:-1] - ends[0], ends[1:] - ends[0]
    line_ends = data == 10
    line_ends[ends[ends > starts] - 1] = True
    lines, chars = Bits(line_ends), Bits((data & 0xC0) != 0x80)
    base = lines.rank(starts)
    n = lines.rank(ends) - base
    h = np.array([draws(d, seed) for d in ids.to_pylist()], np.int64).reshape(-1, 4)
    first, second = h[:, 0] % (n + 1), h[:, 1] % (n + 1)

    def cut(k):
        return np.where(k > 0, lines.select(np.maximum(base + k, 1)) + 1 if lines.ahead[-1] else 0, starts)

    one, two = cut(np.minimum(first, second)), cut(np.maximum(first, second))
    in_prefix, in_middle = chars.rank(one) - chars.rank(starts), chars.rank(two) - chars.rank(one)
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    out: dict[str, list] = {"n": n.tolist(), "form": [], "prefix_chars": [], "middle_chars": [], "output": []}
    raw = memoryview(data)
    for k, (start, a, b, end) in enumerate(zip(starts.tolist(), one.tolist(), two.tolist(), ends.tolist(), strict=True)):
        text = bytes(raw[start:end])
        form = "plain" if not text or h[k, 2] % 100 >= rate or any(x in text for x in (p, s, m)) else "spm" if h[k, 3] % 100 < spm else "psm"
        a, b = a - start, b - start
        out["form"].append(form)
        out["prefix_chars"].append(None if form == "plain" else int(in_prefix[k]))
        out["middle_chars"].append(None if form == "plain" else int(in_middle[k]))
        out["output"].append(text if form == "plain" else b"".join([p, text[:a], s, text[b:], m, text[a:b]] if form == "psm" else [s, text[b:], p, text[:a], m, text[a:b]]))
    return out


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """docs(doc_id, text, ...) with n, form, prefix_chars, middle_chars and output."""
    small_batches(docs.sparkSession)
    kinds = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}

    @F.arrow_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def cut(ids: pa.Array, texts: pa.Array) -> pa.Array:
        out = cut_batch(ids, texts, seed, rate, spm)
        text = pa.array(out.pop("output"), pa.binary()).view(pa.string())
        return pa.StructArray.from_arrays([*(pa.array(v, kinds[k]) for k, v in out.items()), text], names=list(kinds))

    own = fresh(docs.columns, "fim")
    found = docs.withColumn(own, cut(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return found.select(*[c for c in docs.columns if c not in kinds], *[F.col(own)[k].alias(k) for k in kinds])


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Its sentinels are the first of their kind, as the text has none."""

    def between(after: Column, until: Column | None = None) -> Column:
        return F.substr(output, after, until - after) if until is not None else F.substr(output, after)

    start = F.lit(len(PREFIX) + 1)
    p, s, m = (F.instr(output, x) for x in (PREFIX, SUFFIX, MIDDLE))
    skip = len(MIDDLE)
    psm = F.concat(between(start, s), between(m + skip), between(s + skip, m))
    spm = F.concat(between(p + skip, m), between(m + skip), between(start, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(docs: DataFrame, **how) -> DataFrame:
    """Per document: doc_id, n, form, prefix_chars, middle_chars, and the hashes of the output and of the text rebuilt from it."""
    out = fill_in_middle(docs.select("doc_id", "text"), **how)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), E'[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(doc_id, 9223372036854775807)) AS h
  FROM documents
), k AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS k1, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS k2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM d
), c AS (
  SELECT doc_id, n, t, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(u[1:least(k1, k2)], '') AS p, array_to_string(u[least(k1, k2) + 1:greatest(k1, k2)], '') AS m, array_to_string(u[greatest(k1, k2) + 1:], '') AS s
  FROM k
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""
