"""MinHash near-dedup by a multi-index Hamming join.

A document's set of word shingles becomes a signature of ``SYMBOLS`` symbols of 16 bits (the
low bits of as many minima). Two signatures at a Hamming distance of at most ``DISTANCE``
symbols have, by the pigeonhole, a chunk of ``CHUNK`` symbols with at most ``ERRORS`` (1) errors.
Each chunk is filed once for every symbol that may be wrong, so all pairs within the distance
meet in a bucket; that guarantee holds for every bucket size. A pair at similarity 0.8 is
within the distance with a probability of 0.9998.

Equal sets are one class first. Then, instead of all pairs of a bucket:
1. every member is paired with the bucket's smallest class (a distributed minimum, so a hot
   bucket is no hot task), pairs within the distance are confirmed on full sets, and the links
   give components. Pairs are dealt by their smaller class in parts of about ``PART``, so a
   text that many are paired with travels once for each part, and is held while the others pass;
2. buckets that still hold several components are compared across components only, members of
   the bucket's largest component against the rest, in cells of bounded weight (shingles, not
   documents). A first pass over signatures finds the members of a cell that have a partner
   at all; only these bring their texts, and pairs are confirmed inside the cell, which
   returns links between components. So no pair within the distance stays unchecked unless it
   is connected already, and no list of pairs is ever a row.
Before sets are compared, a pair takes a second look: its distance in a signature of ``LONG``
4-bit symbols, which a pair at similarity 0.8 exceeds with a probability of 0.00005.

Defined cases: a null text, or one without words, has an empty set: n_shingles 0, linked with
nothing, kept. Fewer words than a shingle: the whole sequence is the one shingle. A null
doc_id counts as the largest id. Rows that share a doc_id have their own sets and links. Ties
go to the smallest doc_id. An empty table gives an empty result. Texts may be of any length. Extra columns pass through
``deduplicate``; those with an output's name are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, components, written
from .substring_dedup import rolling, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
CHUNKS, CHUNK, ERRORS = 12, 5, 1
SYMBOLS, DISTANCE = CHUNKS * CHUNK, CHUNKS * (ERRORS + 1) - 1
#: The weight of one side of a cell: shingles, and so many more for each document. Partners of a text in one part.
BLOCK, ROW_WEIGHT, PART = 400_000, 100, 256
#: The second look: 4-bit symbols of more minima. At similarity 0.8 a pair has 48 wrong ones (deviation 6.2), at 0.65 84.
LONG, LONG_DISTANCE = 256, 73
_random = np.random.default_rng(20_240_601)
_MUL = (_random.integers(0, 2**31, SYMBOLS, np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_ADD = _random.integers(0, 2**32, SYMBOLS, np.uint64).astype(np.uint32)[:, None]
_SALT = _random.integers(0, 2**63, CHUNKS * CHUNK, np.uint64)
_LONG_MUL = (_random.integers(0, 2**31, LONG, np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_LONG_ADD = _random.integers(0, 2**32, LONG, np.uint64).astype(np.uint32)[:, None]
_NIBBLES = np.array([((b & 15) > 0) + ((b >> 4) > 0) for b in range(256)], np.uint8)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's k-word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    return np.unique(rolling(h, min(k, len(h))))


def _minima(shingles: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    x, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full(len(mul), 2**32 - 1, np.uint32)
    step = 2**17 // len(mul)
    for at in range(0, len(x), step):
        np.minimum(least, (x[None, at : at + step] * mul + add).min(1), out=least)
    return least * np.uint32(0x9E3779B1)


def signature(shingles: np.ndarray) -> bytes:
    return (_minima(shingles, _MUL, _ADD) >> np.uint32(16)).astype("<u2").tobytes()


def long_signature(shingles: np.ndarray) -> bytes:
    half = (_minima(shingles, _LONG_MUL, _LONG_ADD) >> np.uint32(28)).astype(np.uint8)
    return (half[::2] << 4 | half[1::2]).tobytes()


def long_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _NIBBLES[a ^ b].sum(-1, dtype=np.int32)


def _signed(k: int):
    kinds = [("did", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("sig", pa.binary())]

    def run(batches):
        for batch in batches:
            n, a, b, sigs = [], [], [], []
            for text in batch.column(2):
                s = shingle_set(text.as_py(), k)
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                a.append((d >> 64) - (1 << 63))
                b.append((d & (1 << 64) - 1) - (1 << 63))
                sigs.append(signature(s) if len(s) else None)
            cols = [batch.column(0), batch.column(1), *(pa.array(v, t) for v, (_, t) in zip((n, a, b, sigs), kinds[2:], strict=True))]
            yield pa.RecordBatch.from_arrays(cols, [name for name, _ in kinds])

    return run, "did long, th long, n long, a long, b long, sig binary"


def chunk_keys(sigs: np.ndarray) -> np.ndarray:
    """(rows, CHUNKS * CHUNK) keys: for each chunk and each symbol left out, the other symbols as one number."""
    parts = sigs.reshape(len(sigs), CHUNKS, CHUNK).astype(np.uint64)
    out = np.empty((len(sigs), CHUNKS, CHUNK), np.uint64)
    for j in range(CHUNK):
        key = np.zeros((len(sigs), CHUNKS), np.uint64)
        for i in range(CHUNK):
            if i != j:
                key = (key << np.uint64(16)) | parts[:, :, i]
        out[:, :, j] = key
    out = out.reshape(len(sigs), -1) ^ _SALT
    out *= np.uint64(0x9E3779B97F4A7C15)
    return (out ^ (out >> np.uint64(31))).view(np.int64)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, SYMBOLS)


def _keys(batches):
    """(key, cid, comp, n, slot) for each row (cid, comp, n, sig)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            keys = chunk_keys(_matrix(part.column(3)))
            m = keys.shape[1]
            rep = lambda c: pa.array(np.repeat(c.to_numpy(zero_copy_only=False), m))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(rep(part.column(k)) for k in range(3)), pa.array(np.tile(np.arange(m, dtype=np.int32), len(keys)))], ["key", "cid", "comp", "n", "slot"])


KEYS = "key long, cid long, comp long, n long, slot int"


def _grouped(batches, width: int):
    """(key, rows) for runs of rows with equal first ``width`` columns."""
    held: list[tuple] = []
    now = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:width] != now:
                if held:
                    yield now, held
                held, now = [], row[:width]
            held.append(row[width:])
    if held:
        yield now, held


class _Cell:
    """The signatures of a cell's members: (cid, comp, slot, role, sig, long). Role 0: largest component, 1: others at home, 2: others to compare with."""

    def __init__(self, rows):
        cid, comp, slot, role, sig, long = zip(*rows, strict=True)
        self.cid, self.comp, self.slot, self.role = map(np.asarray, (cid, comp, slot, role))
        self.sigs = np.frombuffer(b"".join(sig), "<u2").reshape(-1, SYMBOLS)
        self.long = np.frombuffer(b"".join(long), np.uint8).reshape(-1, LONG // 2)
        self.left, self.right = np.flatnonzero(self.role != 2), np.flatnonzero(self.role == 2)

    def partners(self, y: int) -> np.ndarray:
        """The members at home within the distances of y, of other components, whose first bucket in common is this one."""
        cid, comp = self.cid, self.comp
        fits = self.left[(comp[self.left] != comp[y]) & ((self.role[self.left] == 0) | (cid[self.left] < cid[y]))]
        fits = fits[long_distance(self.long[fits], self.long[y]) <= LONG_DISTANCE]
        same = self.sigs[fits] == self.sigs[y]
        near = same.sum(1) >= SYMBOLS - DISTANCE
        fits, same = fits[near], same[near].reshape(-1, CHUNKS, CHUNK)
        good = same.sum(2) >= CHUNK - ERRORS
        first = good.argmax(1)
        mine = np.take_along_axis(same, first[:, None, None], 1)[:, 0, :]
        return fits[first * CHUNK + np.where(mine.all(1), 0, (~mine).argmax(1)) == self.slot[y]]


CELL = ("key", "i", "j")
MEMBERS = "key long, i int, j int, role int, cid long, comp long, slot int, sig binary, long binary"


def _with_partners(batches):
    """The members of each cell that have a partner in it. Rows come sorted by cell."""
    for (key, i, j), rows in _grouped(batches, 3):
        cell = _Cell([(cid, comp, slot, role, sig, long) for role, cid, comp, slot, sig, long in rows])
        found = [np.append(f, y) for y in cell.right.tolist() if len(f := cell.partners(y))]
        used = [rows[k] for k in np.unique(np.concatenate(found)).tolist()] if found else []
        cols = list(zip(*used, strict=True)) if used else [[]] * 6
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        head = [pa.array([v] * len(used), t) for v, t in ((key, pa.int64()), (i, pa.int32()), (j, pa.int32()))]
        yield pa.RecordBatch.from_arrays([*head, *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [*CELL, "role", "cid", "comp", "slot", "sig", "long"])


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm_cells(k: int, percent: int):
    def run(batches):
        """Links (src, dst) between the components of each cell; pairs that are connected already are skipped."""
        for _, rows in _grouped(batches, 3):
            cell = _Cell([row[1:4] + (row[0],) + row[4:6] for row in rows])
            sets = [shingle_set(row[6], k) for row in rows]
            names, root = np.unique(cell.comp, return_inverse=True)
            parent = list(range(len(names)))

            def top(c):
                while parent[c] != c:  # noqa: B023
                    parent[c] = c = parent[parent[c]]  # noqa: B023
                return c

            src, dst = [], []
            for y in cell.right.tolist():
                for x in cell.partners(y).tolist():
                    one, other = top(root[x]), top(root[y])
                    if one != other and _similar(sets[x], sets[y], percent):
                        parent[one] = other
                        src.append(min(int(cell.cid[x]), int(cell.cid[y])))
                        dst.append(max(int(cell.cid[x]), int(cell.cid[y])))
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return run


def _confirm(k: int, percent: int):
    def run(batches):
        """Rows (x, parts, part, kind, y, text), sorted; x's own text comes first, as kind 0."""
        own = None
        for batch in batches:
            src, dst = [], []
            for x, kind, y, text in zip(*(batch.column(c).to_pylist() for c in (0, 3, 4)), batch.column(5), strict=True):
                found = shingle_set(text.as_py(), k)
                if kind == 0:
                    own = found
                elif _similar(own, found, percent):
                    src.append(x)
                    dst.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return run


def _links(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (x, y, parts) of classes whose full sets are similar enough, as (src, dst)."""
    by = ["x", "parts", "part"]
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("y"), F.col("parts")).cast("int"))
    text = _shuffled(texts.select("cid", "text"))
    hosts = pairs.select(*by).distinct().join(text.withColumnRenamed("cid", "x"), "x").select(*by, F.lit(0).alias("kind"), F.col("x").alias("y"), "text")
    guests = pairs.join(text.withColumnRenamed("cid", "y"), "y").select(*by, F.lit(1).alias("kind"), "y", "text")
    full = hosts.unionByName(guests).repartition(*by).sortWithinPartitions(*by, "kind")
    return written(full.mapInArrow(_confirm(k, percent), "src long, dst long"), "links")


def _shuffled(side: DataFrame) -> DataFrame:
    """For joins whose sides grow with the documents: by shuffle at every size, never by broadcast."""
    return side.hint("merge")


def _close(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs within the distance of the second look whose set sizes allow the similarity."""
    side = lambda c: _shuffled(texts.select(F.col("cid").alias(c), F.col("n").alias(f"n_{c}"), F.col("long").alias(f"long_{c}")))
    both = pairs.join(side("x"), "x").join(side("y"), "y").where("100 * least(n_x, n_y) >= %d * greatest(n_x, n_y)" % percent)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(b.num_rows, -1) for k in (2, 3))
                yield b.select(["x", "y", "parts"]).filter(pa.array(long_distance(x, y) <= LONG_DISTANCE))

    return both.select("x", "y", "long_x", "long_y", "parts").mapInArrow(run, "x long, y long, parts int")


def _class_texts(active: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(cid, n, text, long) of the classes that have a candidate: a text, and the signature for the second look."""
    owners = active.select("cid", F.col("owner").alias("did"), F.col("oth").alias("th"))
    texts = rows.join(_shuffled(owners), ["did", "th"]).groupBy("cid").agg(F.first("text").alias("text"))

    def run(batches):
        for b in batches:
            sizes, longs = [], []
            for t in b.column(1):  # one set at a time
                x = shingle_set(t.as_py(), k)
                sizes.append(len(x))
                longs.append(long_signature(x))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), b.column(1), pa.array(longs, pa.binary())], ["cid", "n", "text", "long"])

    return texts.mapInArrow(run, "cid long, n long, text string, long binary")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(did, th, n, component, grp): for each document (id and text hash) its set size, smallest reachable id, and a number of its linked group, null without shingles."""
    percent = round(100 * similarity)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("did"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    run, schema = _signed(shingle)
    signed = written(rows.mapInArrow(run, schema), "signed")
    classes = signed.where("n > 0").groupBy("a", "b").agg(F.min(F.struct("did", "th")).alias("o"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("cid"), "a", "b", F.col("o.did").alias("owner"), F.col("o.th").alias("oth"), "n", "sig"), "classes")
    # 1. each member of a bucket with the smallest of its bucket
    alone = classes.select("cid", F.lit(0).cast("long").alias("comp"), "n", "sig")
    keys = alone.mapInArrow(_keys, KEYS)
    low = keys.groupBy("key").agg(F.min("cid").alias("low"), F.max("cid").alias("high"), F.count("*").alias("m")).where("m > 1")
    low = written(low, "low")
    parts = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("m") / PART, F.lit(1))))).cast("int").alias("parts")  # a power of two: few different ones for one x
    two = low.where("m = 2").select(F.col("low").alias("x"), F.col("high").alias("y"), parts)
    more = keys.select("key", "cid").join(_shuffled(low.where("m > 2").select("key", "low", "m")), "key").where("cid > low").select(F.col("low").alias("x"), F.col("cid").alias("y"), parts)
    pairs = written(two.unionByName(more).groupBy("x", "y").agg(F.max("parts").alias("parts")), "pairs")
    active = pairs.select(F.explode(F.array("x", "y")).alias("cid")).distinct()
    active = written(classes.join(_shuffled(active), "cid", "left_semi"), "active")
    texts = written(_class_texts(active, rows, shingle), "texts")
    links = _links(_close(pairs, texts, percent), texts, shingle, percent)
    comps = components(links)
    # 2. across components, in buckets that hold several
    placed = active.join(_shuffled(comps.withColumnRenamed("id", "cid")), "cid", "left").select("cid", F.coalesce("component", "cid").alias("comp"), "n", "sig")
    open_rows = placed.mapInArrow(_keys, KEYS)
    shares = open_rows.groupBy("key", "comp").agg(F.sum(F.col("n") + ROW_WEIGHT).alias("w"))
    mixed = shares.groupBy("key").agg(F.sum("w").alias("total"), F.count("*").alias("comps"), F.max(F.struct("w", "comp")).alias("top")).where("comps > 1")
    hosts, others = F.ceil(F.col("total") / block).cast("int"), F.ceil((F.col("total") - F.col("top.w")) / block).cast("int")
    mixed = mixed.select("key", hosts.alias("hosts"), others.alias("others"), F.col("top.comp").alias("major"))
    cell = open_rows.join(_shuffled(mixed), "key")
    home = F.pmod(F.xxhash64("cid"), F.col("hosts")).cast("int")
    seat = F.pmod(F.xxhash64(F.lit(1), "cid"), F.col("others")).cast("int")
    span = lambda n: F.sequence(F.lit(0), n - 1)
    at_home = F.transform(span(F.col("others")), lambda j: F.struct(home.alias("i"), j.alias("j"), F.when(F.col("comp") == F.col("major"), 0).otherwise(1).alias("role")))
    visits = F.transform(span(F.col("hosts")), lambda i: F.struct(i.alias("i"), seat.alias("j"), F.lit(2).alias("role")))
    cell = cell.select("key", "cid", "comp", "slot", F.explode(F.when(F.col("comp") == F.col("major"), at_home).otherwise(F.concat(at_home, visits))).alias("c"))
    signs = active.select("cid", "sig").join(_shuffled(texts.select("cid", "long")), "cid")
    cell = cell.join(_shuffled(signs), "cid").select("key", "c.i", "c.j", "c.role", "cid", "comp", "slot", "sig", "long")
    found = written(cell.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(_with_partners, MEMBERS), "members")
    full = found.join(_shuffled(texts.select("cid", "text")), "cid").select(*CELL, "role", "cid", "comp", "slot", "sig", "long", "text")
    across = full.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(_confirm_cells(shingle, percent), "src long, dst long")
    links = links.unionByName(written(across, "across"))
    comps = components(links)
    # smallest doc_id of each component, for each class, for each document
    place = classes.select("cid", "a", "b", "owner").join(_shuffled(comps.withColumnRenamed("id", "cid")), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = place.groupBy("component").agg(F.min("owner").alias("least"))
    place = place.join(_shuffled(least), "component").select("a", "b", "least", F.col("component").alias("grp"))
    return signed.select("did", "th", "n", "a", "b").join(_shuffled(place), ["a", "b"], "left").select("did", "th", "n", F.when(F.col("n") > 0, F.coalesce("least", "did")).otherwise(F.col("did")).alias("component"), F.when(F.col("n") > 0, F.col("grp")).alias("grp"))


def deduplicate(docs: DataFrame, group: str | None = None, **how) -> DataFrame:
    """docs with n_shingles, component_id and kept: of each group of rows, the one with the smallest doc_id is kept.

    ``group`` names a further column: a number of the row's linked group, null without shingles."""
    found = near_duplicates(docs, **how)
    found = (found if group else found.drop("grp")).distinct().select(F.col("did").alias("__did"), F.col("th").alias("__th"), F.col("n").alias("n_shingles"), F.col("component").alias("__c"), *([F.col("grp").alias(group)] if group else []))
    docs = docs.drop("n_shingles", "component_id", "kept", *([group] if group else []))
    rows = docs.withColumns({"__did": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), "__th": F.xxhash64("text")}).join(_shuffled(found), ["__did", "__th"])
    return rows.withColumns({"component_id": F.nullif(F.col("__c"), F.lit(LAST_ID)), "kept": F.col("__did") == F.col("__c")}).drop("__did", "__th", "__c")


def digest(docs: DataFrame, shingle: int = 4, **how) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    out = near_duplicates(docs.select("doc_id", "text"), shingle=shingle, **how)
    return out.select(F.nullif(F.col("did"), F.lit(LAST_ID)).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(F.col("component"), F.lit(LAST_ID)).alias("component_id"), (F.col("did") == F.col("component")).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1)) + 1)) AS i FROM w)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)
), e AS (
  SELECT x, y FROM l UNION SELECT y, x FROM l
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
), c AS (
  SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, component_id = w.doc_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.doc_id = w.doc_id
"""
