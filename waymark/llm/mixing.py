"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only.

Documents of a source queue in the order of a seeded hash, once for each time that a source may
be used. A copy travels as packets of at most ``PACKET`` words, as in networks, so that a long document
does not hold up its source. A packet's virtual finish time is the source's cumulative words up to its end,
divided by the source's target. The queues are merged by a global range sort on finish time, and the
merged queue is cut where its running total reaches the total budget: totals by range give
the range of the cut, a running sum inside that one gives the place. What comes before the place
is taken, the packet at it in part, the rest not at all.

The merge decides where each source ends: at the cut a source has its target but for a packet, and what sources
leave over in their last packets goes to those whose next packets finish first. All sources that are not capped have
queued more than their targets by then. A packet can't be reached if it finishes after 1 + n P / T (n open sources, P the longest packet,
T the sum of open targets), since by then the others have filled the budget; such packets are not sorted.

A source's cumulative sums are two-level: (source, bucket of the hash) totals, a prefix sum over
the totals, then a running sum inside each bucket. Places and levels of the sources are running sums over ranges.
Neither a source nor all sources are gathered in one task.

Defined cases: a null text has size 0 and takes 0. A null source is a source of its own and
comes last. Rows that share a doc_id each have their own place. A source of size 0 has target
0. Equal finish times go by source, hash, doc_id and copy. Texts may be of any length (one of over 1,024 packets has longer ones). An empty
table gives an empty result. Extra columns pass through ``mix`` untouched, whatever their names; those with an output's
name are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, range_sorted, running, written

#: Weights in the order of the sources, repeating; how often a source may be used.
WEIGHTS, MAX_EPOCHS = (5, 2, 1), 3
BUCKET_ROWS, SEED = 2_000, 20_240_601
#: Words of a packet, and the most packets of a copy.
PACKET, MOST_PACKETS = 64, 1_024
#: Packets of the merged queue, and sources, for each partition of a range sort.
SORT_ROWS, SOURCE_ROWS = 100_000, 100_000


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, source_rows: int = SOURCE_ROWS) -> DataFrame:
    """(source, source_size) -> with place (from 1), weight, target and capped. Rows are sources, not documents.

    Sharing by weight with caps: sources sorted by cap / weight are capped as a prefix, so
    running sums find the level at which the rest share what the capped ones leave.
    """
    sources = written(sources, "sources")
    count = sources.count()
    by_name = [F.col("source").asc_nulls_last()]
    s = running(range_sorted(sources, by_name, count, source_rows, "bysource"), by_name, place=F.lit(1).cast("long")).drop("range")
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size").cast("double") * max_epochs).withColumn("ratio", F.col("cap") / F.col("weight"))
    up = ["ratio", "place"]
    s = written(running(range_sorted(s, up, count, source_rows, "byratio"), up, rank=F.lit(1).cast("long"), caps=F.col("cap"), load=F.col("weight")).drop("range"), "levels")
    sums = s.agg(F.sum("source_size").cast("double").alias("total"), F.sum("weight").alias("weights"))
    s = s.join(sums).withColumn("level", (F.col("total") - (F.col("caps") - F.col("cap"))) / (F.col("weights") - (F.col("load") - F.col("weight"))))  # a row on the right
    first = s.agg(F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("rank", "level"))).alias("open"))
    s = s.join(first)
    capped = F.col("open").isNull() | (F.col("rank") < F.col("open.rank"))
    target = F.when(capped, F.col("cap")).otherwise(F.least(F.col("cap"), F.col("open.level") * F.col("weight")))
    return s.select("source", "source_size", "place", "weight", target.alias("target"), capped.alias("capped"))


#: The order of the merged queue. Every row has a number, so no two packets are equal in it.
ORDER = ("finish", "place", "u", "row", "copy", "packet")
_KINDS = ("double", "long", "long", "long", "long", "long")


def _length(size: Column) -> Column:
    """Words of a document's packets."""
    return F.greatest(F.lit(PACKET).cast("long"), F.ceil(size / MOST_PACKETS))


def _packets(reach: float, max_epochs: int) -> Column:
    """An array of (finish, place, u, row, copy, packet, part) for the packets of a document's copies that can be reached."""
    step = _length(F.col("size"))
    ends = lambda c: c * F.col("source_size") + F.col("at")  # noqa: E731  words of the source ahead of this copy
    last = lambda c: F.least(F.ceil(F.col("size") / step) - 1, F.ceil((F.lit(reach) * F.col("target") - ends(c)) / step))
    epochs = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(max_epochs - 1).cast("long")), lambda c: (F.col("size") > 0) & (last(c) >= 0))

    def packet(c, k):
        words = F.least(F.col("size"), (k + 1) * step)
        return F.struct(((ends(c) + words) / F.col("target")).alias("finish"), F.col("place"), F.col("u"), F.col("row"), c.alias("copy"), k.alias("packet"), (words - k * step).alias("part"))

    every = F.transform(epochs, lambda c: F.transform(F.sequence(F.lit(0).cast("long"), last(c).cast("long")), lambda k: packet(c, k)))
    return F.filter(F.flatten(every), lambda x: x["finish"] <= F.lit(reach))


def _cut(queued: DataFrame, packets: Column, budget: int, sort_rows: int):
    """(order key of the packet at the cut, words of it that are taken), or None where the queue ends before the budget."""
    queue = queued.select(packets.alias("x"))
    count = queue.agg(F.sum(F.size("x"))).first()[0] or 0
    merged = range_sorted(queue.select(F.explode("x").alias("x")).select("x.*"), list(ORDER), count, sort_rows, "merged")
    totals = merged.groupBy("range").agg(F.sum("part").alias("words"))  # a row for each range
    ahead = totals.withColumn("before", F.coalesce(F.sum("words").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    here = ahead.where((F.col("before") < budget) & (F.col("before") + F.col("words") >= budget)).first()
    if here is None:
        return None
    own = merged.where(F.col("range") == here["range"]).withColumn("sum", here["before"] + F.sum("part").over(W.orderBy(*ORDER).rowsBetween(W.unboundedPreceding, W.currentRow)))
    last = own.where(F.col("sum") >= budget).orderBy(*ORDER).first()
    return [last[k] for k in ORDER], budget - (last["sum"] - last["part"])


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, sort_rows: int = SORT_ROWS) -> DataFrame:
    """docs(doc_id, source, size, ...) with source_size, target, taken and copies.

    copies: array of (copy, finish, taken), one for each time that the mix takes the
    document, finish being the virtual finish time of the whole copy.
    """
    docs = docs.drop("source_size", "target", "taken", "copies")
    names = [f"`{c.replace('`', '``')}`" for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("doc"), "doc_id", "source", F.col("size").cast("long").alias("size"))  # the caller's names stay apart
    rows = rows.withColumns({"u": F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), "size"), "row": F.monotonically_increasing_id()})
    rows = written(rows, "mix")
    size = rows.agg(F.count("*").alias("rows"), F.max(_length(F.col("size"))).alias("packet")).first()
    buckets = max(1, math.ceil(size.rows / bucket_rows))
    rows = rows.withColumn("bucket", F.pmod(F.shiftrightunsigned("u", 20), F.lit(buckets)))
    totals = written(rows.groupBy("source", "bucket").agg(F.sum("size").alias("sum")), "mixtotals")
    targets = source_targets(totals.groupBy("source").agg(F.sum("sum").alias("source_size")), weights, max_epochs)
    targets = written(targets.select(F.col("source").alias("t"), "source_size", "target", "place", "capped"), "targets")
    room = F.when(~F.col("capped"), F.col("target"))
    whole = targets.agg(F.sum("source_size").alias("budget"), F.count(room).alias("open"), F.sum(room).alias("room")).first()
    budget = whole.budget or 0  # targets are shares of the size of all sources
    reach = 1 + whole.open * size.packet / whole.room + 1e-9 if whole.room else 1 + 1e-9
    ahead = F.coalesce(F.sum("sum").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = totals.select(F.col("source").alias("s"), F.col("bucket").alias("b"), ahead.alias("ahead"))
    places = places.join(targets, F.col("s").eqNullSafe(F.col("t"))).drop("t", "capped")
    inside = W.partitionBy("s", "b").orderBy("u", "doc_id", "size", "row").rowsBetween(W.unboundedPreceding, -1)
    out = rows.join(places, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    out = out.withColumn("at", F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = written(out.select("doc", "size", "u", "row", "at", "source_size", "target", "place"), "queue")
    packets = _packets(reach, max_epochs)
    cut = _cut(out, packets, budget, sort_rows)
    taken = lambda x: x["part"]
    if cut is not None:
        at = F.struct(*[F.lit(v).cast(t).alias(k) for v, k, t in zip(cut[0], ORDER, _KINDS, strict=True)])
        own = lambda x: F.struct(*[x[k].alias(k) for k in ORDER])
        taken = lambda x: F.when(own(x) < at, x["part"]).when(own(x) == at, F.lit(cut[1])).otherwise(F.lit(0).cast("long"))
    out = out.withColumn("parts", F.filter(F.transform(packets, lambda x: F.struct(x["copy"].alias("copy"), taken(x).alias("taken"))), lambda x: x["taken"] > 0))

    def copy(c):
        words = F.aggregate(F.filter("parts", lambda x: x["copy"] == c), F.lit(0).cast("long"), lambda a, x: a + x["taken"])
        return F.struct(c.alias("copy"), ((c * F.col("source_size") + F.col("at") + F.col("size")) / F.col("target")).alias("finish"), words.alias("taken"))

    out = out.withColumn("copies", F.transform(F.array_distinct(F.transform("parts", lambda x: x["copy"])), copy))
    out = out.withColumn("taken", F.aggregate("copies", F.lit(0).cast("long"), lambda a, x: a + x["taken"]))
    return out.select("doc.*", "source_size", "target", "taken", "copies")


def in_order(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row for each copy taken, range-sorted by virtual finish time: the order to train in."""
    out = mixed.select("*", F.explode("copies").alias("__x")).withColumns({"copy": F.col("__x.copy"), "finish": F.col("__x.finish"), "taken": F.col("__x.taken")}).drop("copies", "__x")
    by = ["finish", F.col("source").asc_nulls_last(), "doc_id", "copy"]
    return (out.repartitionByRange(partitions, *by) if partitions else out.repartitionByRange(*by)).sortWithinPartitions(*by)


def digest(docs: DataFrame, **how) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    out = mix(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), **how)
    return out.select("doc_id", "size", "source_size", "target", "taken")
