"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs. All but the last return the columns of ``documents``.
Nulls, empty texts, repeated rows and empty tables are defined by the operators. Texts are used
whole, however long. Columns other than those of ``documents`` are dropped, whatever their names.
Rows alike in every column count as so many rows, but near-dedup keeps one of a group: the
smallest doc_id, and of several texts with that id the one with the smallest hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.llm import language_id, line_dedup, mixing, near_dedup, packing
from waymark.llm.common import BLANKS, LAST_ID, release, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew."""
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter go."""
    docs = docs.select(*COLUMNS)
    scorer = language_id.fit(docs)
    if not scorer.langs:  # nothing to learn from: no language can be told, but letters can be seen
        return docs.where(language_id.has_letter("text"))
    return language_id.identify(docs, scorer).where(F.col("lang_pred") != language_id.UNDETERMINED).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier document holds."""
    return _documents(line_dedup.dedup_lines(docs.select(*COLUMNS)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id, once. Those without words stay."""
    found = near_dedup.deduplicate(docs.select(*COLUMNS), group="__group").where("kept")
    found = found.withColumn("__alone", F.when(F.col("__group").isNull(), F.monotonically_increasing_id()))
    again = W.partitionBy("__group", "__alone").orderBy(F.xxhash64("text"))
    # the bare comparison lets Spark number, and drop, the rows of a group before the shuffle
    return found.withColumn("__again", F.row_number().over(again)).where(F.col("__again") == 1).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each copy that the mix takes, in the order of the mix; the copy at the cut ends there."""
    docs = docs.select(*COLUMNS)
    key = F.xxhash64("text")
    sizes = docs.select("doc_id", "source", key.alias("th"), mixing.n_words(F.col("text")).alias("size"))
    taken = mixing.mix(sizes).where("taken > 0").select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("__did"), F.col("source").alias("__s"), F.col("th").alias("__th"), "size", "copies")
    # rows alike in every column share their copies: each group of them is taken apart by a number
    alike = W.partitionBy("__did", "__s", "__th").orderBy(F.lit(1))
    number = lambda df: df.withColumn("__no", F.row_number().over(alike))
    rows = number(docs.withColumns({"__did": F.coalesce("doc_id", F.lit(LAST_ID)), "__s": F.col("source"), "__th": key}))
    taken = number(taken)
    taken = taken.select(F.col("__did").alias("d"), F.col("__s").alias("s"), F.col("__th").alias("t"), F.col("__no").alias("k"), "size", "copies")
    both = rows.join(taken, (F.col("__did") == F.col("d")) & F.col("__s").eqNullSafe(F.col("s")) & (F.col("__th") == F.col("t")) & (F.col("__no") == F.col("k")))
    every = mixing.in_order(both.select(*COLUMNS, "size", "copies"))
    pieces = F.regexp_extract_all("text", F.lit(f"[{BLANKS}]*[^{BLANKS}]+"), F.lit(0))
    cut = F.when(F.col("taken") < F.col("size"), F.array_join(F.slice(pieces, 1, F.col("taken").cast("int")), "")).otherwise(F.col("text"))
    return _documents(every.withColumn("text", cut))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    return packing.digest(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]

#: SQL can express neither the trained language model nor the tokenizer; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}", codec="zstd")
            release(keep=docs)  # what the stage and those before it have written
    return docs
