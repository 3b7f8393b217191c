"""Each stage against a brute-force version over its own input, and the whole run."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from prose import prose
from test_documents import brute_lines, brute_near, rows_of, speech


def test_stages_and_columns(spark, odd_docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0


def test_stages_on_nothing(spark, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_language_stage_keeps_clean_documents(spark):
    df = speech(spark).withColumn("n_chars", F.length("text").cast("long"))
    bad = spark.createDataFrame([(900, None, "en", "s", None), (901, "12 3", None, "s", 4)], df.schema)
    out = corpus_pipeline.identify_language(spark, df.unionByName(bad), "")
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in df.collect())


def test_line_stage(spark, odd_docs):
    got = corpus_pipeline.drop_repeated_lines(spark, odd_docs, "").collect()
    import hashlib

    want = [(d, h) for d, _, _, h in brute_lines(rows_of(odd_docs))]
    assert sorted([(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in got], key=str) == sorted(want, key=str)
    assert all(r.n_chars == len(r.text) for r in got)


def test_near_stage_keeps_one_of_each_group(spark):
    r, rows = random.Random(1), []
    for k in range(40):
        w = prose(80, k // 4).split()
        w[r.randrange(80)] = f"x{k}"
        rows.append((k, " ".join(w), "en", "s", None))
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect())
    assert got == sorted({d for d, _, _, kept in brute_near(rows_of(df), 5) if kept})


def test_near_stage_keeps_different_texts_without_or_with_one_id(spark):
    rows = [(None, prose(60, 200 + k), "en", "s", None) for k in range(5)] * 2 + [(7, prose(60, 300 + k), "en", "s", None) for k in range(3)]
    rows += [(9, prose(60, 300), "en", "s", None), (None, prose(60, 301), "fr", "s", None), (None, None, None, None, None), (None, "", "en", "s", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted([(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()], key=str)
    assert got == sorted([*{(d, t) for d, t, *_ in rows[:13]}, (None, None), (None, "")], key=str)


def test_language_stage_without_labels(spark):
    rows = [(k, prose(30, k), None, "s", None) for k in range(6)] + [(7, "12 3", None, "s", None), (8, None, None, "s", None), (None, "öä", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.identify_language(spark, df, "").collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted([*range(6), None], key=str)


def test_mixing_stage_takes_what_the_operator_takes(spark):
    from waymark.llm import mixing

    rows = [(k, prose(5 + k % 40, k), "en", f"s{k % 3}", None) for k in range(90)] + [(5, prose(10, 5), "en", "s2", None)] * 2 + [(None, "a b", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = {}
    for r in mixing.mix(df.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    got = {}
    for r in corpus_pipeline.mix_sources(spark, df, "").collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert got == {k: v for k, v in want.items() if v}


def test_run(spark, tmp_path):
    df = speech(spark).withColumn("n_chars", F.length("text").cast("long"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    docs = df
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    key = lambda d: sorted((r.doc_id, r.start, r.ids_crc32) for r in d.where("start = 0 and length = doc_tokens").collect())
    assert abs(len(key(out)) - len(key(docs))) <= 4 and out.agg(F.sum("length")).first() == docs.agg(F.sum("length")).first()
