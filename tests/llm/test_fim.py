"""Fill-in-the-middle against a version with lists of lines, and rank and select against counting."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymark.llm import fim

LAST = 2**63 - 1
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def by_lists(doc_id, text, rate=100):
    """(n, form, prefix_chars, middle_chars, output)"""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    x = sha(f"7:{LAST if doc_id is None else doc_id}")
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("size", [0, 1, 63, 64, 511, 512, 513, 5000])
@pytest.mark.parametrize("share", [0.0, 0.01, 0.5, 1.0])
def test_rank_and_select(size, share):
    marks = np.random.default_rng(size).random(size) < share
    bits, places = fim.Bits(marks), np.flatnonzero(marks)
    at = np.arange(size + 1)
    assert (bits.rank(at) == np.concatenate([[0], np.cumsum(marks)])).all()
    assert bits.ahead[-1] == len(places)
    if len(places):
        assert (bits.select(np.arange(1, len(places) + 1)) == places).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-5, 2**62)), st.one_of(st.none(), st.text("ab\né☂\U0001f600<PSM> \r\x0b", max_size=40))), max_size=12))
def test_batches(rows):
    ids, texts = pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())
    for a, b in ((ids, texts), (pa.concat_arrays([ids[:1], ids])[1:], pa.concat_arrays([texts[:1], texts])[1:])) if rows else ((ids, texts),):
        got = fim.cut_batch(a[-len(rows) :] if rows else a, b[-len(rows) :] if rows else b, 7, 100, 50)
        mine = list(zip(got["n"], got["form"], got["prefix_chars"], got["middle_chars"], [x.decode() for x in got["output"]], strict=True))
        assert mine == [by_lists(*r) for r in rows]


@pytest.mark.parametrize("rate", [100, 60])
def test_documents(spark, odd_docs, rate):
    more = spark.createDataFrame([(20 + k, t) for k, t in enumerate(["\n", "\n\n", "a\nb", "a\nb\n", "x <P> y\nz", "tail <S", "<M>", "no end\n" * 3000 + "é" * 9])] + [(100 + k, "line é\n" * (k % 9) + "end") for k in range(120)], "doc_id long, text string")
    df = odd_docs.unionByName(more, allowMissingColumns=True)
    rows = df.select("doc_id", "text").collect()
    want = sorted(((r.doc_id, *(w := by_lists(r.doc_id, r.text, rate))[:4], sha(w[4]), sha(r.text or "")) for r in rows), key=str)
    assert sorted((tuple(r) for r in fim.digest(df, rate=rate).collect()), key=str) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_texts_and_columns(spark, odd_docs, no_docs):
    df = odd_docs.withColumns({"form": F.lit(3), "fim": F.lit("mine"), "Fim_": F.lit(1)})
    out = fim.fill_in_middle(df)
    assert set(out.columns) == {*df.columns, "n", "prefix_chars", "middle_chars", "output"}
    assert {r.fim for r in out.collect()} == {"mine"} and {r.form for r in out.collect()} <= {"plain", "psm", "spm"}
    same = out.where(~F.coalesce("text", F.lit("")).eqNullSafe(fim.restored(F.col("output"), F.col("form"))))
    assert same.count() == 0 and out.count() == df.count()
    assert fim.digest(no_docs).count() == 0 and fim.fill_in_middle(no_docs).columns
