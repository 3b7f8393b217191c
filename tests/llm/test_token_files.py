"""Token files against the tokenizer and plain lists; random access; attempts that failed."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from waymark.llm import token_files
from waymark.llm.packing import vocabulary_path

from prose import prose

LAST = 2**63 - 1


@pytest.fixture(scope="module")
def docs(spark, odd_docs):
    more = [(k % 70 + 100, prose(k % 40, 3000 + k) + " <|endoftext|> don't Stop") for k in range(150)] + [(None, prose(9, k % 3)) for k in range(60)]
    return odd_docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True).repartition(5)


def in_order(docs, path, end_id=1):
    """[(doc_id, ids)] by doc_id, ties by the hash of the text."""
    t = Tokenizer.from_file(path)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).collect()
    rows.sort(key=lambda r: (LAST if r.doc_id is None else r.doc_id, r.th))
    return [(r.doc_id, [*t.encode(r.text or "", add_special_tokens=False).ids, end_id]) for r in rows]


@pytest.mark.parametrize("shard_bytes", [64 << 20, 500])
def test_documents(spark, docs, shard_bytes):
    want, at = [], 0
    for d, ids in in_order(docs, vocabulary_path()):
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [tuple(r) for r in token_files.digest(docs, shard_bytes=shard_bytes).collect()]
    assert sorted(got, key=lambda r: r[1]) == want


def test_random_access(spark, docs, tmp_path, monkeypatch):
    to = f"file://{tmp_path}/set"
    index = token_files.write_tokens(docs, to, shard_bytes=2000).collect()
    want = in_order(docs, vocabulary_path())
    whole = [i for _, ids in want for i in ids]
    assert len(index) > 4 and sum(r.tokens for r in index) == len(whole)
    sizes = {f: os.path.getsize(tmp_path / "set" / f) for f in os.listdir(tmp_path / "set") if f[-4:] in (".ids", ".off", ".doc")}
    assert sizes == {f"{r.name}.{x}": n for r in index for x, n in (("ids", 2 * r.tokens), ("off", 8 * r.docs + 8), ("doc", 8 * r.docs))}
    for local in (True, False):
        if not local:  # a store that cannot be mapped is read by ranges
            monkeypatch.setattr(token_files.pafs, "LocalFileSystem", type(None))
        t = token_files.Tokens(to)
        assert len(t) == len(want)
        assert all(t.document(k).tolist() == want[k][1] for k in range(len(want)))
        for a, b in ((0, 10), (len(whole) // 3, len(whole) // 2), (len(whole) - 5, len(whole) + 9), (0, len(whole)), (7, 7)):
            assert t.stretch(a, b).tolist() == whole[a:b]
        with pytest.raises(IndexError):
            t.document(len(want))


def test_files_that_the_index_does_not_name(spark, docs, tmp_path):
    """What a failed attempt has left is not read."""
    to = f"{tmp_path}/set"
    token_files.write_tokens(docs, to)
    n = token_files.read_tokens(spark, to).count()
    (tmp_path / "set" / "000000-lost.ids").write_bytes(b"\1\0" * 99)
    assert token_files.read_tokens(spark, to).count() == n == docs.count()
    back = token_files.read_tokens(spark, to).orderBy("start").collect()
    assert [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in back] == in_order(docs, vocabulary_path())


def test_other_vocabularies(spark, docs, tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    to = f"{tmp_path}/set"
    token_files.write_tokens(docs, to, vocabulary=path, end_id=50256)
    back = token_files.read_tokens(spark, to).orderBy("start").collect()
    assert [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in back] == in_order(docs, path, 50256)
    assert token_files.id_type(50_257) == "<u2" and token_files.id_type(65_537) == "<u4"


def test_no_documents(no_docs, tmp_path):
    assert token_files.digest(no_docs).count() == 0
    token_files.write_tokens(no_docs, f"{tmp_path}/none")
    t = token_files.Tokens(f"{tmp_path}/none")
    assert len(t) == 0 and len(t.stretch(0, 5)) == 0
