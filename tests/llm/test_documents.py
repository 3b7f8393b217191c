"""Brute-force versions of the document operators, on odd rows and on prose with copies."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import common, language_id, line_dedup, mixing, near_dedup, packing, substring_dedup

from prose import prose

LAST = 2**63 - 1
BLANK = " \t\n\x0b\x0c\r"


def rows_of(df):
    return [(LAST if r.doc_id is None else r.doc_id, r.text, r) for r in df.select("doc_id", "text").collect()]


def back(d):
    return None if d == LAST else d


def many(spark, n=150, seed=7):
    """Prose with copies, near copies and shared passages."""
    r = random.Random(seed)
    base = [prose(r.randrange(5, 160), 100 + k, salt=str(k % 3)) for k in range(n)]
    passage = prose(55, 999)
    out = []
    for k in range(n):
        t = base[k]
        if k % 5 == 1:
            t = base[k - 1]
        if k % 5 == 2:
            w = base[k - 2].split()
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        if k % 7 == 3:
            t = t[: len(t) // 2] + " " + passage + " " + t[len(t) // 2 :]
        out.append((k, t.replace(" phi1 ", "\n"), "en", f"s{k % 4}"))
    r.shuffle(out)
    return spark.createDataFrame(out, "doc_id long, text string, lang string, source string").repartition(3)


def brute_lines(rows):
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(BLANK))
    owners = {}
    for d, t, _ in rows:
        for line in (t or "").split("\n"):
            owners.setdefault(key(line), set()).add(d)
    out = []
    for d, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and len(owners[key(x)]) > 1 and min(owners[key(x)]) != d)]
        out.append((back(d), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (3, 5)])
def test_lines(spark, odd_docs, batches, fanout):
    for df in (odd_docs, many(spark)):
        got = sorted([tuple(r) for r in line_dedup.digest(df, batches=batches, fanout=fanout, buckets=3, hot_share=50).collect()], key=str)
        assert got == brute_lines(rows_of(df))


def test_lines_keep_columns(odd_docs, no_docs):
    out = line_dedup.dedup_lines(odd_docs)
    assert set(out.columns) == set(odd_docs.columns) and dict(out.dtypes)["n_lines"] == "bigint"
    assert line_dedup.digest(no_docs).count() == 0


def brute_windows(rows, w=20):
    first, out = {}, []
    tok = [(d, (t or "").encode().split()) for d, t, _ in rows]
    for d, ws in sorted(tok, key=lambda x: x[0]):
        for i in range(len(ws) - w + 1):
            k = tuple(ws[i : i + w])
            first[k] = min(first.get(k, (d, i)), (d, i))
    for d, ws in tok:
        gone = set()
        for i in range(len(ws) - w + 1):
            if first[tuple(ws[i : i + w])] < (d, i):
                gone.update(range(i, i + w))
        kept = [x for j, x in enumerate(ws) if j not in gone]
        out.append((back(d), len(ws), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit,hot_windows", [(20_000, 250_000), (3, 250_000), (20_000, 0), (3, 5)])
def test_substrings(spark, odd_docs, limit, hot_windows):
    periodic = spark.createDataFrame([(50, "a b c " * 40), (51, "b c a " * 30 + "z"), (52, "q " * 19)], "doc_id long, text string")
    for df in (odd_docs, many(spark), periodic):
        got = sorted([tuple(r) for r in substring_dedup.digest(df, bucket_windows=limit, hot_windows=hot_windows, sample=1.0).collect()], key=str)
        assert got == brute_windows(rows_of(df))


def test_substrings_of_many_texts_of_one_id(spark, monkeypatch):
    """Hundreds of texts without an id, of different lengths, with passages of their own and of others; a header that a smaller id holds too."""
    head, shared = prose(25, 900), [prose(30, 910 + k) for k in range(4)]
    rows = [(None, f"{head if k % 3 else ''} {prose(25 + k % 40, 1000 + k)} {shared[k % 4] if k % 5 == 0 else ''} end{k}", "x") for k in range(400)]
    rows += [(3, head + " of three", "x"), (3, head + " again", "x"), (5, shared[1], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2)
    want = brute_windows(rows_of(df))
    for most in (2_000, 0):
        monkeypatch.setattr(substring_dedup, "MOST_HASHES", most)
        assert sorted([tuple(r) for r in substring_dedup.digest(df).collect()], key=str) == want


def test_hot_minimisers_are_split():
    """A minimiser that heads most windows is split by longer runs; equal windows of other surroundings still meet."""
    import numpy as np

    pair, tail = b"of the", [prose(30, 2000 + k).encode() for k in range(50)]
    texts = [b" ".join(pair + b" " + b" ".join(t.split()[i : i + 2]) for i in range(28)) for t in tail]
    buckets = lambda hot: [(b, s, n) for t in texts for b, s, n, _ in substring_dedup.super_kmers(t.split(), hot=hot)]
    sizes = lambda rows: np.unique([b for b, _, n in rows for _ in range(n)], return_counts=True)[1]
    plain, split = buckets(None), buckets(np.ones(substring_dedup.SLOTS, bool))
    assert sizes(plain).sum() == sizes(split).sum() and sizes(split).max() < sizes(plain).max() / 5
    of = lambda words: {tuple(words[s + i : s + i + 20]): b for b, s, n, _ in substring_dedup.super_kmers(words, hot=np.ones(substring_dedup.SLOTS, bool)) for i in range(n)}
    words = texts[0].split()
    inner = of([b"x"] * 3 + words[10:50] + [b"y"] * 3)
    assert all(inner[w] == b for w, b in of(words[10:50]).items())


def test_least_of_neighbours():
    import numpy as np

    x = np.random.default_rng(1).integers(0, 1000, 200).astype(np.uint64)
    for span in (1, 2, 3, 7, 8, 15, 19, 200):
        assert substring_dedup.slide_min(x, span).tolist() == [min(x[i : i + span]) for i in range(len(x) - span + 1)]


def test_substrings_empty(no_docs):
    assert substring_dedup.digest(no_docs).count() == 0
    assert set(substring_dedup.dedup_substrings(no_docs).columns) >= set(no_docs.columns)


def brute_near(rows, k):
    sets = []
    for d, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets.append((d, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    out = []
    for i, (d, s) in enumerate(sets):
        c = min(sets[j][0] for j in range(len(sets)) if find(j) == find(i))
        out.append((back(d), len(s), back(c), d == c))
    return sorted(out, key=str)


@pytest.mark.parametrize("block,part", [(400_000, 256), (400, 1)])
def test_near_copies(spark, odd_docs, block, part, monkeypatch):
    monkeypatch.setattr(near_dedup, "PART", part)
    for df in (odd_docs, many(spark)):
        got = sorted([tuple(r) for r in near_dedup.digest(df, block=block).collect()], key=str)
        assert got == brute_near(rows_of(df), 4)


def test_near_copies_of_one_text(spark):
    """A large group whose members are alike to the original, not to each other: dense cells."""
    r, words = random.Random(3), prose(200, 77).split()
    rows = [(0, " ".join(words))]
    for k in range(1, 120):
        w = list(words)
        for at in r.sample(range(200), 4 if k % 3 else 9):
            w[at] = f"new{k}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([tuple(x) for x in near_dedup.digest(df).collect()], key=str)
    assert got == brute_near(rows_of(df), 4)


def test_pigeonhole_guarantee():
    """Two signatures within the distance share a key, whichever symbols differ."""
    r = np.random.default_rng(5)
    a = r.integers(0, 2**16, (200, near_dedup.SYMBOLS)).astype("<u2")
    b = a.copy()
    for row in b:
        at = r.choice(near_dedup.SYMBOLS, near_dedup.DISTANCE, replace=False)
        row[at] ^= r.integers(1, 2**16, len(at)).astype("<u2")
    assert (near_dedup.chunk_keys(a) == near_dedup.chunk_keys(b)).any(1).all()


def test_near_empty(no_docs, odd_docs):
    assert near_dedup.digest(no_docs).count() == 0
    kept = near_dedup.deduplicate(odd_docs).where("kept")
    assert kept.where("doc_id = 1").count() == 0 and kept.where("doc_id = 0").count() == 1


def waterfill(sizes, weights, epochs=3):
    total, caps, target, open_ = sum(sizes), [epochs * s for s in sizes], [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        level = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if level * weights[i] > caps[i]}
        if not over:
            for i in open_:
                target[i] = level * weights[i]
            break
        for i in over:
            target[i] = caps[i]
            left -= caps[i]
        open_ -= over
    return target


def test_mixing(spark, odd_docs):
    for df in (odd_docs, many(spark)):
        out = mixing.mix(df.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size")))
        rows = out.collect()
        assert len(rows) == df.count()
        by = {}
        for r in rows:
            by.setdefault(r.source, []).append(r)
        names = sorted([s for s in by if s is not None], key=lambda s: s.encode()) + ([None] if None in by else [])
        want = waterfill([sum(r["size"] for r in by[s]) for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))])
        for s, t in zip(names, want, strict=True):
            assert all(abs(r.target - t) < 1e-6 and r.source_size == sum(x["size"] for x in by[s]) for r in by[s])
            assert abs(sum(r.taken for r in by[s]) - t) <= 2 * mixing.PACKET
            assert all(0 <= r.taken <= 3 * r["size"] for r in by[s])
            assert all(sum(c.taken for c in r.copies) == r.taken for r in by[s])
        assert sum(r.taken for r in rows) == sum(r["size"] for r in rows)


@pytest.mark.parametrize("sort_rows", [7, 100_000])
def test_mixing_takes_what_a_queue_in_python_takes(spark, sort_rows, monkeypatch):
    """Word by word: merge the queues by finish time and stop at the budget. Also: the merge is a range exchange."""
    plans, write = [], common.written
    for module in (common, mixing):
        monkeypatch.setattr(module, "written", lambda df, name, *a, **k: plans.append((name, df._jdf.queryExecution().toString())) or write(df, name, *a, **k))
    df = many(spark).select("doc_id", "source", mixing.n_words(F.col("text")).alias("size")).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "s0").otherwise(F.col("source")))
    got = {r.doc_id: r.taken for r in mixing.mix(df, bucket_rows=20, sort_rows=sort_rows).collect()}
    assert any("rangepartitioning" in p for _, p in plans)
    assert all("rangepartitioning(finish" in p and "SinglePartition" not in p for name, p in plans if name == "merged") and "merged" in dict(plans)
    rows = df.withColumn("u", F.xxhash64(F.lit(mixing.SEED), F.col("doc_id").cast("string"), "size")).collect()
    names = sorted({r.source for r in rows})
    sizes = [sum(r["size"] for r in rows if r.source == s) for s in names]
    goals = waterfill(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))])
    words = []  # one entry a word of a queue: the finish time of its packet, and where it stands
    for k, (s, goal) in enumerate(zip(names, goals, strict=True)):
        at = 0
        for copy in range(3):
            for r in sorted((r for r in rows if r.source == s), key=lambda r: (((r.u % 2**64) >> 20) % 8, r.u, r.doc_id)):  # 8 buckets
                for i in range(r["size"]):
                    end = at - i + min(r["size"], (i // mixing.PACKET + 1) * mixing.PACKET)
                    words.append((end / goal, k, r.u, copy, at, r.doc_id))
                    at += 1
    want = dict.fromkeys(got, 0)
    for *_, doc in sorted(words)[: sum(sizes)]:
        want[doc] += 1
    assert got == want
    alone = dict.fromkeys(got, 0)  # each queue cut at its own target, without the merge
    for k, goal in enumerate(goals):
        for *_, doc in sorted(w for w in words if w[1] == k)[: round(goal)]:
            alone[doc] += 1
    assert got != alone


def test_mixing_of_many_sources_and_long_documents(spark):
    """Hundreds of sources in ranges of a few; a document that is most of its source; names that clash with the operator's own."""
    r = random.Random(4)
    rows = [(k, f"s{r.randrange(300):03d}", r.randrange(400), "mine") for k in range(3000)] + [(9000, "big", 90_000, "mine"), (9001, "big", 10, "mine"), (9002, None, 700, "mine")]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, __u string").withColumns({c: F.lit(c) for c in ("u", "row", "s", "b", "at", "place", "bucket", "doc", "x", "range", "a.b", "t")})
    out = mixing.mix(df, bucket_rows=50, sort_rows=100)
    assert set(df.columns) | {"source_size", "target", "taken", "copies"} == set(out.columns)
    got = out.collect()
    assert all(x["__u"] == "mine" and x.u == "u" and x["a.b"] == "a.b" and x.doc == "doc" for x in got) and len(got) == len(rows)
    by = {}
    for x in got:
        by.setdefault(x.source, []).append(x)
    longest = math.ceil(90_000 / mixing.MOST_PACKETS)
    assert all(abs(sum(x.taken for x in own) - own[0].target) <= 2 * longest for own in by.values())
    assert sum(x.taken for x in got) == sum(x[2] for x in rows)


def test_mixing_reruns_agree_and_order(spark):
    df = many(spark)
    a, b = (sorted(map(tuple, mixing.digest(d).collect())) for d in (df, df.repartition(7)))
    assert a == b
    sized = df.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    for bucket in (5, 10**6):
        finish = [r.finish for r in mixing.in_order(mixing.mix(sized, bucket_rows=bucket), 1).collect()]
        assert finish == sorted(finish) and min(finish) > 0


def test_mixing_empty(no_docs):
    assert mixing.digest(no_docs).count() == 0


def test_mixing_plan_has_no_python(spark):
    plan = mixing.digest(many(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("length", [4096, 64, 7])
def test_packing(spark, odd_docs, length):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    for df in (odd_docs, many(spark)):
        pieces = packing.pack(df, length=length).collect()
        stream = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
        at = 0
        for p in stream:  # gapless, in order, never over a cut
            assert p.sequence_id * length + p.offset == at and p.offset + p.length <= length and p.length > 0
            at += p.length
        docs, now = [], []
        for p in stream:
            if p.start == 0:
                now = []
                docs.append((p.doc_id, now, p.doc_tokens))
            assert p.start == sum(len(x) // 2 for x in now)
            now.append(bytes(p.ids))
        got = sorted([(d, np.frombuffer(b"".join(x), "<u2").tolist()) for d, x, _ in docs], key=str)
        want = sorted([(back(d), t.encode(x or "", add_special_tokens=False).ids + [2]) for d, x, _ in rows_of(df)], key=str)
        assert got == want and all(n == sum(len(x) // 2 for x in p) for _, p, n in docs)


def test_packing_checksums(odd_docs, no_docs):
    a = {(p.doc_id, p.start, p.sequence_id, p.offset): bytes(p.ids) for p in packing.pack(odd_docs).collect()}
    for r in packing.digest(odd_docs).collect():
        ids = np.frombuffer(a[(r.doc_id, r.start, r.sequence_id, r.offset)], "<u2").astype("<u4")
        assert r.ids_crc32 == zlib.crc32(ids.tobytes())
    assert packing.digest(no_docs).count() == 0


def test_tokens_of_odd_texts():
    from tokenizers import Tokenizer

    t, r = Tokenizer.from_file(packing.vocabulary_path()), random.Random(2)
    letters = "aA'sSt.,09²½éÉß×÷ªº\xa0\x85\x1c\xad \tΣσİÅ̊<|>endoftext日\U0001f642\n"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(16))) for _ in range(3000)] + ["<|endoftext|>a", "<|EndOfText|>"]
    for text, ids in zip(texts, packing.token_ids(texts, packing.vocabulary_path()), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == t.encode(text, add_special_tokens=False).ids + [2], repr(text)


def test_plain_texts_cost_a_lookup_a_part():
    """However many different words they have: the words of a plain text are never looked up or kept themselves."""
    from tokenizers import Tokenizer

    t, path = Tokenizer.from_file(packing.vocabulary_path()), packing.vocabulary_path()
    text = " ".join(f"{a}{p}{b}" for a in ("Rail", "émile", "don't") for b in ("way", "Été", "7") for p in ",.;!-")
    parts, words = packing._caches(path)
    before = len(words) + len(words.old)
    (ids,) = packing.token_ids([text], path)
    assert np.frombuffer(ids, "<u2").tolist() == t.encode(text, add_special_tokens=False).ids + [2]
    assert len(words) + len(words.old) == before and "rail" in parts


def test_texts_without_a_letter_have_no_language(spark):
    """Numbers that are no digits (fractions, superscripts, circled, Roman) are no letters either."""
    texts = ["½", "²", "①②", "Ⅷ", "12 ½ _ !", "一", "ªm", "½ a", "\u0301", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = df.unionByName(spark.createDataFrame([(100 + k, f"the house and the river {k}") for k in range(40)], "doc_id long, text string")).withColumn("lang", F.lit("en"))
    got = {r.doc_id: r for r in language_id.digest(docs).collect()}
    want = [any(c.isalpha() for c in t) for t in texts]
    assert [got[k].lang_pred != "und" for k in range(len(texts))] == want and all(got[k].score == 0 for k, w in enumerate(want) if not w)
    assert [r.ok for r in df.orderBy("doc_id").select(language_id.has_letter("text").alias("ok")).collect()] == want


SPEECH = {"en": "the and of with that this from have which their", "de": "der und die mit dass dieser aus haben welche ihre", "fr": "le et de avec que ce depuis avoir lequel leur"}


def speech(spark, n=240):
    r = random.Random(4)
    rows = []
    for k in range(n):
        lang = list(SPEECH)[k % 3]
        rows.append((k, " ".join(r.choice(SPEECH[lang].split()) for _ in range(30)), lang if k % 11 else None, "s"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_language(spark):
    df = speech(spark)
    truth = {k: list(SPEECH)[k % 3] for k in range(240)}
    out = language_id.digest(df).collect()
    held = [r for r in out if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_language_odd_rows(spark, odd_docs, no_docs):
    out = {r.doc_id: r for r in language_id.digest(odd_docs).collect()}
    assert all(out[k].lang_pred == "und" and out[k].score == 0 for k in (3, 4, 5, 14))
    assert out[9].lang_pred in ("en", "fr", "de")
    assert language_id.digest(no_docs).count() == 0
    unlabelled = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.digest(unlabelled).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    """Against enumeration of every way to cut a word."""
    pieces = language_id.Pieces(language_id.vocabulary_path())
    langs, table = language_id.train(pieces, {"a": {"hello": 3, "help": 1}, "b": {"hallo": 2}})
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=language_id.vocabulary_path())
    every = sorted({m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))})
    place = {p: k for k, p in enumerate(every)}

    def total(w):
        if not w:
            return np.ones(len(langs))
        out = np.zeros(len(langs))
        for k in range(1, len(w) + 1):
            if w[:k] in place:
                out = out + table[place[w[:k]]] * total(w[k:])
            elif k == 1:
                out = out + table[pieces.size] * total(w[1:])
        return out

    for word in ("▁hello", "▁hal", "▁☂x", "▁internationalization"[:14]):
        for _, lattice in language_id.lattices(pieces, [word]):
            assert np.allclose(np.exp(lattice.forward(table)[2][0]), total(word))
            b, scale = lattice.backward(table)
            assert np.allclose(b[0] * np.exp(scale[0]), total(word))

    def log_total(w):  # the same sum, from left to right, in logarithms
        log = [np.zeros(len(langs))]
        for e in range(1, len(w) + 1):
            ways = [log[s] + np.log(table[place[w[s:e]]] if w[s:e] in place else table[pieces.size]) for s in range(max(0, e - 40), e) if w[s:e] in place or e - s == 1]
            log.append(np.logaddexp.reduce(ways))
        return log[-1]

    for word in ("▁" + "donaudampfschiff" * 40, "▁" + "☂" * 700, "▁" + "x" * 3000):  # no word is cut, however long
        (_, lattice), = language_id.lattices(pieces, [word])
        assert np.allclose(lattice.forward(table)[2][0], log_total(word))
        assert np.allclose(lattice.forward(table, keep=True)[2][0], log_total(word))


def test_every_label_is_learned(spark):
    """Also the rarest of very many."""
    rows = [(4 * k + j, f"wort{k} des{k} landes{k}", f"l{k:03}", "s") for k in range(260) for j in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert len(language_id.fit(df).langs) == 260
