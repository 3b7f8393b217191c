"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The score of
a word is the sum, over all ways to cut it into pieces, of the product of their
probabilities: one forward pass, rescaled as it goes, so that a word may be of any length. A
text's score is the product over its words; the prediction is the language with the highest,
and ``score`` its share among all of them.

Training counts the words of a bounded sample of labelled rows (``SAMPLE_DOCS`` documents a
language at most, chosen by a hash of the id) and runs a few rounds of expectation
maximisation over the same lattice. Every label is learned; the model is 32,000 numbers for
each. Prediction uses the whole text. Words are scored once each, in batches, through a cache
of bounded size.

Defined cases: a null text, or one without a letter, is ``und`` with score 0. Ties go to the
first language by code point. If no row is labelled, every text is ``und``. A null doc_id
is neither learned from nor held out. Repeated rows are judged each. An empty table gives an
empty result. Extra columns pass through ``identify``; those with an output's name are replaced.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, small_batches, worker_state

SAMPLE_DOCS = 600
ROUNDS, SMOOTHING = 3, 50.0
UNKNOWN = 1e-6  # probability of a character that is no piece, in any language
#: Positions between two rescalings; characters of words that are handled at once.
RESCALE, CHARS = 16, 40_000
CACHE_BYTES = 24 << 20
#: The remainder of crc32(doc_id as text) by 4 that is held out.
FOLDS, HELD_OUT = 4, 2
UNDETERMINED = "und"
_BASE = np.uint64(0x100000001B3)
_WORDLY = re.compile(r"[^\W\d_]")  # letters, and numbers that are no digits


def _lettered(text: str) -> bool:
    return any(m[0].isalpha() for m in _WORDLY.finditer(text))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _key(piece: str) -> int:
    k = 0
    for c in piece:
        k = (k * int(_BASE) + ord(c) + 1) & (1 << 64) - 1
    return k


class Pieces:
    """The vocabulary as sorted hashes by length."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = sorted({model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))})
        self.size, self.by_length = len(every), {}
        for n in sorted({len(p) for p in every}):
            found = sorted((_key(p), i) for i, p in enumerate(every) if len(p) == n)
            self.by_length[n] = (np.array([k for k, _ in found], np.uint64), np.array([i for _, i in found], np.int32))


class Lattice:
    """All segmentations of words of one length: ``ids[length][start]`` holds, for each word, the piece of that length there.

    The id is ``size`` where one character is no piece, and -1 (a table's last row, 0) where there is no piece."""

    def __init__(self, pieces: Pieces, words: list[str]):
        self.n, self.rows = n, rows = len(words[0]), len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(rows, n).astype(np.uint64) + np.uint64(1)
        prefix = np.zeros((n + 1, rows), np.uint64)
        for j in range(n):
            prefix[j + 1] = prefix[j] * _BASE + codes[:, j]
        self.ids: dict[int, np.ndarray] = {}
        for length, (keys, ids) in pieces.by_length.items():
            if length > n:
                continue
            key = prefix[length:] - prefix[:-length] * np.uint64(pow(int(_BASE), length, 1 << 64))
            slot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[slot] == key
            if length == 1 or hit.any():
                self.ids[length] = np.where(hit, ids[slot], pieces.size if length == 1 else -1)
        self.at = {length: (x >= 0).any(1).tolist() for length, x in self.ids.items()}  # starts with such a piece in any word
        self.longest = max(self.ids, default=1)

    def forward(self, table: np.ndarray, keep: bool = False):
        """(a, scale, log sums): the summed probability of all segmentations up to each position is a * exp(scale)."""
        a, scales = [np.ones((self.rows, table.shape[1]))], [np.zeros((self.rows, table.shape[1]))]
        for e in range(1, self.n + 1):
            now = np.zeros_like(a[0] if a[0] is not None else a[-1])
            for length, ids in self.ids.items():
                if length <= e and self.at[length][e - length]:
                    now += a[e - length] * table[ids[e - length]]
            a.append(now)
            scales.append(scales[-1])
            if e % RESCALE == 0 and e < self.n:
                scale = scales[e] + np.log(now)
                for k in range(max(0, e - self.longest), e + 1):
                    a[k], scales[k] = a[k] / now, scale
            if not keep and e >= self.longest:
                a[e - self.longest] = scales[e - self.longest] = None
        return a, scales, np.log(a[self.n]) + scales[self.n]

    def backward(self, table: np.ndarray):
        """(b, scale): the same from each position to the end."""
        n = self.n
        b, scales = [None] * n + [np.ones((self.rows, table.shape[1]))], [None] * n + [np.zeros((self.rows, table.shape[1]))]
        for s in range(n - 1, -1, -1):
            now = np.zeros_like(b[n])
            for length, ids in self.ids.items():
                if s + length <= n and self.at[length][s]:
                    now += b[s + length] * table[ids[s]]
            b[s], scales[s] = now, scales[s + 1]
            if (n - s) % RESCALE == 0 and s:
                scale = scales[s] + np.log(now)
                for k in range(s, min(n, s + self.longest) + 1):
                    b[k], scales[k] = b[k] / now, scale
        return b, scales


def lattices(pieces: Pieces, words: list[str]):
    """(places, lattice) for words of one length each, a bounded number of characters at a time but at least one word."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    for n, where in by.items():
        step = max(1, CHARS // n)
        for at in range(0, len(where), step):
            part = where[at : at + step]
            yield part, Lattice(pieces, [words[i] for i in part])


def marked(word: str) -> str:
    """A word as the vocabulary has it, with the sign of a word's begin."""
    return "▁" + word


def _table(probabilities: np.ndarray) -> np.ndarray:
    langs = probabilities.shape[1]
    return np.vstack([probabilities, np.full((1, langs), UNKNOWN), np.zeros((1, langs))])


def train(pieces: Pieces, counts: dict[str, dict[str, int]]) -> tuple[list[str], np.ndarray]:
    """Languages, and a (pieces + 2, languages) table of probabilities from {language: {word: count}}."""
    langs = sorted(counts)
    place: dict[str, int] = {}
    rows, cols, values = array("q"), array("q"), array("d")
    for k, lang in enumerate(langs):
        for word, c in counts[lang].items():
            rows.append(place.setdefault(marked(word), len(place)))
            cols.append(k)
            values.append(c)
    words = list(place)
    rows, cols, values = (np.frombuffer(x, t) if len(x) else np.zeros(0, t) for x, t in ((rows, np.int64), (cols, np.int64), (values, np.float64)))
    order = np.argsort(rows, kind="stable")
    rows, cols, values = rows[order], cols[order], values[order]
    first = np.searchsorted(rows, np.arange(len(words) + 1))
    probs = np.full((pieces.size, len(langs)), 1.0 / pieces.size)
    for _ in range(ROUNDS):
        table, got = _table(probs), np.zeros((pieces.size + 2, len(langs)))
        for part, lattice in lattices(pieces, words):
            weight = np.zeros((len(part), len(langs)))
            for i, w in enumerate(part):
                weight[i, cols[first[w] : first[w + 1]]] = values[first[w] : first[w + 1]]
            a, up, total = lattice.forward(table, keep=True)
            b, down = lattice.backward(table)
            for length, ids in lattice.ids.items():
                for s in np.flatnonzero(lattice.at[length]).tolist():
                    use = a[s] * b[s + length] * table[ids[s]] * weight * np.exp(up[s] + down[s + length] - total)
                    for k in range(len(langs)):
                        got[:, k] += np.bincount(ids[s] + (ids[s] < 0) * (pieces.size + 2), use[:, k], pieces.size + 2)
        seen = got[: pieces.size]
        common = (seen.sum(1) + 0.1) / (seen.sum() + 0.1 * pieces.size)
        probs = (seen + SMOOTHING * common[:, None]) / (seen.sum(0) + SMOOTHING)
    return langs, _table(probs)


class Scorer:
    """Log scores of words by language, cached while the Python worker judges texts."""

    def __init__(self, pieces: Pieces, langs: list[str], table: np.ndarray):
        self.pieces, self.langs, self.table = pieces, langs, table
        self.most = max(1_000, CACHE_BYTES // (180 + 8 * len(langs)))
        self._new()

    def _new(self) -> None:
        self.place: dict[bytes, int] = {}
        self.scores = np.zeros((0, len(self.langs)))

    def __getstate__(self):
        return self.pieces, self.langs, self.table

    def __setstate__(self, state):
        self.__init__(*state)

    def _learn(self, new: list[bytes]) -> None:
        got = np.empty((len(new), len(self.langs)))
        for where, lattice in lattices(self.pieces, [marked(w.decode("utf-8", "surrogatepass")) for w in new]):
            got[where] = lattice.forward(self.table)[2]
        start = len(self.place)
        self.place.update((w, start + i) for i, w in enumerate(new))
        if len(self.place) > len(self.scores):  # room to grow, so that rows are rarely copied
            self.scores = np.vstack([self.scores[:start], got, np.zeros((len(self.place) // 2, len(self.langs)))])
        else:
            self.scores[start : len(self.place)] = got

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        split = [t.encode("utf-8", "surrogatepass").split() if t and _lettered(t) else [] for t in texts]  # at the white space of WORD
        new = list({w for ws in split for w in ws if w not in self.place})
        if len(self.place) + len(new) > self.most:
            self._new()
            new = list({w for ws in split for w in ws})
        if new:
            self._learn(new)
        langs, scores = [], []
        for ws in split:
            if not ws or not self.langs:
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            log = self.scores[np.frombuffer(array("q", map(self.place.__getitem__, ws)), np.int64)].sum(0)
            best = int(log.argmax())
            langs.append(self.langs[best])
            scores.append(float(1.0 / np.exp(log - log[best]).sum()))
        return langs, scores


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, path: str | None = None, sample_docs: int = SAMPLE_DOCS) -> Scorer:
    """A scorer learned from docs(doc_id, text, lang) outside the held-out fold: from ``sample_docs`` rows a language or so, whole."""
    own = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    sizes = {r.lang: r.n for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, sample_docs / n)))]) if sizes else F.lit(None).cast("map<string,double>")
    picked = own.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < F.try_element_at(share, F.col("lang")) * 1_000_000)
    words = picked.select("lang", F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    counts: dict[str, dict[str, int]] = {lang: {} for lang in sizes}
    for r in words.toLocalIterator():
        counts[r.lang][r.word] = r.n
    pieces = Pieces(path or vocabulary_path())
    return Scorer(pieces, *train(pieces, counts))


def identify(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """docs with lang_pred and score; only the text is looked at."""
    small_batches(docs.sparkSession)
    cell = [scorer]

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        own, langs, scores = _kept(cell[0]), [], []
        part, size = [], 0
        values = texts.tolist()
        for i, t in enumerate(values):
            t = t if isinstance(t, str) else None
            part.append(t)
            size += len(t or "")
            if size > 1 << 20 or i + 1 == len(values):
                a, b = own.judge(part)
                langs += a
                scores += b
                part, size = [], 0
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return docs.withColumn("__l", run("text")).withColumns({"lang_pred": F.col("__l.lang_pred"), "score": F.col("__l.score")}).drop("__l")


def has_letter(texts):
    """True where a text has a letter, by the rule of the scorer."""

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: isinstance(t, str) and _lettered(t)).astype(bool)

    return run(texts)


def _kept(scorer: Scorer) -> Scorer:
    """The worker's earlier copy of the same scorer, with its cache."""
    kept = worker_state("language")
    last = kept.get("scorer")
    if last is None or last.langs != scorer.langs or not np.array_equal(last.table, scorer.table):
        kept["scorer"] = scorer
    return kept["scorer"]


def digest(docs: DataFrame, **how) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    docs = docs.select("doc_id", "text", "lang")
    scorer = fit(docs, **how)
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), scorer).select("doc_id", "held_out", "lang_pred", "score")
