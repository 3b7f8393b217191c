"""Main text of HTML pages by the maximum-scoring subsequence.

A page becomes a run of tokens: tags, and stretches of words with the marks of what they stand
in. A word scores by its probability, learned from labelled pages, of standing in the article given
these marks: towards 1 where that is high, towards -1 where it is low. Each tag scores a small negative cost. One linear scan finds the contiguous region of the highest sum: that region is the article, with
what interrupts it. Which stretches inside a region are interruptions (an advert between two paragraphs) is learned
apart, from nothing but what the labelled pages have between the first and the last word of their articles, so
menus, headers and footers are told by the scan alone. An interruption scores 0: it does not part an article.

Marks are what the markup itself says: the names of the enclosing elements, the words in their
class, id and role, and whether the words are a link on their own in their block. No list says
what any of them means: ``labelled_pages`` does, by two regularised logistic regressions over
stretches of text. A mark that no labelled page has counts nothing. A page is read with running sums of the marks'
weights, one for each open element, so memory is in proportion to the page, however deep it nests.

Defined cases: a null or empty page, or one without words, gives an empty text, and so does one
where no word scores positive. Of equally good regions the longest of the first counts. Unclosed
tags and a page cut off in the middle are read as far as they go, at any length and depth. Repeated
rows are extracted each. An empty table gives an empty result. Extra columns pass through
``extract``; those with an output's name are replaced.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .labelled_pages import BEGIN, END, TRAINING

#: Elements whose content is no text of the page; those that begin and end a block; those without an end tag.
UNREAD = ("script", "style", "noscript", "template", "head", "title", "iframe", "svg", "object", "canvas", "audio", "video", "textarea")
BLOCKS = (
    "p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tr caption section article blockquote pre figure figcaption "
    "header footer nav aside main hr address form body html details summary fieldset center"
).split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()

_UNREAD, _BLOCKS, _VOID = map(frozenset, (UNREAD, BLOCKS, VOID))
#: Elements that end open ones, as HTML allows without end tags: which, and inside what these stay open.
_OWN = _BLOCKS - {"p", "div", "address", "li", "dt", "dd"} | {"menu", "td", "th", "select", "button", "label"}
IMPLIED = {
    "li": (frozenset(["li"]), _OWN), "option": (frozenset(["option"]), _OWN), "optgroup": (frozenset(["option", "optgroup"]), _OWN), "dt": (frozenset(["dt", "dd"]), _OWN), "dd": (frozenset(["dt", "dd"]), _OWN),
    "tr": (frozenset(["tr"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
}
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(script|style|noscript|template|title|iframe|svg|object|canvas|audio|video|textarea)\b[^>]*>.*?(?:</\1\s*>|$)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)|([^<]+)|<""",
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
_NAME = re.compile(r"[a-z]+")
LINK = "link alone"  # the mark of words in a link, in a block that holds nothing else
#: What a tag scores; what a word surely outside scores, times -1; how strongly weights are held near 0; the log odds of a word without any mark.
TAG, AGAINST, RIDGE, PRIOR = -0.05, 1.0, 0.05, 0.5


def _marks(name: str, attributes: str) -> tuple[str, ...]:
    """What an element says of its text: its name, and each whole class, id or role in lower case, with its parts if it has several."""
    found = [f"<{name}"] if name != "a" else []
    for m in _ATTR.finditer(attributes):
        for value in m[2].strip("\"'").lower().split():
            parts = _NAME.findall(value)
            found.append("-".join(parts))
            found += [f"{p}-" for p in parts] if len(parts) > 1 else []
    return tuple(found)


class _Open:
    """The open elements of a page, and for each model the sum of the weights of their different marks."""

    def __init__(self, models: tuple[dict[str, float], ...]):
        self.models = models
        self.stack: list[tuple[str, tuple[str, ...], tuple[float, ...]]] = []
        self.names: Counter = Counter()
        self.marks: Counter = Counter()
        self.sums = (PRIOR,) * len(models)

    def push(self, name: str, marks: tuple[str, ...]) -> None:
        self.stack.append((name, marks, self.sums))
        self.names[name] += 1
        new = []
        for m in marks:
            self.marks[m] += 1
            if self.marks[m] == 1:
                new.append(m)
        if new:
            self.sums = tuple(s + sum(w.get(m, 0.0) for m in new) for s, w in zip(self.sums, self.models, strict=True))

    def cut(self, k: int) -> None:
        for name, marks, _ in self.stack[k:]:
            self.names[name] -= 1
            for m in marks:
                self.marks[m] -= 1
                if not self.marks[m]:
                    del self.marks[m]
        self.sums = self.stack[k][2]
        del self.stack[k:]

    def close(self, name: str) -> None:
        if not self.names[name]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == name:
                self.cut(k)
                return

    def close_implied(self, names: frozenset, within: frozenset) -> None:
        """An open element of these names ends where the next begins, unless a list or table of its own is open inside."""
        if not any(self.names[n] for n in names):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in names:
                self.cut(k)
                return
            if self.stack[k][0] in within:
                return


def tokens(page: str, seen) -> list[list]:
    """[what ``seen`` makes of the open elements, text, block, words, in a link?] of each stretch of text; [None, ...] of a tag.

    Words in a link count as a link only where their block holds no words but links."""
    out: list[list] = []
    open_, block = seen.__self__, 0
    bare: dict[int, bool] = {}
    for m in _TOKEN.finditer(page):
        text = m[8]
        if text is None and m[0] == "<":
            text = "<"
        if text is not None:
            if not any(open_.names[n] for n in _UNREAD):
                text = html.unescape(text)
                words, link = len(text.split()), open_.names["a"] > 0
                out.append([seen(), text, block, words, link])
                if words:
                    bare[block] = bare.get(block, True) and link
            continue
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        if name in _BLOCKS:
            block += 1
        out.append([None, " " if name in ("br", "td", "th") else "", block, 0, False])
        if m[2] or m[5]:
            open_.close(name)
            continue
        if name in _VOID:
            continue
        if name == "body":
            open_.close("head")
        if name in _BLOCKS and open_.stack and open_.stack[-1][0] == "p":
            open_.close("p")
        if name in IMPLIED:
            open_.close_implied(*IMPLIED[name])
        # the page as a whole is marked by no class: layouts are named after what they hold
        open_.push(name, _marks(name, m[4] or m[7] or "") if name not in ("html", "body") else ())
    for t in out:
        t[4] = t[4] and bare.get(t[2], False)
    return out


class _Labels(_Open):
    """Open elements that tell all their marks: for the short labelled pages."""

    def __init__(self):
        super().__init__(())

    def now(self) -> frozenset:
        return frozenset(self.marks)


class _Sums(_Open):
    def now(self) -> tuple[float, ...]:
        return self.sums


def _regression(rows: list[frozenset], truth: list[bool], ridge: float, rounds: int) -> dict[str, float]:
    """Weights by mark: a ridge logistic regression by Newton's method."""
    names = sorted({m for row in rows for m in row})
    at = {m: k for k, m in enumerate(names)}
    x, y = np.zeros((len(rows), len(names))), np.array(truth, float)
    for k, row in enumerate(rows):
        x[k, [at[m] for m in row]] = 1.0
    w = np.zeros(len(names))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(PRIOR + x @ w)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(names)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max(initial=0) < 1e-9:
            break
    return {m: float(v) for m, v in zip(names, w, strict=True)}


def fit(labelled=TRAINING, ridge: float = RIDGE, rounds: int = 60) -> tuple[dict[str, float], dict[str, float]]:
    """(weights of 'stands in the article' over all stretches, weights of 'is no interruption' over those within an article's ends), by mark."""
    pages = []
    for page in labelled:
        rows, inside = [], False
        for marks, text, _, _, link in tokens(page, _Labels().now):
            for part in re.split(f"([{BEGIN}{END}])", text) if marks is not None else ():
                if part in (BEGIN, END):
                    inside = part == BEGIN
                elif part.strip():
                    rows.append((marks | {LINK} if link else marks, inside))
        pages.append(rows)
    within = []
    for rows in pages:
        at = [k for k, (_, inside) in enumerate(rows) if inside]
        within += rows[at[0] : at[-1] + 1] if at else []
    return tuple(_regression([m for m, _ in rows], [t for _, t in rows], ridge, rounds) for rows in ([r for rows in pages for r in rows], within))


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the highest sum, the longest of equal ones; (0, 0) if none is positive."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, k
        total += s
        if total > best or (total == best and best > 0 and start == at[0]):
            best, at = total, (start, k + 1)
    return at


def _chance(total: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def main_text(page: str | None, models: tuple[dict[str, float], ...], scan=best_region) -> str:
    if not page:
        return ""
    found = tokens(page, _Sums(models).now)
    link = tuple(w.get(LINK, 0.0) for w in models)
    chance = lambda t, k: _chance(t[0][k] + (link[k] if t[4] else 0.0))

    def score(t) -> float:
        if t[0] is None:
            return TAG
        return (chance(t, 0) * (1 + AGAINST) - AGAINST) * t[3] if chance(t, 1) > 0.5 else 0.0

    start, end = scan([score(t) for t in found])
    parts: dict[int, list[str]] = {}
    for t in found[start:end]:
        if t[1] and (t[0] is None or chance(t, 1) > 0.5):
            parts.setdefault(t[2], []).append(t[1])
    joined = (" ".join("".join(p).split()) for _, p in sorted(parts.items()))
    return "\n\n".join(t for t in joined if t)


def extract(pages: DataFrame, labelled=TRAINING) -> DataFrame:
    """pages with text (never null) and n_chars, its code points."""
    small_batches(pages.sparkSession)
    models = fit(labelled)

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: main_text(p, models) if isinstance(p, str) else "").astype(object)

    return pages.withColumn("text", run("html")).withColumn("n_chars", F.char_length("text").cast("long"))


def digest(pages: DataFrame, **how) -> DataFrame:
    return extract(pages.select("page_id", "url", "html"), **how).select("page_id", "url", "text", "n_chars")
