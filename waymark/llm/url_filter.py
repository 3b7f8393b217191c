"""URL filters: pattern rules indexed by their rarest literal token.

A rule is ``host/path``: it fits the host and its subdomains where the path starts with the
rule's path; ``*`` in the path stands for any run of characters. Each rule is filed under its
rarest whole token (a host label or a path word, rare among the rules), or under no token
if it has none. A URL's tokens fetch the rules filed under them; only those run their regular
expression. The longest rule that fits decides; of equally long ones the first by text, block
before allow. Where none fits the verdict is ``default``.

The rule list is a parameter of checked size (``MAX_RULES``); it travels with the function.

Defined cases: a null URL, or one without ``://``, has an empty host and path, no rule and
the default verdict. Ports and user names are part of the host, as written. Urls may be of any length; a rule
with several ``*`` may try their places in turn, so lists with such rules cost more on long urls. Repeated rows are
judged each. An empty table gives an empty result. Extra columns pass through ``judge``; those
with an output's name are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii


class Rule(NamedTuple):
    pattern: str
    verdict: str


#: The rules that hold for every run, and the verdict where none fits.
RULES = (Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow"))
DEFAULT = "allow"
#: About 100 bytes a rule in the function that is shipped to each worker.
MAX_RULES = 200_000
_TOKEN = re.compile(r"[^./?#*=&_~%:@!$'()+,;-]+")


def _literal_tokens(pattern: str) -> list[str]:
    """Whole tokens that every fitting URL must hold: the host's labels, and path words with an end on both sides."""
    host, slash, path = pattern.partition("/")
    tokens = [m[0] for m in _TOKEN.finditer(host)]
    path = slash + path
    for m in _TOKEN.finditer(path):
        closed = path[m.start() - 1] != "*" and m.end() < len(path) and path[m.end()] != "*"
        if closed:
            tokens.append(m[0])
    return tokens


def _regex(pattern: str) -> re.Pattern:
    host, slash, path = pattern.partition("/")
    return re.compile(r"(?:[^/]*\.)?" + re.escape(host) + ".*".join(map(re.escape, (slash + path).split("*"))), re.DOTALL)


class RuleIndex:
    def __init__(self, rules=RULES):
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are shipped with the function")
        order = sorted(rules, key=lambda r: (-len(r.pattern), r.pattern, r.verdict != "block"))
        tokens = [_literal_tokens(r.pattern) for r in order]
        seen = Counter(t for ts in tokens for t in set(ts))
        self.by_token: dict[str, list[tuple[int, re.Pattern, Rule]]] = {}
        self.always: list[tuple[int, re.Pattern, Rule]] = []
        for k, (rule, ts) in enumerate(zip(order, tokens, strict=True)):
            entry = (k, _regex(rule.pattern), rule)
            if ts:
                self.by_token.setdefault(min(ts, key=lambda t: (seen[t], -len(t), t)), []).append(entry)
            else:
                self.always.append(entry)

    def find(self, host: str, path: str) -> Rule | None:
        url, found = host + path, list(self.always)
        for t in set(_TOKEN.findall(url)):
            found += self.by_token.get(t, ())
        for _, regex, rule in sorted(found, key=lambda x: x[0]):
            if regex.match(url):
                return rule
        return None


def judge(pages: DataFrame, rules=RULES, default: str = DEFAULT) -> DataFrame:
    """pages with host, path, rule (null if none fits) and verdict."""
    index = RuleIndex(tuple(Rule(*r) for r in rules))

    @F.pandas_udf("rule string, verdict string")
    def find(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        rules = [index.find(h, p) for h, p in zip(host, path, strict=True)]
        return pd.DataFrame({"rule": [r and r.pattern for r in rules], "verdict": [r.verdict if r else default for r in rules]})

    part = lambda k: F.coalesce(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    out = pages.withColumns({"host": lower_ascii(part(1)), "path": part(2)})
    return out.withColumn("__v", find("host", "path")).withColumns({"rule": F.col("__v.rule"), "verdict": F.col("__v.verdict")}).drop("__v")


def digest(pages: DataFrame, **how) -> DataFrame:
    return judge(pages.select("page_id", "url"), **how).select("page_id", "host", "path", "rule", "verdict")


ORACLE = """
WITH p AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p
), r(rule, rhost, rpath, verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), m AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT h.page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM h LEFT JOIN m USING (page_id)
"""
