"""URL filtering with a broadcast trie over reversed host labels and path segments.

The trie goes from the last host label to the first, and from any host node on
through the segments of the path. One walk per url meets every rule that fits;
the deepest one decides, so an allow rule below a blocked domain wins over it
and a block rule below an allowed one wins back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagedex.llm.common import column

ALLOW, BLOCK = "allow", "block"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# Largest rule list one trie is built from. A trie is some 40 times its text, so
# this keeps a worker below half a gigabyte; longer lists are refused.
MAX_RULE_BYTES = 8 << 20


def split_url(url: str | None) -> tuple[str, str]:
    """Host, lower-cased in A-Z, and path of a url; both empty without `://`."""
    if url is None:
        return "", ""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return host.translate(UPPER), slash + path


class RuleTrie:
    """Rules (host, path prefix, action); the most specific fitting rule wins.

    Specific means more host labels first, then a longer path. Of rules with the
    same host and path the blocking one counts.
    """

    def __init__(self, rules: list[tuple[str, str, str]]) -> None:
        self._root: dict = {}
        for host, path, action in rules:
            if action not in (ALLOW, BLOCK):
                raise ValueError(f"action must be {ALLOW} or {BLOCK}: {action!r}")
            node = self._root
            for label in reversed(host.translate(UPPER).split(".")) if host else ():
                node = node.setdefault("hosts", {}).setdefault(label, {})
            *segments, start = path.split("/")
            node = node.setdefault("paths", {})
            for segment in segments:
                node = node.setdefault("next", {}).setdefault(segment, {})
            # What follows the last slash may end inside a segment.
            starts = node.setdefault("starts", {})
            if starts.get(start, (None, ALLOW))[1] == ALLOW:
                starts[start] = (host + path, action)

    @staticmethod
    def _longest(paths: dict, segments: list[str]) -> tuple[str, str] | None:
        node, best = paths, None
        for segment in segments:
            fitting = [s for s in node.get("starts", ()) if segment.startswith(s)]
            if fitting:
                best = node["starts"][max(fitting, key=len)]
            node = node.get("next", {}).get(segment)
            if node is None:
                break
        return best

    def decide(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, action) of the longest match, or None."""
        segments, node, best = path.split("/"), self._root, None
        labels = host.split(".") if host else []
        while node is not None:
            if "paths" in node:
                best = self._longest(node["paths"], segments) or best
            node = node.get("hosts", {}).get(labels.pop()) if labels else None
        return best


def load_rules(rules: DataFrame) -> list[tuple[str, str, str]]:
    """The rule table (host, path, action) as a list, after a check of its size.

    Rows with a null host, path or action are no rules.
    """
    rules = rules.select("host", "path", "action").dropna()
    size = rules.select(F.sum(F.octet_length("host") + F.octet_length("path") + 8)).first()[0] or 0
    if size > MAX_RULE_BYTES:
        raise ValueError(f"{size} bytes of rules are over the bound of {MAX_RULE_BYTES}")
    return sorted((r.host, r.path, r.action) for r in rules.collect())


def judged(
    spark: SparkSession,
    url: Column,
    rules: list[tuple[str, str, str]],
    otherwise: str = ALLOW,
) -> Column:
    """struct(host, path, rule, verdict) of a url column.

    A rule fits its host and all subdomains where the url's path starts with the
    rule's. Where none fits, `rule` is null and the verdict is `otherwise`; so it
    is for null urls and urls without `://`, whose host and path are empty.
    """
    size = sum(len(h.encode()) + len(p.encode()) + 8 for h, p, _ in rules)
    if size > MAX_RULE_BYTES:
        raise ValueError(f"{size} bytes of rules are over the bound of {MAX_RULE_BYTES}")
    shared = spark.sparkContext.broadcast(RuleTrie(rules))

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trie = shared.value
        for urls in batches:
            rows = []
            for url in urls:
                host, path = split_url(url)
                rows.append((host, path, *(trie.decide(host, path) or (None, otherwise))))
            yield pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"], dtype=object)

    return judge(url)


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    url: str = "url",
    otherwise: str = ALLOW,
) -> DataFrame:
    """The rows whose url is allowed, with all their columns; repeated rows stay repeated."""
    verdict = judged(pages.sparkSession, column(pages, url), rules, otherwise)["verdict"]
    return pages.where(verdict == ALLOW)
