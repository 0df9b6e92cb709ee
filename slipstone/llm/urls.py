"""URL filter: a trie over reversed host labels and path segments, broadcast to every task."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/ ? #``, A-Z lowered) and path; both empty without."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, parts, 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


@dataclass
class _Node:
    below: dict[str, _Node] = field(default_factory=dict)
    paths: _Node | None = None
    #: last segments of rules that end here, each a prefix of the url's segment
    ends: dict[str, tuple[str, str]] = field(default_factory=dict)


class UrlTrie:
    """Rules (verdict, host, path); block goes before allow where both name the same place."""

    def __init__(self, rules: list[tuple[str, str, str]]) -> None:
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules exceed the broadcast bound of {MAX_RULES}")
        self.top = _Node()
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"unknown verdict {verdict!r}")
            self._add(verdict, host, path)

    def _add(self, verdict: str, host: str, path: str) -> None:
        node = self.top
        for label in reversed(host.split(".")):
            node = node.below.setdefault(label, _Node())
        node.paths = node.paths or _Node()
        node = node.paths
        *whole, last = path.split("/")
        for segment in whole:
            node = node.below.setdefault(segment, _Node())
        known = node.ends.get(last)
        if known is None or (known[1] == "allow" and verdict == "block"):
            node.ends[last] = (host + path, verdict)

    @staticmethod
    def _longest(node: _Node, path: str) -> tuple[str, str] | None:
        best = None
        for segment in path.split("/"):
            if node.ends:
                fitting = [end for end in node.ends if segment.startswith(end)]
                if fitting:
                    best = node.ends[max(fitting, key=len)]
            node = node.below.get(segment)
            if node is None:
                break
        return best

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict) of the rule with the most host labels, then the longest path."""
        node, best = self.top, None
        for label in reversed(host.split(".")):
            node = node.below.get(label)
            if node is None:
                break
            if node.paths is not None:
                best = self._longest(node.paths, path) or best
        return best or (None, None)


def judge(
    pages: DataFrame, rules: list[tuple[str, str, str]], *, default: str = "allow", carry: tuple[str, ...] = ()
) -> DataFrame:
    """``carry`` columns with host, path, rule and verdict for every row.

    A rule fits its host and all subdomains when the url's path starts with the rule's path.
    The rule with the most host labels wins, then the longest path, then block before allow;
    without one the verdict is ``default`` and rule is null. Null urls and urls without
    ``://`` have empty host and path. ``rules`` is a parameter of at most ``MAX_RULES`` entries.
    """
    shared = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))
    host, path = host_and_path(F.col("url"))
    kept = [c for c in carry if c not in ("host", "path", "rule", "verdict")]

    @F.pandas_udf("rule string, verdict string")
    def verdicts(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        find = shared.value.find
        found = [find(h, p) for h, p in zip(hosts, paths, strict=True)]
        return pd.DataFrame({"rule": [f[0] for f in found], "verdict": [f[1] for f in found]})

    parsed = pages.select(*kept, host.alias("host"), path.alias("path"))
    ruled = parsed.withColumn("found", verdicts("host", "path"))
    return ruled.select(
        *kept, "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), F.lit(default)).alias("verdict"),
    )
