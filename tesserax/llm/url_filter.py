"""URL filter: a trie over reversed host labels, then path segments; the longest fitting rule decides.

A rule (verdict, host, path) fits its host and every subdomain when the url's path starts with the rule's path. Null urls
and urls without `://` have an empty host and path and take the default verdict. The trie is shipped to the executors
only while it has at most MAX_TRIE_RULES rules; a longer list is joined instead, with the same results.
"""

from __future__ import annotations

import string
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserax.llm.common import fresh

#: Above so many rules (some tens of MB as a trie) rules are joined, not broadcast.
MAX_TRIE_RULES = 100_000


def with_host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    """host: after the first `://` up to `/`, `?`, `#`, A-Z lower-cased. path: from there up to `?`, `#`. Else both empty."""
    part = lambda k: F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return df.withColumns({"host": F.translate(part(1), string.ascii_uppercase, string.ascii_lowercase), "path": part(2)})


class HostPathTrie:
    """Nodes are dicts: host labels from the right, then, under None, path segments; under "" the rules that end there.

    A rule's path is kept as its whole segments (an edge each) and a rest without a slash, which must start the url's next
    segment. The deepest host node and path node that fit belong to the longest rule.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            *whole, rest = path.split("/")
            node = node.setdefault(None, {})
            for segment in whole:
                node = node.setdefault(("/", segment), {})
            node.setdefault("", []).append((len(host) + len(path), len(host), verdict, host + path, rest))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule that fits; of equally long ones, that with the longer host, then block."""
        best, node, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            at, k = node.get(None), 0
            while at is not None:
                for rule in at.get("", ()):
                    if segments[k].startswith(rule[4]) and (best is None or rule > best):
                        best = rule
                at = at.get(("/", segments[k])) if k + 1 < len(segments) else None
                k += 1
        return best and best[2:4]


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict. rule is null where none fits, and verdict then `default`.

    Columns of pages with these names are replaced; all others are kept. Empty rules or pages give the defaults or no row.
    """
    df = with_host_and_path(pages, url)
    if len(rules) > MAX_TRIE_RULES:
        return _joined(df, rules, default)
    trie = HostPathTrie(rules)

    @F.pandas_udf("struct<verdict:string, rule:string>")
    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        found = [trie.match(h, p) or (default, None) for h, p in zip(host, path, strict=True)]
        return pd.DataFrame(found, columns=["verdict", "rule"], dtype=object)

    (name,) = fresh(df, "found")
    found = df.withColumn(name, judge("host", "path"))
    return found.withColumns({"rule": F.col(name)["rule"], "verdict": F.col(name)["verdict"]}).drop(name)


def _joined(df: DataFrame, rules: list[tuple[str, str, str]], default: str) -> DataFrame:
    """The same by equi-join: every (host suffix, path up to a slash) of a distinct url against the rules' keys."""
    spark = df.sparkSession
    r = spark.createDataFrame([(h, p[: p.rfind("/") + 1], p, v) for v, h, p in rules], "rule_host string, stem string, rule_path string, v string")
    urls = df.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    parts = F.split("path", "/")
    stems = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))))
    keys = urls.withColumn("rule_host", F.explode(ends)).withColumn("stem", F.explode(stems))
    fits = keys.join(r, ["rule_host", "stem"]).filter(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    rank = F.struct(F.length(rule).alias("n"), F.length("rule_host").alias("h"), F.col("v").alias("verdict"), rule.alias("rule"))
    (name,) = fresh(df, "best")
    best = fits.groupBy("host", "path").agg(F.max(rank).alias(name))
    out = df.join(best, ["host", "path"], "left")
    return out.withColumns({"rule": F.col(name)["rule"], "verdict": F.coalesce(F.col(name)["verdict"], F.lit(default))}).drop(name)
