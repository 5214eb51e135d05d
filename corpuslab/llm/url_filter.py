"""URL rules in a trie over reversed host labels and path segments.

A rule is (host, path, verdict). It fits its host and all subdomains when the url's
path starts with the rule's path. The longest fitting rule wins: more host labels
first, then the longer path; of two equal rules with different verdicts, block wins.

Defined cases: a null url or one without `://` has an empty host and path; without a
fitting rule the verdict is `default`, or `no_host` for an empty host. Repeated rows
are judged alike, extra columns stay (those named like the operator's are replaced), an empty table gives an empty one.
"""
from collections.abc import Iterable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.columns import free
from corpuslab.llm.words import lower_ascii

#: Rules up to this many characters are sent to every task as a trie; larger lists are joined.
TRIE_CHARS = 32_000_000

VERDICT = "rule string, verdict string"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


class Trie:
    """Nodes are dicts: host labels under their name, path segments under `/name`.

    A rule's path ends within a segment; its last, possibly partial segment is kept in
    the node's `ends` as text -> (rule, verdict).
    """

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.setdefault(label, {})
            *whole, last = rule.path.split("/")
            for segment in whole:
                node = node.setdefault("/" + segment, {})
            ends = node.setdefault(None, {})
            if ends.get(last, (None, "allow"))[1] == "allow":
                ends[last] = (rule.name, rule.verdict)

    def longest(self, host: str, path: str):
        """(rule, verdict) of the deepest fitting entry, or None."""
        chain, node = [self.root], self.root
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            chain.append(node)
        segments = path.split("/")
        for node in reversed(chain[1:]):
            best = None
            for segment in segments:
                for end, found in node.get(None, {}).items():
                    if segment.startswith(end) and (best is None or len(found[0]) > len(best[0])):
                        best = found
                node = node.get("/" + segment)
                if node is None:
                    break
            if best:
                return best
        return None


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow", no_host: str = "block",
          trie_chars: int = TRIE_CHARS) -> DataFrame:
    """Add host, path, rule (null if none fits) and verdict to `pages` (column url)."""
    pages = free(pages, "host", "path", "rule", "verdict", "_found", "_h", "_p").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    if sum(len(r.name) for r in rules) <= trie_chars:
        found = _by_trie(pages, rules)
    else:
        found = _by_join(pages, rules)
    missing = F.when(F.col("host") == "", no_host).otherwise(default)
    return (
        found.withColumn("rule", F.col("_found.rule"))
        .withColumn("verdict", F.coalesce(F.col("_found.verdict"), missing))
        .drop("_found")
    )


def _by_trie(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    shared = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf(VERDICT)
    def look_up(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        longest = shared.value.longest
        found = [longest(h, p) or (None, None) for h, p in zip(host, path)]
        return pd.DataFrame(found, columns=["rule", "verdict"])

    return pages.withColumn("_found", look_up("host", "path"))


def _by_join(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """For lists beyond the trie's size: equal keys (host suffix, whole segments) meet in a
    join of the distinct urls, whose longest rule then joins back."""
    spark = pages.sparkSession
    listed = (
        spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")
        .groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))
        .withColumn("rule_key", F.concat("rule_host", F.regexp_extract("rule_path", "^.*/|^", 0)))
    )
    labels, segments = F.split("host", "[.]"), F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(
        F.sequence(F.lit(0), F.size(segments) - 1),
        lambda i: F.when(i == 0, "").otherwise(F.concat(F.array_join(F.slice(segments, 1, i), "/"), F.lit("/"))),
    )
    keyed = (
        pages.select("host", "path").distinct()
        .select("host", "path", F.explode(suffixes).alias("suffix"))
        .select("host", "path", "suffix", F.explode(prefixes).alias("prefix"))
    )
    fits = keyed.join(
        listed,
        (F.concat("suffix", "prefix") == F.col("rule_key")) & (F.col("suffix") == F.col("rule_host")) & F.expr("startswith(path, rule_path)"),
    )
    size = F.struct(F.length("rule_host"), F.length("rule_path"))
    found = fits.groupBy(F.col("host").alias("_h"), F.col("path").alias("_p")).agg(
        F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")), size).alias("_found")
    )
    return pages.join(found, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left").drop("_h", "_p")
