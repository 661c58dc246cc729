"""URL allow and block lists matched by a trie.

The trie goes over reversed host labels, then path segments. A rule
``host/path`` fits its host and every subdomain if the url's path starts with
the rule's path, so its last path segment is matched as a prefix. The longest
host wins, then the longest path; the same rule given twice with both
verdicts blocks. Urls that no rule fits get the default verdict.

Cases: null urls and urls without ``://`` have an empty host and path, and
get the default verdict; an empty table gives no rows; other columns are not
read. The rules are a parameter of at most ``MAX_RULES`` entries, which bounds
what is broadcast; more are refused.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lossframe.llm.common import table

MAX_RULES = 200_000
#: The contract's rules: (verdict, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


class Trie:
    """Nodes are dicts: a host label or ("/", segment) leads to a child; ENDS lists what a last segment may start with."""

    ENDS = ("ends",)

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: dict = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            if not host or not slash or verdict not in ("allow", "block"):
                raise ValueError(f"not a rule: {verdict} {rule}")
            node = self.root
            for label in reversed(host.lower().split(".")):
                node = node.setdefault(label, {})
            *inner, last = path.split("/")
            for segment in inner:
                node = node.setdefault(("/", segment), {})
            ends = node.setdefault(self.ENDS, {})
            ends[last] = (rule, "block" if "block" in (verdict, ends.get(last, ("", ""))[1]) else verdict)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest match."""
        if not path.startswith("/"):
            return None
        segments = path.split("/")[1:]
        best, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            best = self._path(node, segments) or best
        return best

    def _path(self, node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            if ends := node.get(self.ENDS):
                for n in range(len(segment), -1, -1) if len(segment) < len(ends) else sorted(map(len, ends), reverse=True):
                    if found := ends.get(segment[:n]):
                        best = found
                        break
            node = node.get(("/", segment))
            if node is None:
                break
        return best


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def judged(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to page_id and url."""
    rules = list(rules)
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        match = trie.value.match
        for hosts, paths in parts:
            found = [match(h, p) or (None, default) for h, p in zip(hosts, paths)]
            yield pd.DataFrame(found, columns=["rule", "verdict"])

    judge = judge.asNondeterministic()  # else a filter on its result would run it twice
    url = F.col("url")
    rows = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    return rows.withColumn("j", judge("host", "path")).select("page_id", "url", "host", "path", "j.rule", "j.verdict")


def allowed(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, default: str = "allow") -> DataFrame:
    """The pages whose url is not blocked."""
    return judged(pages, rules, default).filter("verdict = 'allow'")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id, translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                            ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) AS v(rh, rp, verdict)),
m AS (SELECT page_id, arg_max(rh || rp, (length(rh), length(rp))) AS rule, arg_max(verdict, (length(rh), length(rp))) AS verdict
      FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""
