"""URL filter: a trie over reversed host labels and path segments, broadcast to the tasks.

A rule ``(host, path, verdict)`` fits its host and every subdomain when the URL's path starts with the rule's path.  Of all
fitting rules the longest (host plus path) wins, then the one with the longer host, then ``block``.  Without a fitting rule the
verdict is ``default`` and the rule is null.

Defined results: a null URL or one without ``://`` has an empty host and path; repeated rows are judged alike; an empty table
stays empty; columns of the input named like the added ones are replaced, all others are kept.  Null rule parts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callbrook.llm.common import LOWER, UPPER

VERDICT = "rule string, verdict string"
#: Rules up to this many bytes travel as a broadcast trie; more are joined by a shuffle.
TRIE_BYTES = 64 << 20


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


class Trie:
    """Nodes are dictionaries; ``None`` holds what ends at a node.

    Below the host labels hangs a second trie of whole path segments.  The text after a rule's last slash must only begin the
    URL's next segment, so it is kept in a list at its node.
    """

    def __init__(self, rules):
        self.root: dict = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault(label, {})
            *whole, begun = path.split("/")
            node = node.setdefault(None, {})
            for segment in whole:
                node = node.setdefault(segment, {})
            key = (len(host) + len(path), len(host), verdict == "block")
            node.setdefault(None, []).append((begun, key, host + path, verdict))

    def find(self, host: str, path: str):
        best, segments, node = None, path.split("/"), self.root
        labels = host.split(".") if host else []
        for depth in range(len(labels) + 1):
            if None in node:
                best = self._along(node[None], segments, best)
            node = node.get(labels[-1 - depth]) if depth < len(labels) else None
            if node is None:
                break
        return best

    @staticmethod
    def _along(node: dict, segments: list[str], best):
        for k, segment in enumerate(segments):
            for found in node.get(None, ()):
                if segment.startswith(found[0]) and (best is None or found[1] > best[1]):
                    best = found
            if k + 1 == len(segments) or (node := node.get(segment)) is None:
                break
        return best


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """Add ``host, path, rule, verdict`` to every row of ``pages``; ``rules`` has ``host, path, verdict``."""
    rules = rules.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("host", "path", "verdict"))).distinct()
    size = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 200)).first()[0] or 0
    u = F.col(url)
    rest = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    base = pages.withColumns({"__host": host_of(u), "__path": path_of(u)})
    if size <= trie_bytes:
        trie = pages.sparkSession.sparkContext.broadcast(Trie((r.host, r.path, r.verdict) for r in rules.toLocalIterator()))

        @F.pandas_udf(VERDICT)
        def judge(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for hosts, paths in parts:
                found = [trie.value.find(h, p) for h, p in zip(hosts, paths, strict=True)]
                yield pd.DataFrame({"rule": [f and f[2] for f in found], "verdict": [f[3] if f else default for f in found]})

        judged = base.withColumn("__v", judge("__host", "__path"))
    else:
        judged = _by_join(base, rules, default)
    return judged.select(*rest, F.col("__host").alias("host"), F.col("__path").alias("path"), "__v.rule", "__v.verdict")


def _by_join(base: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """Beyond the broadcast bound: every host suffix meets its rules by a join on the distinct URLs, pre-aggregated to one row."""
    urls = base.select("__host", "__path").distinct()
    suffix = F.expr("transform(sequence(0, size(split(__host, '[.]'))), i -> substring_index(__host, '.', -i))")
    cut = urls.withColumn("h", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), suffix))))
    # a rule's path up to its last slash is one of the URL's whole-segment prefixes
    whole = F.expr("transform(sequence(0, size(split(__path, '/')) - 1), i -> if(i = 0, '', concat(substring_index(__path, '/', i), '/')))")
    cut = cut.withColumn("stem", F.explode(whole))
    r = rules.select(F.col("host").alias("h"), F.col("path").alias("p"), F.col("verdict").alias("v"),
                     F.regexp_extract("path", r"(?s)^(.*/)?", 0).alias("stem"))
    fits = cut.join(r, ["h", "stem"]).filter(F.col("__path").startswith(F.col("p")))
    rank = F.struct(F.length("h") + F.length("p"), F.length("h"), F.col("v") == "block")
    best = fits.groupBy("__host", "__path").agg(F.max_by(F.struct(F.concat("h", "p").alias("rule"), F.col("v").alias("verdict")), rank).alias("__v"))
    out = base.join(best, ["__host", "__path"], "left")
    return out.withColumn("__v", F.coalesce("__v", F.struct(F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))))
