"""Operator 3, URL filters: a broadcast trie over reversed host labels, then path segments.

A rule is (verdict, host, path). It fits its host and all subdomains when the url's path starts with the rule's path.
The longest rule wins: more host labels first, then the longer path; of equal rules, block wins.

Defined cases: a null url, or one without ``://``, has empty host and path, which only a rule with an empty host fits;
without a fitting rule the verdict is ``default`` and the rule null; repeated rows are all judged; urls may be of any length. Host and path are compared as bytes after A-Z of
the host are lower-cased; columns that bear names of the result are replaced, all others are kept, whatever their names. Rules are broadcast in tries of at most ``slice_bytes``
of rule text; each further trie is a pass over a table in the shared folder, and the longest rule of all wins.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_names, materialize, quoted

#: The rules of the query.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Trie:
    """Nodes are [children, last-segment prefixes]; hosts' labels from the right, then path segments."""

    def __init__(self, rules):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault("labels", {}).setdefault(label, {})
            *whole, last = path.split("/")
            node = node.setdefault("paths", {})
            for segment in whole:
                node = node.setdefault("segments", {}).setdefault(segment, {})
            ends = node.setdefault("ends", {})
            if ends.get(last, ("",))[0] != "block":
                ends[last] = (verdict, host + path, host.count(".") + 1 if host else 0, len(path))

    @staticmethod
    def _path(paths: dict, segments: list[str]):
        best, node = None, paths
        for i, segment in enumerate(segments):
            fits = [e for e in node.get("ends", ()) if segment.startswith(e)]
            if fits:
                best = node["ends"][max(fits, key=len)]
            node = node.get("segments", {}).get(segment) if i < len(segments) - 1 else None
            if node is None:
                break
        return best

    def find(self, host: str, path: str):
        """(verdict, rule, labels of its host, length of its path) of the longest rule that fits, or None."""
        segments = path.split("/")
        node, best = self.root, None
        for label in [None, *(reversed(host.split(".")) if host else ())]:
            if label is not None:
                node = node.get("labels", {}).get(label)
                if node is None:
                    break
            if "paths" in node:
                best = self._path(node["paths"], segments) or best
        return best


def _slices(rules, slice_bytes: int) -> list[list]:
    out, size = [[]], 0
    for rule in rules:
        n = len(rule[1]) + len(rule[2])
        if out[-1] and size + n > slice_bytes:
            out.append([])
            size = 0
        out[-1].append(rule)
        size += n
    return out


#: A judgement: of two, the greater one wins, by labels, length of the path, and block before allow.
JUDGED = "struct<labels:int,length:int,block:int,rule:string,verdict:string>"


def judge_urls(pages: DataFrame, rules, default: str = "allow", url: str = "url", slice_bytes: int = 16 << 20) -> DataFrame:
    """``pages`` with host, path, rule and verdict (columns of those names are replaced)."""

    def looker(trie):
        @F.pandas_udf(JUDGED)
        def look_up(host: pd.Series, path: pd.Series) -> pd.DataFrame:
            found = [trie.value.find(h, p) for h, p in zip(host, path)]
            rows = [(-1, -1, -1, None, default) if f is None else (f[2], f[3], int(f[0] == "block"), f[1], f[0]) for f in found]
            return pd.DataFrame(rows, columns=["labels", "length", "block", "rule", "verdict"])

        return look_up

    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    (judged,) = fresh_names(pages, "judged")
    (address,) = quoted([url])
    after = F.when(F.instr(address, "://") > 0, F.substring(address, F.instr(address, "://") + 3, F.length(address)))
    host = F.translate(F.coalesce(F.regexp_extract(after, r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)
    path = F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    out = pages.select(*quoted(keep), host.alias("host"), path.alias("path"))
    for k, some in enumerate(_slices(rules, slice_bytes)):
        found = looker(out.sparkSession.sparkContext.broadcast(Trie(some)))("host", "path")
        out = materialize(out, "judged").withColumn(judged, F.greatest(judged, found)) if k else out.withColumn(judged, found)
    return out.select(*quoted(keep), "host", "path", F.col(judged)["rule"].alias("rule"), F.col(judged)["verdict"].alias("verdict"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), RULES).drop("url")


ORACLE_SQL = r"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS x FROM pages),
u AS (SELECT page_id, translate(regexp_extract(x, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(x, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r(v, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/'))
SELECT page_id, host, path, max_by(h || p, length(h) * 1000 + length(p)) AS rule, coalesce(max_by(v, length(h) * 1000 + length(p)), 'allow') AS verdict
FROM (SELECT row_number() OVER () AS n, * FROM u) LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
GROUP BY n, page_id, host, path
"""
