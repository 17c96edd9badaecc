"""URL filter: a trie over reversed host labels and path segments; the longest rule that fits decides.

The trie is made from the rules on the driver and broadcast with the task; a rule list is a parameter of some thousands
of entries at most (MAX_RULES, checked), urls are judged where they are read, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as bl

#: (verdict, host, path): the rule fits its host and all subdomains if the url's path starts with its path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
MAX_RULES = 1_000_000
DEFAULT = "allow"
RULE = 0  # key of a node's rule; labels and segments are strings


def build(rules: list[tuple[str, str, str]]) -> dict:
    """host labels from the last to the first, then None, then path segments. A path that ends in / is whole segments; the rest of
    another is a prefix of the next segment."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the trie is sent to every task and holds at most {MAX_RULES}")
    root: dict = {}
    for verdict, host, path in rules:
        node = root
        for label in reversed(host.lower().split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(None, {})
        *whole, tail = path.split("/")
        for segment in whole:
            node = node.setdefault(segment, {})
        node.setdefault(RULE, []).append((tail, host + path, verdict))
    return root


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): the host after the first :// up to /, ?, # or the end, A-Z in lower case; the path from there up to ? or #."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3:]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[cut:]
    end = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]


def match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits: more of the host first, then more of the path."""
    best, node, segments = None, trie, path.split("/")
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        at = node.get(None)
        depth = 0
        found = None
        while at is not None:
            rest = segments[depth] if depth < len(segments) else None
            fits = [r for r in at.get(RULE, ()) if rest is not None and rest.startswith(r[0])]
            if fits:
                found = max(fits, key=lambda r: len(r[0]))
            # a segment counts as whole only if a / follows it
            at = at.get(segments[depth]) if depth + 1 < len(segments) else None
            depth += 1
        if found:
            best = found
    return best and (best[1], best[2])


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """pages with host, path, rule (null without one) and verdict. Null urls and urls without :// have an empty host and path and get the
    default, as do all that no rule fits. Of equal rules the first counts. Input columns with the names of results are replaced."""
    names = ["host", "path", "rule", "verdict"]
    rest = [c for c in pages.columns if c not in names]
    held = pages.select(F.struct(*[f"`{c}`" for c in rest]).alias("row"), F.col(f"`{url_col}`").cast("string").alias("url"))
    trie = pages.sparkSession.sparkContext.broadcast(build(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split_url(u) for u in batch.column("url").to_pylist()]
            found = [match(trie.value, *p) or (None, default) for p in parts]
            columns = [[p[0] for p in parts], [p[1] for p in parts], [f[0] for f in found], [f[1] for f in found]]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c, pa.string()) for c in columns)], names=["row", *names])

    kind = held.schema["row"].dataType.simpleString()
    return held.mapInArrow(run, f"row {kind}, " + ", ".join(f"{c} string" for c in names)).select("row.*", *names)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    bl.prepare(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, RULES).drop("url")


_REST = "CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END"
OP4_SQL = f"""
WITH u AS (SELECT page_id, {_REST} AS rest FROM pages),
     s AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*', 0) AS raw_host, rest FROM u),
     p AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*', 0) AS path FROM s),
     r AS (SELECT *, CASE
             WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
             WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
             WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
             WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
