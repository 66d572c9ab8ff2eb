"""URL filters by a sort-merge range join.

A host written from its last label on turns "this host and its subdomains" into a prefix, and a rule into an interval of the
ordered keys.  Rules and urls, each once, are put in this one order and swept: a stack holds the hosts whose interval is open,
each inside the one below it, with their rules; a url takes the longest rule among those whose path its own begins with.
The ordered keys are cut into ranges; a rule goes to every range that its interval reaches into.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fabsight.llm.common import durable, session
from fabsight.session import range_partitions

DEFAULT = "allow"
#: Sampled keys for each range whose borders they give.
SAMPLED = 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    """The labels of the host, last one first, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def _fitting(rules: dict[str, str], lengths: list[int], path: str) -> str | None:
    """The longest path among the rules that ``path`` begins with; ``lengths``: theirs, longest first."""
    return next((path[:n] for n in lengths if n <= len(path) and path[:n] in rules), None)


def match_rules(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) for the distinct keys (host, path) that a rule fits; the longest rule wins.

    ``rules``: host, path, verdict, with distinct (host, path).  Each key is one row of the sweep, whatever the rules.
    """
    known = rules.select("host", "path", "verdict", reversed_host(F.col("host")).alias("key"))
    asked = keys.select("host", "path", reversed_host(F.col("host")).alias("key"))
    parts = range_partitions(keys)
    total = asked.count()
    # borders of the ranges: a sample of bounded size, which decides only what goes where
    taken = asked.sample(min(1.0, SAMPLED * parts / max(1, total)), seed=3).select("key", "path").limit(4 * SAMPLED * parts).collect()
    taken = sorted({(r.key.encode(), r.path.encode()) for r in taken})
    step = max(1, len(taken) // parts)
    borders = taken[step::step]

    def deal_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ranges = [bisect_right(borders, (k.encode(), p.encode())) for k, p in zip(b.column(2).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), *b.columns], names=["range", "host", "path", "key"])

    def deal_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, ranges = [], []
            for i, k in enumerate(b.column(2).to_pylist()):
                # a key with this prefix lies before the prefix and a byte that no UTF-8 text holds
                reach = range(bisect_right(borders, (k.encode(), b"")), bisect_left(borders, (k.encode() + b"\xff", b"")) + 1)
                rows += [i] * len(reach)
                ranges += reach
            out = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), *out.columns], names=["range", "host", "path", "key", "verdict"])

    left = known.select("host", "path", "key", "verdict").mapInArrow(deal_rules, "range int, host string, path string, key string, verdict string")
    right = asked.mapInArrow(deal_keys, "range int, host string, path string, key string").withColumn("verdict", F.lit(None).cast("string"))
    line = left.unionByName(right).repartition(parts, "range").sortWithinPartitions("range", "key", F.col("verdict").isNull(), "path")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, str, dict[str, str], list[int]]] = []  # key, host, verdicts by path and lengths of the paths of an open host
        place = None
        for b in batches:
            out = []
            for r, host, path, key, verdict in zip(*(c.to_pylist() for c in b.columns)):
                if r != place:
                    place = r
                    stack.clear()
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if verdict is not None:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, host, {}, []))
                    _, _, paths, lengths = stack[-1]
                    paths[path] = verdict
                    if len(path) not in lengths:
                        insort(lengths, len(path), key=lambda n: -n)
                    continue
                fits = [(len(h) + len(p), len(h), h + p, paths[p]) for _, h, paths, lengths in stack if (p := _fitting(paths, lengths, path)) is not None]
                if fits:
                    out.append((host, path, *max(fits)[2:]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["host", "path", "rule", "verdict"])

    return line.mapInArrow(sweep, "host string, path string, rule string, verdict string")


def judge_urls(rows: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row.

    A rule (host, path, verdict) fits its host and all subdomains if the url's path begins with its path; the longest rule
    wins, the one of the longer host among equally long; equal rules that disagree block.  A url that no rule fits gets the
    default verdict and a null rule.  Null urls and urls without ``://`` have empty host and path.  Repeated rows are judged
    once and come back as often; rules with nulls fit nothing; other columns are ignored; no rows give no rows, no rules the
    default.  Only different (host, path) are swept, so copies of a url cost nothing there.
    """
    session(rows.sparkSession)
    host, path = host_and_path(F.col(url_col))
    pages = rows.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    distinct = durable(pages.select("host", "path").distinct())
    clean = rules.select("host", "path", "verdict").dropna().groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    found = match_rules(distinct, clean)
    return pages.join(found, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
