"""URL rules as a sort-merge range join.

A host is written as its labels in reverse order, each followed by a comma, so that a host and all its subdomains are one
interval of the sorted keys. Rules and urls are dealt into the same key ranges (a rule to
every range that its interval meets), sorted together, and swept once: a stack holds the nested rules whose interval is
open, and a url is judged against that stack alone.

Of the rules that fit, the longest (host and path) wins; of equally long ones that with the longer host, then block.

Defined cases: a null url, or one without ``://``, has empty host and path and no rule; repeated rows each get their own
answer; a rule with null host fits nothing and a null path counts as empty; empty tables give empty
results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts
from .ranges import cut_points, range_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LAST = "\U0010ffff"
ROWS = "range int, key string, kind int, path string, page_id long, host string, verdict string"
OUT = "page_id long, host string, path string, rule string, verdict string"


def canonical(host: str) -> str:
    return "".join(f"{x}," for x in reversed(host.split(".")))


def with_parts(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, key) of each url."""
    url = F.col("url").cast("string")
    found = url.contains("://")
    host = F.regexp_extract(url, r"://([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.when(found, host).otherwise("").alias("host"),
        F.when(found, F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)).otherwise("").alias("path"),
    )
    key = F.concat(F.array_join(F.reverse(F.split("host", r"\.", -1)), ","), F.lit(","))
    return cut.withColumn("key", key)


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (range, key, kind, path, page_id): rules (kind 0) stand before the urls with their key."""
    stack: list[tuple[str, list[tuple[str, str, str]]]] = []
    now = None
    for batch in batches:
        out: list[tuple] = []
        for which, key, kind, path, page_id, host, verdict in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            if which != now:
                now, stack = which, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, []))
                stack[-1][1].append((host, path, verdict))
                continue
            best = None
            for _, rules in stack:
                for at, start, says in rules:
                    if path.startswith(start) and (host == at or host.endswith("." + at)):
                        rank = (len(at) + len(start), len(at), says == "block")
                        if best is None or rank > best[0]:
                            best = rank, at + start, says
            out.append((page_id, host, path, best and best[1], best and best[2]))
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:])], names=["page_id", "host", "path", "rule", "verdict"]
        )


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", ranges: int | None = None) -> DataFrame:
    """``rules`` (host, path, verdict) over ``pages`` (page_id, url); ``otherwise`` where no rule fits."""
    urls = with_parts(pages)
    cuts = cut_points(urls, ["key", "path", "page_id"], ranges or parts(pages.sparkSession))
    cuts = [tuple("" if v is None else v for v in c[:2]) + (-(1 << 63) if c[2] is None else c[2],) for c in cuts]

    def deal_urls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            page_id, host, path, key = (b.column(i).to_pylist() for i in range(4))
            which = [range_of(cuts, (k, p, -(1 << 63) if i is None else i)) for k, p, i in zip(key, path, page_id, strict=True)]
            n = len(which)
            yield pa.RecordBatch.from_arrays(
                [pa.array(which, pa.int32()), b.column(3), pa.array([1] * n, pa.int32()), b.column(2), b.column(0), b.column(1), pa.nulls(n, pa.string())],
                names=["range", "key", "kind", "path", "page_id", "host", "verdict"],
            )

    def deal_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for host, path, verdict in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if host is not None:
                    key = canonical(host.translate(LOWER))
                    for which in range(range_of(cuts, (key, "", -(1 << 63))), range_of(cuts, (key + LAST, LAST, 1 << 63)) + 1):
                        rows.append((which, key, 0, path or "", None, host.translate(LOWER), verdict))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["range", "key", "kind", "path", "page_id", "host", "verdict"])

    rows = urls.mapInArrow(deal_urls, ROWS).union(rules.select("host", "path", "verdict").mapInArrow(deal_rules, ROWS))
    rows = rows.repartition(len(cuts) + 1, "range").sortWithinPartitions("range", "key", "kind", "path", "page_id")
    return rows.mapInArrow(sweep, OUT).withColumn("verdict", F.coalesce("verdict", F.lit(otherwise)))
