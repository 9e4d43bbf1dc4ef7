"""URL filters by a sort-merge range join of reversed-host keys with nested rule intervals.

A key is the host's labels reversed, "/", and the path: `org.example//es/1`. A rule is a key prefix, so it covers one
interval of the key order, and two rules' intervals are nested or apart. A url is probed once for each suffix of its host
that is no longer than the longest rule host, so a rule fits subdomains as well. Keys and rules are dealt to ranges of the
key order, sorted, and swept once with a stack of the rules that are open; the stack's top is the longest rule for a key.

Hot hosts and urls: only distinct (host, path) pairs are probed and only distinct keys swept, both pre-aggregated, and
range bounds split a host by its paths. Bounds come from a bounded sample of keys (the SAMPLE a range smallest hashes);
they only balance the ranges and never change the result. Rules are dealt like rows, not broadcast.

Defined cases: a null url, or one without "://", has empty host and path, fits no rule and gets the default verdict; a
path may be empty and then fits only rules with an empty path; of rules with the same host and path, block wins; of
fitting rules of equal length, the one with the longer host wins.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, frugal, materialize, prepare

SAMPLE = 32
LAST = "\U0010ffff"


def url_host(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty without "://"."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to "?", "#" or the end; may be empty."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def _rest(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def reversed_host(host: Column, depth: Column | None = None) -> Column:
    labels = F.reverse(F.split(host, r"\.", -1))
    return F.array_join(F.slice(labels, F.lit(1), depth) if depth is not None else labels, ".")


def rule_table(rules: DataFrame) -> DataFrame:
    """rules: host, path, verdict (allow or block). One row a distinct (host, path): rule, key, verdict, n, host_n."""
    host = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER)
    clean = rules.select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    clean = clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # "block" sorts after "allow"
    return clean.select(
        F.concat("host", "path").alias("rule"), F.concat(reversed_host(F.col("host")), F.lit("/"), F.col("path")).alias("key"), "verdict",
        F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("host_n"), F.size(F.split("host", r"\.", -1)).alias("depth"),
    )


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted events of any number of ranges; keeps the open rules as a stack and yields each key's innermost rule."""
    stack: list[tuple] = []
    here = None
    for batch in batches:
        keys, found = [], []
        for part, key, rule, verdict, n, host_n in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "rule", "verdict", "n", "host_n"))):
            if part != here:
                stack, here = [], part
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if rule is not None:
                stack.append((key, rule, verdict, n, host_n))
            elif stack:
                keys.append(key)
                found.append(stack[-1][1:])
        rule, verdict, n, host_n = zip(*found) if found else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array(n, pa.int32()), pa.array(host_n, pa.int32()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
            ["key", "n", "host_n", "rule", "verdict"],
        )


def innermost_rules(keys: DataFrame, rules: DataFrame, ranges: int | None = None) -> DataFrame:
    """keys: distinct key. rules: as rule_table. Returns key, n, host_n, rule, verdict for the keys that a rule covers."""
    spark = keys.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    picked = keys.select("key", F.xxhash64("key").alias("h")).orderBy("h", "key").limit(ranges * SAMPLE)
    sample = sorted(r[0] for r in picked.collect())  # at most SAMPLE keys a range
    bounds = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []

    def deal(span: bool):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = batch.column("key").to_pylist()
                lows = [bisect_right(bounds, k) for k in values]
                if span:
                    highs = [bisect_left(bounds, k + LAST) for k in values]
                    take = [i for i, (a, b) in enumerate(zip(lows, highs)) for _ in range(a, b + 1)]
                    parts = [p for a, b in zip(lows, highs) for p in range(a, b + 1)]
                    batch = batch.take(pa.array(take, pa.int64()))
                else:
                    parts = lows
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *batch.columns], ["part", *batch.schema.names])

        return work

    columns = "part int, key string, rule string, verdict string, n int, host_n int"
    none = [F.lit(None).cast(t).alias(c) for c, t in (("rule", "string"), ("verdict", "string"), ("n", "int"), ("host_n", "int"))]
    probes = keys.select("key", *none).mapInArrow(frugal(deal(False)), columns)
    covers = rules.select("key", "rule", "verdict", "n", "host_n").mapInArrow(frugal(deal(True)), columns)
    events = probes.unionByName(covers).repartition(ranges, "part")
    # a rule stands before an equal key; of rules, the outer (shorter) key sorts first
    ordered = events.sortWithinPartitions("part", "key", F.col("rule").isNull())
    return ordered.mapInArrow(frugal(_sweep), "key string, n int, host_n int, rule string, verdict string")


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row a page: page_id, host, path, rule (host and path as one string, null if none fits), verdict."""
    prepare(pages.sparkSession)
    table = materialize(rule_table(rules), "url-rules")
    deepest = table.agg(F.max("depth")).first()[0] or 0
    parsed = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    pairs = parsed.select("host", "path").distinct()
    depth = F.explode(F.sequence(F.lit(1), F.least(F.size(F.split("host", r"\.", -1)), F.lit(max(deepest, 1)))))
    probes = pairs.select("host", "path", depth.alias("depth")).select(
        "host", "path", F.concat(reversed_host(F.col("host"), F.col("depth")), F.lit("/"), F.col("path")).alias("key")
    )
    probes = materialize(probes, "url-probes")
    hits = materialize(innermost_rules(probes.select("key").distinct(), table), "url-hits")
    best = probes.join(hits, "key").groupBy("host", "path").agg(F.max(F.struct("n", "host_n", "verdict", "rule")).alias("best"))
    best = materialize(best.select("host", "path", "best.rule", "best.verdict"), "url-best")
    return parsed.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
