"""Sharding by a Feistel permutation with cycle walking over global row numbers.

The rows get their global number in the order of id and text checksum. A keyed Feistel network on the
pair (left, right) with number = left * b + right permutes 0 .. a*b-1 for the least square-like a*b >= n;
numbers that fall outside 0 .. n-1 walk on through the permutation until they are inside, so 0 .. n-1 is permuted.
Position p lies in shard p mod s at slot p div s: both are computable from the number, and shard counts are at most one apart.

Defined results: a null text counts as no bytes and as the checksum of no bytes; null ids come last; rows
equal in id, size and checksum are interchangeable and still get different slots; texts of any length are measured whole; columns other than id and text are not
read, so their names don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volumetra.llm.common import partitions, table, text_or_empty

ROUNDS = 6


def sides(n: int) -> tuple[int, int]:
    """(a, b) with a*b >= n and a*b - n < a: few numbers are outside."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def _div(x: Column, by: int) -> Column:
    """Whole division of longs, without a detour through doubles."""
    return F.call_function("div", x, F.lit(by))


def feistel(number: Column, a: int, b: int, seed: int) -> Column:
    """One pass of the network over 0 .. a*b-1. Each round adds a keyed hash of one half to the other."""
    right = F.pmod(number, F.lit(b))
    left = _div(number - right, b)
    for r in range(ROUNDS):
        if r % 2 == 0:
            left = F.pmod(left + F.pmod(F.xxhash64(F.lit(seed * ROUNDS + r), right), F.lit(a)), F.lit(a))
        else:
            right = F.pmod(right + F.pmod(F.xxhash64(F.lit(seed * ROUNDS + r), left), F.lit(b)), F.lit(b))
    return left * F.lit(b) + right


def permute(rows: DataFrame, number: str, n: int, seed: int) -> DataFrame:
    """``rows`` with ``place``: where ``number`` goes in the permutation of 0 .. n-1.

    A walk leaves the outside after at most as many steps as there are numbers outside (fewer than the
    square root of n), and about as many rows walk at all, so that bound is used and no walk is cut short.
    """
    a, b = sides(n)
    outside = a * b - n
    once = rows.withColumn("place", feistel(F.col(number), a, b, seed))
    if not outside:
        return once
    step = lambda x, _: F.when(x < n, x).otherwise(feistel(x, a, b, seed))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(outside)), F.col("place"), step)
    return once.withColumn("place", F.when(F.col("place") < n, F.col("place")).otherwise(walked))


def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``number``: the global row number in the order of ``keys`` (nulls last), without one global sort.

    Range partitions are sorted on their own; a count for each partition gives its first number.
    """
    order = [F.col(k).asc_nulls_last() for k in keys]
    sorted_ = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    placed = sorted_.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = table(placed, "rows")
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    first = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = table(counts.select("__part", first.alias("__first")), "starts")
    return placed.join(starts, "__part").withColumn("number", F.col("__first") + F.col("__at")).drop("__part", "__at", "__first")


def shard(docs: DataFrame, shards: int = 8, seed: int = 20, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null under this law)."""
    text = text_or_empty(text_col)
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("__tie"))
    slim = table(slim, "shard-slim")
    n = slim.count()
    rows = numbered(slim, ["doc_id", "text_crc32", "size", "__tie"])
    rows = permute(rows, "number", n, seed)
    at = F.col("place")
    which = F.pmod(at, F.lit(shards))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), which.cast("int").alias("shard"), _div(at - which,
        shards).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
