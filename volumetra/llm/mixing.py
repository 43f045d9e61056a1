"""Mixing sources to target weights with hash-threshold histograms.

Every document gets a 48-bit hash. A source whose target is ``k`` whole passes plus a remainder takes
each document ``k`` times, and once more those documents whose hash lies below a threshold. Nested
budgets use the same hash, so a smaller budget takes a subset of a larger one. The threshold is
found without sorting documents: sum the sizes by source and leading hash bits, find the bucket in which
the running sum passes the remainder, and refine that bucket alone by the next bits, until a
bucket is one hash value. That last value is taken if doing so comes nearer to the remainder.

Per source only a histogram of at most ``2**BITS`` buckets is ever gathered, pre-aggregated before
its shuffle, so a source that holds a third of all rows costs no more than another.

Defined results: a null text has size 0; null is a source of its own, the last one; a null id or
repeated rows share a hash and are taken together; an empty table gives no rows; columns other than the three
named are not read; with no words at all every target is 0;
a text without words is repeated ``most`` times at most, like any other; texts of any length are counted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volumetra.llm.common import scratch, table, word_count

BITS, LEVELS = 12, 4
WEIGHTS = (5, 2, 1)
MOST = 3


def _source_key(source: str) -> Column:
    """Never null, so that it can be joined on: null becomes a value no source has."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def _hash(id_col: str, source_key: Column, size: Column, seed: str) -> Column:
    key = F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), source_key, size.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(sk, source_size) -> (sk, source_size, target): shares by weight, filled up to ``most`` times the size.

    The sources are ordered by code point, null last, and get the weights in turn. Sharing the excess
    again and again ends at one level ``x`` with target = min(weight * x, cap) for every source; the sources that
    reach their cap are those of the least cap a weight. The windows here run over sources, never over documents.
    """
    n = len(weights)
    ranked = sizes.withColumn("i", F.row_number().over(Window.orderBy(F.col("sk") == "", "sk")) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("i") % n + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("w", weight).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("w"), "i")
    everything = Window.partitionBy()
    filled = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("open_w", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.coalesce("capped", F.lit(0))) / F.col("open_w"))
    )
    # The level with the first j sources at their cap holds if the next source stays within its cap.
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "i", "level"))).over(everything)["level"]
    x = filled.withColumn("x", level)
    return x.select("sk", "source_size", F.least(F.col("x") * F.col("w"), F.col("cap").cast("double")).alias("target"))


def thresholds(slim: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(sk, size, h) of all documents -> per source: source_size, target, passes, threshold, closed.

    A document is taken ``passes`` times, and once more if h < threshold, or h = threshold and closed.
    """
    sizes = table(slim.groupBy("sk").agg(F.sum("size").alias("source_size")), "mix-sizes")
    bound = targets(sizes, weights, most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    bound = bound.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    bound = table(bound.withColumns({"prefix": F.lit(0).cast("long"), "before": F.lit(0).cast("long"), "last": F.lit(0).cast("long")}), "mix-targets")
    first = bound
    for level in range(LEVELS):
        keep, down = BITS * (LEVELS - level), BITS * (LEVELS - level - 1)
        part = slim.where("size > 0")
        if level:
            part = part.join(bound.select("sk", "prefix"), "sk").where(F.shiftright("h", keep) == F.col("prefix"))
        sums = part.groupBy("sk", F.shiftright("h", down).alias("bucket")).agg(F.sum("size").alias("sum"))
        run = Window.partitionBy("sk").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("upto", F.sum("sum").over(run)).join(bound.select("sk", "rest", "before"), "sk")
        upto = F.col("before") + F.col("upto")
        crossed = sums.where((upto > F.col("rest")) & (upto - F.col("sum") <= F.col("rest")))
        found = crossed.select("sk", F.col("bucket").alias("prefix"), (upto - F.col("sum")).alias("before"), F.col("sum").alias("last"))
        bound = table(first.drop("prefix", "before", "last").join(found, "sk"), f"mix-level{level}")
    closed = 2 * F.col("before") + F.col("last") <= 2 * F.col("rest")
    some = bound.select("sk", F.col("prefix").alias("threshold"), closed.alias("closed"))
    whole = first.select("sk", "source_size", "target", "passes").join(some, "sk", "left")
    return table(whole.select("sk", "source_size", "target", "passes", F.coalesce("threshold", F.lit(-1)).alias("threshold"), F.coalesce("closed",
        F.lit(False)).alias("closed")), "mix-bounds")


def _copies(most: int) -> Column:
    more = (F.col("h") < F.col("threshold")) | ((F.col("h") == F.col("threshold")) & F.col("closed"))
    return F.least(F.col("passes") + more.cast("long"), F.lit(most).cast("long"))


def _slim(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    sized = docs.select(F.col(id_col).alias("doc_id"), _source_key(source_col).alias("sk"), word_count(text_col).alias("size"))
    return sized.withColumn("h", _hash("doc_id", F.col("sk"), F.col("size"), seed))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, most=MOST, seed="mix") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies."""
    slim = table(_slim(docs, id_col, text_col, source_col, seed), "mix-slim")
    with scratch(docs.sparkSession) as keep:
        bounds = keep(thresholds(slim, weights, most))
    taken = slim.join(bounds, "sk").withColumn("copies", _copies(most))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def take(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, most=MOST, seed="mix") -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each as many times as it is taken."""
    with scratch(docs.sparkSession) as keep:
        bounds = keep(thresholds(table(_slim(docs, id_col, text_col, source_col, seed), "mix-slim"), weights, most))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    sized = docs.select(own, F.col(id_col).alias("doc_id"), _source_key(source_col).alias("sk"), word_count(text_col).alias("size"))
    sized = sized.withColumn("h", _hash("doc_id", F.col("sk"), F.col("size"), seed))
    taken = sized.join(bounds, "sk").where(_copies(most) > 0).select(F.explode(F.array_repeat("row", _copies(most).cast("int"))).alias("row"))
    return taken.select("row.*")
