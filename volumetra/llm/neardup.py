"""Near duplicates by DartMinHash signatures, banded joining and exact verification.

Each weighted element owns a region: the unit cells of its weight times an axis of ranks. Darts fall into a cell as a
Poisson process that depends on element and cell alone; a dart knows its rank, its height in the cell
and a coordinate of the signature. A set's signature keeps, for each coordinate, the dart of the lowest
rank that lies within the set's regions. Two sets agree in a coordinate with the probability of their weighted Jaccard
similarity. The elements of a text are its shingles of five words, the weight of one is how often it occurs. Only darts up to a rank that fills all
coordinates with near certainty are thrown, so the work is
the number of elements plus ``k ln k`` darts, not their product; where a coordinate stays empty, the rank is doubled.

Texts that are equal share one key and are compared once. Bands of the signature give buckets. Each
bucket links its members to one leader, the member that meets most others over all bands: it lies near the middle of its group, so a bucket of m copies
gives m - 1 pairs and nearly all links. Links are verified by the exact weighted similarity, that of the bags of shingles. Members that hang apart
from their bucket's main
component are then compared with members of other components, but only where a link is possible: of a set's shingles, only those that occur
in two components or more can be shared across components, counted by groups of their hashes, and a pair whose smaller counts sum to less than the
similarity asks for is never made.
That bound is exact, so no candidate of the bands is lost. Components are found by label passing over tables, never on the driver.

Defined results: a null text counts as empty; equal texts are one class, also empty ones; repeated rows and null ids stay rows of
their class, whose id is its least id (null if it has none); texts of any length are taken whole, one of fewer than five words is a single shingle;
other columns are carried but not read, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volumetra.llm import wordhash as wh
from volumetra.llm.common import lean, scratch, table, text_or_empty

U = np.uint64
BANDS, ROWS = 28, 6
SIMILARITY = 0.8
#: Groups of shingles, by hash, in which the largest possible overlap of two sets is counted.
GROUPS = 32
#: Rows whose signatures are made at a time: darts take some 1,500 entries a row, however short its text.
MOST_ROWS = 256


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def darts(elements: np.ndarray, owners: np.ndarray, n: int, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Signatures (n, k): for each owner and coordinate the id of its earliest dart; 0 for an owner without elements.

    ``elements``: 64-bit hashes, ``owners``: their set (ascending), ``weights``: by default 1 each.
    An element that is listed again in a set changes nothing.
    """
    out = np.zeros((n, k), U)
    if not len(elements):
        return out
    weights = np.ones(len(elements)) if weights is None else weights
    per = np.ceil(weights).astype(np.int64)
    own, cells, height = np.repeat(owners, per), wh.cells(elements, per), None
    if (per != weights).any():  # a dart above the weight misses; whole weights fill their cells
        height = np.repeat(weights, per) - (np.arange(len(own)) - np.repeat(np.cumsum(per) - per, per))
    total = np.bincount(own, minlength=n).astype(np.float64)
    reach = k * (math.log(k) + 4.0) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        live = todo[own]
        c, o = cells[live], own[live]
        h = None if height is None else height[live]
        rank, state = np.zeros(len(c)), c
        keys, ranks, ids = [], [], []
        while len(c):
            state = wh.mix(state + U(0xD1B54A32D192ED03))
            rank = rank - np.log(_uniform(state))
            near = rank < reach[o]
            state, rank, o, c = state[near], rank[near], o[near], c[near]
            dart = wh.mix(state ^ U(0xA0761D6478BD642F))
            hit = slice(None)
            if h is not None:
                h = h[near]
                hit = _uniform(wh.mix(dart + U(0x8BB84B93962EACC9))) < h
            keys.append(o[hit] * k + (dart[hit] % U(k)).astype(np.int64))
            ranks.append(rank[hit])
            ids.append(dart[hit] | U(1))
        key, rank, dart = np.concatenate(keys), np.concatenate(ranks), np.concatenate(ids)
        late_first = np.argsort(-rank, kind="stable")
        flat = np.zeros(n * k, U)
        flat[key[late_first]] = dart[late_first]
        flat = flat.reshape(n, k)
        full = todo & (flat != 0).all(axis=1)
        out[full] = flat[full]
        todo &= ~full
        reach = reach * 2
    return out


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) bucket hashes; the band is part of the hash."""
    total = np.zeros((len(signatures), bands), U)
    for r in range(rows):
        total = wh.mix(total + signatures[:, r::rows][:, :bands] * U(2 * r + 1))
    return wh.mix(total + np.arange(1, bands + 1, dtype=U) * U(0xE7037ED1A0B428DB)).astype(np.int64)


def text_key(text: str | Column = "text") -> Column:
    """128 bits that name a text."""
    return F.unhex(F.md5(text_or_empty(text).cast("binary")))


def signed(docs: DataFrame, id_col="doc_id", text_col="text", bands=BANDS, rows=ROWS) -> DataFrame:
    """One row per document: doc_id, key, size (shingles), buckets. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in wh.pieces(batch.column(2), rows=MOST_ROWS):
                hashes, owners, _, _ = wh.words(data, at)
                shingle, owner, times = wh.counted(*wh.shingles(hashes, owners)[:2])
                signatures = darts(shingle, owner, j - i, bands * rows, times)
                sizes = np.bincount(owner, minlength=j - i)
                buckets = band_hashes(signatures, bands, rows)
                lists = pa.ListArray.from_arrays(_offsets(sizes, bands), pa.array(buckets[sizes > 0].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], lists], names=["doc_id", "key", "buckets"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("key"), text_or_empty(text_col).alias("text"))
    return slim.mapInArrow(lean(run), f"doc_id {kind}, key binary, buckets array<bigint>")


def _offsets(sizes: np.ndarray, bands: int) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]).astype(np.int32))


def _jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    """Exact weighted similarity of the word shingles: what both bags hold over what either holds."""
    last: list = [None, None]

    def shingles(i: int, text: str) -> set:
        if last[i] is None or last[i][0] != text:
            last[i] = (text, wh.shingle_bag(text))
        return last[i][1]

    out = []
    for x, y in zip(a, b):
        s, t = shingles(0, x), shingles(1, y)
        both = len(s & t)
        out.append(both / max(1, len(s) + len(t) - both))
    return pd.Series(out, dtype="float64")


def jaccard(a: str, b: str) -> Column:
    return F.pandas_udf(_jaccard, "double")(a, b)


def components(links: DataFrame, name: str = "cc") -> DataFrame:
    """(a, b) -> (key, comp): the least key that each key hangs together with. Steps are written, so a lost executor costs little."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    edges = table(both, f"{name}-edges")
    near = edges.groupBy("a").agg(F.min("b").alias("b"))
    labels = table(near.select(F.col("a").alias("key"), F.least("a", "b").alias("comp")), f"{name}-labels")
    while True:
        by_edge = edges.join(labels.select(F.col("key").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("seen"))
        stepped = labels.join(by_edge.withColumnRenamed("a", "key"), "key").select("key", "comp", F.least("comp", "seen").alias("new"))
        # pointer jumping: follow the label's own label
        jump = labels.select(F.col("key").alias("new"), F.col("comp").alias("far"))
        stepped = stepped.join(jump, "new", "left").select("key", "comp", F.least("new", F.coalesce("far", "new")).alias("new"))
        stepped = table(stepped, f"{name}-step")
        moved = stepped.where("new <> comp").limit(1).count()
        labels = stepped.select("key", F.col("new").alias("comp"))
        if not moved:
            return labels


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(key, comp, text) -> (key, comp, shingles): the hashes of each text's shingles, repeated ones as cells of their own. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in wh.pieces(batch.column(2)):
                hashes, owners, _, _ = wh.words(data, at)
                shingle, owner, times = wh.counted(*wh.shingles(hashes, owners)[:2])
                ends = np.cumsum(np.bincount(owner, weights=times, minlength=j - i).astype(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(wh.cells(shingle, times).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], lists], names=["key", "comp", "shingles"])

    return texts.select("key", "comp", "text").mapInArrow(lean(run), "key binary, comp binary, shingles array<bigint>")


def connected(signs: DataFrame, docs: DataFrame, text_col="text", similarity: float = SIMILARITY) -> DataFrame:
    """(key, comp) of the keys that have a verified link to a different text."""
    per_key = table(signs.groupBy("key").agg(F.first("buckets").alias("buckets")), "nd-keys")
    rows = per_key.select("key", F.explode("buckets").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = table(rows.join(shared, "bucket"), "nd-shared")
    meets = rows.groupBy("key").agg(F.sum("n").alias("meets"))
    leaders = rows.join(meets, "key").groupBy("bucket").agg(F.max(F.struct("meets", "key")).alias("m")).select("bucket", F.col("m.key").alias("lead"))
    stars = rows.join(leaders, "bucket").where("key <> lead").select(F.least("key", "lead").alias("a"), F.greatest("key", "lead").alias("b"))
    stars = table(stars.distinct(), "nd-stars")
    texts = docs.select(text_key(text_col).alias("key"), text_or_empty(text_col).alias("text")).join(rows.select("key").distinct(), "key", "left_semi")
    texts = table(texts.groupBy("key").agg(F.first("text").alias("text")), "nd-texts")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        both = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("key").alias("b"),
            F.col("text").alias("tb")), "b")
        return table(both.select("a", "b", jaccard("ta", "tb").alias("s")).where(F.col("s") >= similarity).select("a", "b"), name)

    comps = components(verified(stars, "nd-links"), "nd-cc")
    named = rows.join(comps, "key", "left").select("key", "bucket", F.coalesce("comp", "key").alias("comp"))
    split = named.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    split = split.groupBy("bucket").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("n", "comp")).alias("m")).where("comps > 1").select("bucket",
        F.col("m.comp").alias("main"))
    mixed = table(named.join(split, "bucket"), "nd-mixed")
    sets = table(shingle_sets(texts.join(mixed.select("key", "comp").distinct(), "key")), "nd-sets")
    each = sets.select("key", "comp", F.explode("shingles").alias("shingle"))
    across = table(each.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("shingle"), "nd-across")
    part = [F.count(F.when(F.pmod("shingle", F.lit(GROUPS)) == g, 1)).cast("int").alias(f"r{g}") for g in range(GROUPS)]
    reach = each.join(across, "shingle", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("reach"), *part)
    # a link needs similarity * union <= overlap <= reach, and the union holds all of either set
    live = sets.select("key", F.size("shingles").cast("long").alias("size")).join(reach, "key").where(F.col("reach") >= F.col("size") * similarity)
    live = table(mixed.join(live, "key"), "nd-live")
    side = lambda df, k, c, s, r: df.select("bucket", F.col("key").alias(k), F.col("comp").alias(c), F.col("size").alias(s),
        *[F.col(f"r{g}").alias(f"{r}{g}") for g in range(GROUPS)])
    one, other = side(live.where("comp <> main"), "x", "cx", "sx", "rx"), side(live, "y", "cy", "sy", "ry")
    most = sum((F.least(f"rx{g}", f"ry{g}") for g in range(GROUPS)), F.lit(0))
    possible = most * (1 + similarity) >= (F.col("sx") + F.col("sy")) * similarity - 1e-6
    pairs = one.join(other, (one.bucket == other.bucket) & (F.col("cx") != F.col("cy")) & possible)
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    more = verified(table(pairs, "nd-pairs"), "nd-links-rest")
    # the second pass only joins components, so its graph has one node for each
    name = lambda k: comps.select(F.col("key").alias(k), F.col("comp").alias(f"c{k}"))
    between = more.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = components(between, "nd-cc-rest")
    far = joined.select(F.col("key").alias("comp"), F.col("comp").alias("last"))
    known = comps.join(far, "comp", "left").select("key", F.coalesce("last", "comp").alias("comp"))
    return known.unionByName(joined.join(comps, "key", "left_anti"))


def classes(docs: DataFrame, id_col="doc_id", text_col="text", similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(signs, by key): the second has key, class_id, class_size, chosen (the key that stays) and times (rows with that key and id)."""
    signs = table(signed(docs, id_col, text_col), "nd-signs")
    with scratch(docs.sparkSession) as keep:
        return signs, keep(_classes(signs, connected(signs, docs, text_col, similarity)))


def _classes(signs: DataFrame, comps: DataFrame) -> DataFrame:
    ids = signs.groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("times"))
    per_key = ids.groupBy("key").agg(F.sum("times").alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "times")).alias("least"))
    named = table(per_key.join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key")), "nd-named")
    least = F.min(F.struct(F.col("least.col1"), F.col("least.doc_id"), "key", F.col("least.times")))
    whole = named.groupBy("comp").agg(F.sum("n").alias("class_size"), least.alias("c"))
    whole = whole.select("comp", "class_size", F.col("c.doc_id").alias("class_id"), F.col("c.key").alias("chosen"), F.col("c.times").alias("times"))
    return table(named.select("key", "comp").join(whole, "comp").drop("comp"), "nd-classes")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id (least id of its class), class_size."""
    signs, by_key = classes(docs, id_col, text_col, similarity)
    return signs.select("doc_id", "key").join(by_key, "key").select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class, the one with the least id; of rows equal in id and text the one with the least hash of all columns."""
    _, by_key = classes(docs, id_col, text_col, similarity)
    chosen = by_key.where("key = chosen").select("key", F.col("class_id").alias("least"), "times")
    columns = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*columns)  # any names pass through
    own = lambda name: columns[docs.columns.index(name)]
    kept = plain.withColumn("key", text_key(own(text_col))).join(chosen, "key").where(F.col("least").eqNullSafe(F.col(own(id_col))))
    again = kept.where("times > 1").groupBy("key").agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row")).select("row.*")
    return kept.where("times = 1").select(*columns).unionByName(again).toDF(*docs.columns)
