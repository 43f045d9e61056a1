"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits in lower case. The grams of a test item are its runs of two and of ``SEED`` words. One pass over the documents
counts in how many of them each gram occurs. The seeds of an item are its rare grams: those in at most ``RARE`` times as many documents as the
median of the item's own ``SEED``-grams (so an item that leaked into a large part of the corpus keeps its seeds), in at most ``SHARE`` of the
documents (a tenth of that for two words), or in at most ``FEW``. A second pass lists where documents hold seeds; these places are joined to the
seeds and so to the items. A document that holds ``ENOUGH`` different seeds of an item (one, if the item has up to twice ``SEED`` words) is fetched, and the item
is aligned, word by word, with the stretches of the document around its seeds, so an edited or paraphrased copy still scores.
A document is contaminated by an item if the alignment reaches ``LEAST`` of the score of a full match.

Nothing of benchmark or corpus is gathered on the driver but a bitmap of gram hashes of at most ``2**MOST_BITS`` bits, which both passes
use as a filter; what it lets through in error the joins on whole hashes remove. Counts, seeds, places and items are tables that the planner
broadcasts if they are small and shuffles else; texts are only moved for documents that are aligned. Equal texts are aligned once.

Defined results: null documents and items count as empty; items without a word match nothing; items of up to ``SEED`` words must occur as they
are, and only count if they occur in so few documents as above (an item "yes" condemns nothing); repeated items give rows of their own, equal
texts equal rows; null ids stay null; texts of any length are searched and aligned whole; columns with other names than the four given are
carried but not read; empty tables give no contaminated document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volumetra.llm import wordhash as wh
from volumetra.llm.common import lean, scratch, table, text_or_empty

U = np.uint64
SEED, RARE, SHARE, FEW, ENOUGH, LEAST = 3, 4.0, 0.001, 5, 2, 0.5
MATCH, MISMATCH, GAP = 2.0, -1.0, -1.0
LEAST_BITS, MOST_BITS = 16, 29


def plain(column: pa.Array) -> pa.Array:
    """Each text as its words in lower case with one space between them."""
    words = pc.replace_substring_regex(pc.utf8_lower(column.fill_null("")), pattern=r"[^\p{L}\p{N}]+", replacement=" ")
    return pc.utf8_trim(words, " ")


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman: (best score, first and end position in ``passage``) of word codes. A row at a time; gaps along the row by a running maximum."""
    n = len(passage)
    prev, start = np.zeros(n + 1), np.arange(n + 1)
    best, span = 0.0, (0, 0)
    places = np.arange(n + 1)
    for x in item:
        diagonal = prev[:-1] + np.where(passage == x, MATCH, MISMATCH)
        up = prev + GAP
        h, s = up.copy(), start.copy()
        take = diagonal >= h[1:]
        h[1:][take] = diagonal[take]
        s[1:][take] = start[:-1][take]
        low = h <= 0
        h[low] = 0
        s[low] = places[low]
        run = np.maximum.accumulate(h - GAP * places)
        along = run + GAP * places
        longer = along > h
        if longer.any():
            source = np.maximum.accumulate(np.where(h - GAP * places >= run, places, 0))
            s = np.where(longer, s[source], s)
            h = np.maximum(h, along)
        i = int(np.argmax(h))
        if h[i] > best:
            best, span = float(h[i]), (int(s[i]), i)
        prev, start = h, s
    return best, *span


def best_copy(item: list[str], document: list[str], starts: list[int], least: float = LEAST) -> tuple[float, int, int] | None:
    """(score, first, end word) of the best copy of an item near one of the places where it may start; None if none is good enough."""
    n = len(item)
    if n <= SEED:
        s = max(0, min(starts))
        return 1.0, s, s + n
    codes = {x: c for c, x in enumerate(dict.fromkeys(item))}
    own = np.array([codes[x] for x in item])
    have, best, done = np.bincount(own), (0.0, 0, 0), -(1 << 60)
    for s in sorted(starts):
        if s <= done:
            continue
        low, high = max(0, s - n // 2), min(len(document), s + n + n // 2)
        done = s + n // 4  # the stretch covers starts up to here as well
        passage = np.array([codes.get(x, -1) for x in document[low:high]])
        there = np.bincount(passage[passage >= 0], minlength=len(have))
        if np.minimum(have, there).sum() < least * n:  # an alignment can't match more words than both hold
            continue
        score, a, b = align(own, passage)
        best = max(best, (score / (MATCH * n), -(low + a), low + b))
    return (best[0], -best[1], best[2]) if best[0] >= least else None


def _grams(text: pa.Array, widths: tuple[int, ...]) -> Iterator[tuple[int, int, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]]:
    """For pieces of plain texts: first row, end row, and for each width (width, hash, row in the piece, place in the row) of all grams."""
    for i, j, data, at in wh.pieces(text):
        word, owner, _, _ = wh.words(data, at)
        first = np.searchsorted(owner, np.arange(j - i))
        total, found = np.zeros(len(word), U), []
        for w in range(1, max(widths) + 1):
            n = max(0, len(word) - w + 1)
            total = total[:n] + word[w - 1 :] * U((0x9E3779B97F4A7C15 * (2 * w - 1)) % (1 << 64))
            if w in widths:
                whole = np.flatnonzero(owner[:n] == owner[w - 1 :])
                rows = owner[whole]
                found.append((w, wh.mix(total[whole] + U(w)), rows, whole - first[rows]))
        yield i, j, found


class Filter:
    """A bitmap of gram hashes: it lets all of them through and few others."""

    def __init__(self, hashes: DataFrame, bits: int | None = None):
        n = hashes.count()
        self.bits = bits or int(np.clip(np.ceil(np.log2(32 * max(1, n))), LEAST_BITS, MOST_BITS))
        self.map = np.zeros(1 << (self.bits - 3), np.uint8)
        slots = hashes.select(F.shiftrightunsigned("gram", 64 - self.bits).alias("slot")).distinct()
        for row in slots.toLocalIterator():  # a partition at a time
            self.map[row[0] >> 3] |= 1 << (row[0] & 7)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes >> U(64 - self.bits)
        return (self.map[(slot >> U(3)).astype(np.int64)] >> (slot & U(7)).astype(np.uint8)) & 1 != 0


def _items(benchmark: DataFrame, item_col: str, item_text: str) -> tuple[DataFrame, DataFrame, tuple[int, ...]]:
    """(iid, item_id, words, n), (iid, n, gram, width, pos), widths in use."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), plain(b.column(2))], names=["iid", "item_id", "words"])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column(2).to_numpy()
            for i, j, found in _grams(b.column(1), tuple(range(1, SEED + 1))):
                for width, gram, row, place in found:
                    n = size[i:j][row]
                    use = (width == np.minimum(n, SEED)) | ((width == 2) & (n > SEED))
                    columns = [b.column(0).take(pa.array(i + row[use])), pa.array(n[use]), pa.array(gram[use].astype(np.int64)),
                        pa.array(np.full(use.sum(), width, np.int32)), pa.array(place[use].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=["iid", "n", "gram", "width", "pos"])

    kind = benchmark.schema[item_col].dataType.simpleString()
    own = benchmark.select(F.monotonically_increasing_id().alias("iid"), F.col(item_col).alias("item_id"), text_or_empty(item_text).alias("text"))
    own = own.mapInArrow(lean(words), f"iid long, item_id {kind}, words string").where("words <> ''").withColumn("n", F.size(F.split("words", " ")))
    items = table(own, "leak-items")
    grams_ = table(items.select("iid", "words", "n").mapInArrow(lean(grams), "iid long, n int, gram long, width int, pos int"), "leak-grams")
    widths = tuple(sorted(r[0] for r in grams_.select("width").distinct().collect()))  # three rows at most
    return items, grams_, widths


def _counted(docs: DataFrame, let: Filter, widths: tuple[int, ...]) -> DataFrame:
    """(gram, n): in how many documents each gram that the filter lets through occurs. Summed in each batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, found in _grams(plain(b.column(0)), widths):
                for _, gram, row, _ in found:
                    ok = let(gram)
                    order = np.lexsort((row[ok], gram[ok]))
                    g, r = gram[ok][order], row[ok][order]
                    once = np.ones(len(g), bool)
                    once[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
                    own, n = np.unique(g[once], return_counts=True)
                    if len(own):
                        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), pa.array(n)], names=["gram", "n"])

    return docs.select("text").mapInArrow(lean(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("held"))


def _seeds(grams: DataFrame, held: DataFrame, documents: int) -> DataFrame:
    """(gram, iid, pos): the rare grams of each item that occur at all."""
    counted = table(grams.join(held, "gram", "left").withColumn("held", F.coalesce("held", F.lit(0))), "leak-counted")
    whole = F.col("width") == F.least("n", F.lit(SEED))
    usual = counted.where(whole).groupBy("iid").agg(F.percentile_approx("held", 0.5, 10000).alias("usual"))
    few = F.greatest(F.lit(SHARE * documents) * F.when((F.col("width") == 2) & (F.col("n") > SEED), 0.1).otherwise(1.0), F.lit(float(FEW)))
    most = F.when(F.col("n") > SEED, F.greatest(F.col("usual") * RARE, few)).otherwise(few)
    return counted.join(usual, "iid").where((F.col("held") > 0) & (F.col("held") <= most)).select("gram", "iid", "pos")


def name(text_col: str):
    """128 bits that name a text."""
    return F.unhex(F.md5(text_or_empty(text_col).cast("binary")))


def matches(docs: DataFrame, benchmark: DataFrame, text_col="text", item_col="item_id", item_text="text", least: float = LEAST, bits: int | None = None) -> DataFrame:
    """Rows (name, item_id, score, start, end) of the texts, by their name, that hold a copy of a test item. ``bits``: size of the filters, which changes no row."""
    with scratch(docs.sparkSession) as keep:
        return keep(_matches(docs, benchmark, text_col, item_col, item_text, least, bits))


def _matches(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str, least: float, bits: int | None) -> DataFrame:
    items, grams, widths = _items(benchmark, item_col, item_text)
    item_kind = items.schema["item_id"].dataType.simpleString()
    kind = f"name binary, item_id {item_kind}, score double, start int, end int"
    if not widths:
        return table(docs.sparkSession.createDataFrame([], kind), "leak-matches")
    slim, spark = docs.select(text_or_empty(text_col).alias("text")), docs.sparkSession
    held = table(_counted(slim, Filter(grams.select("gram").distinct(), bits), widths), "leak-held")
    seeds = table(_seeds(grams, held, slim.count()), "leak-seeds")
    let = spark.sparkContext.broadcast(Filter(seeds.select("gram").distinct(), bits))  # 2**MOST_BITS bits at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, found in _grams(plain(b.column(1)), widths):
                rows, grams_, places = [], [], []
                for _, gram, row, place in found:
                    ok = let.value(gram)
                    rows.append(row[ok])
                    grams_.append(gram[ok])
                    places.append(place[ok])
                take = b.column(0).take(pa.array(i + np.concatenate(rows)))
                columns = [pa.array(np.concatenate(x).astype(kind_)) for x, kind_ in ((grams_, np.int64), (places, np.int32))]
                yield pa.RecordBatch.from_arrays([take, *columns], names=["name", "gram", "place"])

    named = docs.select(name(text_col).alias("name"), text_or_empty(text_col).alias("text"))
    spots = named.mapInArrow(lean(run), "name binary, gram long, place int").distinct().join(seeds, "gram")
    spots = spots.groupBy("name", "iid").agg(F.collect_set(F.col("place") - F.col("pos")).alias("starts"), F.collect_set("gram").alias("grams"))  # one text, one item
    pairs = spots.join(items.select("iid", "item_id", "n", F.col("words").alias("item")), "iid")
    pairs = pairs.where(F.size("grams") >= F.when(F.col("n") > 2 * SEED, ENOUGH).otherwise(1))
    pairs = table(pairs.groupBy("name").agg(F.collect_list(F.struct("item_id", "item", "starts")).alias("items")), "leak-pairs")  # one text's items
    texts = named.join(pairs.select("name"), "name", "left_semi").groupBy("name").agg(F.first("text").alias("text"))
    both = texts.join(pairs, "name").select("name", "text", "items")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for b in batches:
            schema = schema or pa.schema([("name", pa.binary()), ("item_id", b.schema.field("items").type.value_type.field("item_id").type), ("score",
                pa.float64()), ("start", pa.int32()), ("end", pa.int32())])
            rows, words = [], plain(b.column(1))
            for k in range(b.num_rows):
                document = words[k].as_py().split(" ")
                for x in b.column(2)[k].as_py():
                    got = best_copy(x["item"].split(" "), document, x["starts"], least)
                    if got:
                        rows.append((b.column(0)[k].as_py(), x["item_id"], *got))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return table(both.mapInArrow(lean(check), kind), "leak-matches")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text="text", least: float = LEAST,
    bits: int | None = None) -> DataFrame:
    """Rows (doc_id, item_id, score, start, end) of documents that hold a copy of a test item; positions count words."""
    found = matches(docs, benchmark, text_col, item_col, item_text, least, bits)
    return docs.select(F.col(id_col).alias("doc_id"), name(text_col).alias("name")).join(found, "name").select("doc_id", "item_id", "score", "start", "end")


def clean(docs: DataFrame, benchmark: DataFrame, text_col="text", item_col="item_id", item_text="text", least: float = LEAST, bits: int | None = None) -> DataFrame:
    """``docs`` without the contaminated ones: those that ``contaminated`` has no row of."""
    columns = docs.columns
    text = f"c{columns.index(text_col)}"
    gone = matches(docs, benchmark, text_col, item_col, item_text, least, bits).select("name").distinct()
    plain_ = docs.toDF(*[f"c{i}" for i in range(len(columns))])  # any names, dots and doubles included, pass through
    return plain_.withColumn("name", name(text)).join(gone, "name", "left_anti").drop("name").toDF(*columns)
