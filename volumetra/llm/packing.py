"""Packing token ids into sequences of one length by harmonic classes.

Class k holds the pieces of more than capacity/(k+1) and at most capacity/k ids, and a sequence of class k is filled with k pieces of that class, whatever they are.
So no piece has to be compared with another: each worker fills the sequences of all classes from the documents it happens to read, in one pass and without a
shuffle, and has at most k-1 pieces of each class left over. Only these go on: the leftovers of ``FAN`` workers at a time are filled again, until those of one last worker remain, fewer
than one sequence for each class; they are laid end to end and cut anew, the end at powers of two, so that nothing is padded there.

What is padded is the room between a piece and its share of the sequence. Documents are cut so that this stays small: whole sequences first, then the rest into the fewest
pieces whose classes they fill up to ``slack`` of the rest, four at most (``cuts``).

Defined results: a null text counts as empty and has the end id alone; null ids are passed on; rows with the same id are documents of their own; a text of any
length is cut whole; columns other than id and text are not read, so their names don't matter; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volumetra.llm.common import lean, scratch, table, text_or_empty
from volumetra.llm.tokenids import encoder, tokenizer_path

CAPACITY, END_ID = 2048, 1
#: Share of a document's rest that may be padded if fewer cuts make it so.
SLACK = 0.01
#: Workers whose leftovers are filled together.
FAN = 64
_MOST_PIECES = 4


@cache
def cuts(capacity: int, slack: float) -> list[tuple[int, ...]]:
    """For each rest of 0 .. capacity-1 ids the lengths of its pieces: the fewest, up to four, that leave at most ``slack`` of it unfilled, or else those that leave least."""
    rest = np.arange(capacity)
    fill = np.maximum(rest, 1)
    k = capacity // fill
    room = capacity / k - rest  # a piece's share of its sequence, without the piece
    room[0] = np.inf
    best, first = [room], [rest.copy()]
    for _ in range(_MOST_PIECES - 1):
        least, at = np.full(capacity, np.inf), np.zeros(capacity, np.int64)
        for r in range(2, capacity):
            both = room[1:r] + best[-1][r - 1 : 0 : -1]
            at[r] = 1 + int(np.argmin(both))
            least[r] = both[at[r] - 1]
        best.append(least)
        first.append(at)
    out: list[tuple[int, ...]] = [()]
    for r in range(1, capacity):
        fits = [m for m in range(_MOST_PIECES) if best[m][r] <= slack * r]
        m = fits[0] if fits else int(np.argmin([b[r] for b in best]))
        pieces, left = [], r
        for step in range(m, -1, -1):
            pieces.append(int(first[step][left]))
            left -= pieces[-1]
        out.append(tuple(sorted(pieces, reverse=True)))
    return out


def lengths_of(n: int, capacity: int, slack: float) -> list[int]:
    """How a document of ``n`` ids is cut."""
    return [capacity] * (n // capacity) + list(cuts(capacity, slack)[n % capacity])


class Filler:
    """Sequences of one worker: ``add`` returns the pieces of those that are full, with ``bin`` (from 0) and ``offset``; ``rest`` holds the others, fewer than k of class k."""

    def __init__(self, capacity: int):
        self.capacity, self.rest, self.bins = capacity, None, 0

    def add(self, pieces: pa.Table) -> pa.Table:
        every = pieces if self.rest is None else pa.concat_tables([self.rest, pieces])
        k = self.capacity // every["length"].to_numpy()
        order = np.argsort(k, kind="stable")
        k = k[order]
        kinds, begin, count = np.unique(k, return_index=True, return_counts=True)
        rank = np.arange(len(k)) - np.repeat(begin, count)
        full = rank < np.repeat(count // kinds * kinds, count)
        at, rank, k = order[full], rank[full], k[full]
        done = every.take(pa.array(at))
        fresh = rank % k == 0
        upto = np.cumsum(length := done["length"].to_numpy()) - length
        offset = upto - upto[np.maximum.accumulate(np.where(fresh, np.arange(len(k)), 0))] if len(k) else upto
        bins = self.bins + np.cumsum(fresh) - 1
        self.bins += int(fresh.sum())
        self.rest = every.take(pa.array(order[~full])).combine_chunks()
        return _placed(done, bins, offset)

    def end(self) -> pa.Table:
        """The rest laid end to end and cut into whole sequences, then into powers of two."""
        total = int(self.rest["length"].to_numpy().sum())
        sizes = [self.capacity] * (total // self.capacity) + [1 << b for b in range(self.capacity.bit_length() - 1, -1, -1) if total % self.capacity >> b & 1]
        rows, bins, offsets, left, used, b = [], [], [], 0, 0, -1
        for row in self.rest.to_pylist():
            done = 0
            while done < row["length"]:
                if not left:
                    b, left, used = b + 1, sizes[b + 1], 0
                n = min(left, row["length"] - done)
                rows.append(row | {"start": row["start"] + done, "length": n, "ids": row["ids"][4 * done : 4 * (done + n)]})
                bins.append(self.bins + b)
                offsets.append(used)
                done, left, used = done + n, left - n, used + n
        return _placed(pa.Table.from_pylist(rows, self.rest.schema), np.array(bins, np.int64), np.array(offsets, np.int64))


def _placed(pieces: pa.Table, bins: np.ndarray | None, offset: np.ndarray | None) -> pa.Table:
    none = pa.nulls(len(pieces), pa.int64())
    return pieces.append_column("bin", none if bins is None else pa.array(bins, pa.int64())).append_column("offset", none if offset is None else pa.array(offset, pa.int64()))


def _cut(ids: pa.Array, count: np.ndarray, flat: np.ndarray, capacity: int, slack: float) -> pa.Table:
    """The pieces of a batch of documents."""
    data = memoryview(flat.astype("<u4").tobytes())
    owner, start, length, raw, base = [], [], [], [], 0
    for i, n in enumerate(count.tolist()):
        at = 0
        for size in lengths_of(n, capacity, slack):
            owner.append(i)
            start.append(at)
            length.append(size)
            raw.append(bytes(data[4 * (base + at) : 4 * (base + at + size)]))
            at += size
        base += n
    owner_ = np.array(owner, np.int64)
    columns = [ids.take(pa.array(owner_)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(count[owner_], pa.int64()), pa.array(raw, pa.binary())]
    return pa.table(columns, ["doc_id", "start", "length", "doc_tokens", "ids"])


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, slack: float = SLACK, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit), sequence_id, offset.

    Sequence ids are gapless from 0: workers are numbered, and a running sum over the workers gives each one's first.
    """
    spark, path = docs.sparkSession, tokenizer or tokenizer_path()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    pieces = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, length long, doc_tokens long, ids binary, bin long, offset long, worker long"
    names = [c.split()[0] for c in pieces.split(", ")]

    def named(t: pa.Table, worker: int) -> pa.Table:
        return t.append_column("worker", pa.array(np.full(len(t), worker))).select(names)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, filler, worker = encoder(path), Filler(capacity), TaskContext.get().partitionId()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                ids = batch.column(0).slice(i, 500)
                count, flat = own.encode(batch.column(1).slice(i, 500))
                made = _cut(ids, count + 1, np.insert(flat, np.cumsum(count), end_id), capacity, slack)
                yield from named(filler.add(made), worker).combine_chunks().to_batches()
        if filler.rest is not None:
            yield from named(_placed(filler.rest, None, None), worker).combine_chunks().to_batches()

    def again(level: int, last: bool):
        def run(key: tuple, t: pa.Table) -> pa.Table:
            filler = Filler(capacity)
            done = filler.add(t.select(names[:5]))
            left = filler.end() if last else _placed(filler.rest, None, None)
            return named(pa.concat_tables([done, left]), (level << 40) + key[0].as_py())

        return run

    with scratch(spark) as keep:
        made = [keep(table(rows.mapInArrow(lean(fill), pieces), "pieces"))]
        level, last = 0, False
        while not last:
            level += 1
            left = made[-1].where("bin IS NULL").withColumn("worker", F.col("worker").bitwiseAND(F.lit((1 << 40) - 1)))
            group = F.call_function("div", F.col("worker"), F.lit(FAN)).alias("group")
            most = left.agg(F.max("worker")).first()[0]
            last = (most or 0) < FAN
            made.append(keep(table(left.groupBy(group).applyInArrow(again(level, last), pieces), "pieces-left")))
        placed = [m.where("bin IS NOT NULL") for m in made]
        every = placed[0]
        for m in placed[1:]:
            every = every.unionByName(m)
        sizes = every.groupBy("worker").agg((F.max("bin") + 1).alias("n"))
        before = F.sum("n").over(Window.orderBy("worker").rowsBetween(Window.unboundedPreceding, -1))  # over workers, not pieces
        base = keep(table(sizes.select("worker", F.coalesce(before, F.lit(0)).alias("base")), "pieces-base"))
    return every.join(base, "worker").select("doc_id", "start", "length", "doc_tokens", "ids", (F.col("base") + F.col("bin")).alias("sequence_id"), "offset")


def sequences(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per sequence: sequence_id, ids (bytes), n_tokens, padded (ids to add; none at a power of two), documents (doc_id, start, offset, length in the order of the sequence).

    A sequence has at most ``capacity`` pieces, so its group is bounded.
    """
    own = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    s = pieces.groupBy("sequence_id").agg(own.alias("p"), F.sum("length").alias("n_tokens"))
    ids = F.aggregate(F.col("p.ids"), F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x))
    n = F.col("n_tokens")
    pad = F.when(n.bitwiseAND(n - 1) == 0, F.lit(0)).otherwise(F.lit(capacity) - n)
    parts = F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["offset"].alias("offset"), x["length"].alias("length")))
    return s.select("sequence_id", ids.alias("ids"), "n_tokens", pad.cast("long").alias("padded"), parts.alias("documents"))


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
