"""Fill-in-the-middle rearrangement of documents by a streaming matcher with constant memory.

A text is a run of units, the matches of ``UNIT`` from left to right (lines). Two ranks among its units, drawn from the document's id, part it into prefix, middle and
suffix. The units are never stored: a first pass over the match iterator counts them, a second one advances a fresh iterator to the smaller and then to the larger rank and stops there;
what it keeps are two positions. The draws are the 32-bit groups of a SHA-256 of seed and id, so any engine can replay them.

The rearranged text is ``<P>``prefix``<S>``suffix``<M>``middle (psm) or ``<S>``suffix``<P>``prefix``<M>``middle (spm). A text that is empty or holds a sentinel stays as it is (plain), so every output can be
turned back (``restore``), which is done by built-in functions on the output alone.

Defined results: a null text counts as empty and is plain; the id of a null is the empty string; equal ids with different texts draw the same numbers; a text
of any length is cut whole; columns other than id and text are not read, so their names don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volumetra.llm.common import lean, text_or_empty

UNIT = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, FIM_PERCENT, SPM_PERCENT = 7, 100, 50


def draws(key: str, seed: int = SEED) -> list[int]:
    """Four numbers below 2**32."""
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def places(units: re.Pattern, text: str, first: int, second: int) -> tuple[int, int, int]:
    """(number of units, end of the lower rank, end of the higher rank); the ranks are the draws modulo one more than that number."""
    n = sum(1 for _ in units.finditer(text))
    low, high = sorted((first % (n + 1), second % (n + 1)))
    matches, ends = units.finditer(text), []
    at = position = 0
    for rank in (low, high):
        if rank > at:
            position = next(islice(matches, rank - at - 1, None)).end()
            at = rank
        ends.append(position)
    return n, *ends


def rearranged(units: re.Pattern, holds: re.Pattern, key: str, text: str, seed: int, fim_percent: int, spm_percent: int) -> tuple:
    """n, form, prefix_chars, middle_chars, output of one text."""
    h = draws(key, seed)
    n, p, q = places(units, text, h[0], h[1])
    if not text or holds.search(text) or h[2] % 100 >= fim_percent:
        return n, "plain", None, None, text
    if h[3] % 100 < spm_percent:
        return n, "spm", p, q - p, "".join((SUFFIX, text[q:], PREFIX, text[:p], MIDDLE, text[p:q]))
    return n, "psm", p, q - p, "".join((PREFIX, text[:p], SUFFIX, text[q:], MIDDLE, text[p:q]))


def transform(docs: DataFrame, unit: str = UNIT, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars and middle_chars (null if plain), output. No exchange."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, holds = re.compile(unit), re.compile("|".join(map(re.escape, (PREFIX, SUFFIX, MIDDLE))))
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                made = [rearranged(units, holds, k.as_py(), t.as_py(), seed, fim_percent, spm_percent) for k, t in zip(part.column(1), part.column(2))]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                columns = [pa.array(c, k) for c, k in zip(zip(*made), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text from output and form. No sentinel occurs in a rearranged text, and none can arise where two parts meet, so the sentinels cut the output into its parts."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def digests(made: DataFrame) -> DataFrame:
    """Checksums of output and restored text in place of the output."""
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(), 256).alias("restored_sha256"))
