"""Label files in the level 5 MAT format: a reader of nested structs, cells, matrices and texts to typed rows, and the label tables in them.

A file is a 128-byte header and then tagged elements: a type and a number of bytes (4 bytes each, or both and the data in 8 bytes), the data, padding to 8. A matrix is
an element of elements (flags, dimensions, name, then its data); a struct's or a cell's data are matrices again; any element may be deflated. Numbers lie column by column.

Each leaf becomes a row with the way to it: the variable, then for a struct's element its number and field, for a cell's its number (from 0, columns first).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: types of numbers, and the types and classes that hold others.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2"}
MATRIX, DEFLATED = 14, 15
CELL, STRUCT, CHAR, SPARSE = 1, 2, 4, 5
SCHEMA = "path string, way array<string>, kind string, dims array<int>, numbers array<double>, text string"

Leaf = tuple[list[str], str, list[int], np.ndarray | None, str | None]


class Elements:
    """The elements of a piece of a file, one after the other."""

    def __init__(self, data: bytes, order: str, at: int = 0):
        self.data, self.order, self.at = memoryview(data), order, at

    def __bool__(self) -> bool:
        return self.at + 8 <= len(self.data)

    def next(self) -> tuple[int, memoryview]:
        if self.at + 8 > len(self.data):
            raise ValueError("an element is cut off")
        kind, size = struct.unpack_from(f"{self.order}2I", self.data, self.at)
        if kind >> 16:  # both in four bytes
            kind, size, begin, after = kind & 0xFFFF, kind >> 16, self.at + 4, self.at + 8
        else:
            begin = self.at + 8
            after = begin + size + (0 if kind == DEFLATED else -size % 8)
        if begin + size > len(self.data):
            raise ValueError("an element is cut off")
        self.at = after
        return kind, self.data[begin : begin + size]

    def numbers(self) -> np.ndarray:
        kind, data = self.next()
        if kind not in NUMBERS:
            raise ValueError(f"numbers of type {kind} are not supported")
        return np.frombuffer(data, np.dtype(NUMBERS[kind]).newbyteorder(self.order))


def leaves(data: bytes) -> Iterator[Leaf]:
    """(way, kind, dims, numbers, text) of every matrix and text of a file."""
    if len(data) < 128 or data[126:128] not in (b"IM", b"MI"):
        raise ValueError("not a level 5 MAT file")
    own = Elements(data, "<" if data[126:128] == b"IM" else ">", 128)
    while own:
        yield from _element(*own.next(), own.order, [])


def _element(kind: int, data: memoryview, order: str, way: list[str]) -> Iterator[Leaf]:
    if kind == DEFLATED:
        yield from _element(*Elements(zlib.decompress(data), order).next(), order, way)
    elif kind == MATRIX:
        yield from _matrix(Elements(data, order), way)


def _matrix(own: Elements, way: list[str]) -> Iterator[Leaf]:
    if not own:  # an empty cell
        yield way, "matrix", [0, 0], np.zeros(0), None
        return
    class_ = int(own.numbers()[0]) & 0xFF
    dims = own.numbers().astype(int).tolist()
    name = bytes(own.next()[1]).decode("latin-1")
    way, n = way or [name], int(np.prod(dims))
    if class_ == CELL:
        for i in range(n):
            yield from _element(*own.next(), own.order, [*way, str(i)])
        if not n:
            yield way, "cell", dims, np.zeros(0), None
    elif class_ == STRUCT:
        width = int(own.numbers()[0])
        raw = bytes(own.next()[1])
        fields = [raw[i : i + width].split(b"\0")[0].decode("latin-1") for i in range(0, len(raw), width)]
        for i in range(n):
            for field in fields:
                yield from _element(*own.next(), own.order, [*way, str(i), field])
    elif class_ == CHAR:
        kind, data = own.next()
        text = bytes(data).decode("utf-8" if kind in (1, 2, 16) else "utf-16-le" if own.order == "<" else "utf-16-be", "replace")
        yield way, "text", dims, None, text
    elif class_ == SPARSE or class_ < 6 or class_ > 15:
        raise ValueError(f"{'.'.join(way)}: matrices of class {class_} are not supported")
    else:
        yield way, "matrix", dims, own.numbers().astype(float), None  # imaginary parts, if any, follow and are left


def scan(spark: SparkSession, path: str) -> DataFrame:
    """One row for each leaf of each file: path, way, kind, dims, numbers (columns first; not a number is null), text. A label file is small, and is read as one row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mat").option("recursiveFileLookup", True).load(path).select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                try:
                    rows = [(name, *leaf) for leaf in leaves(content)]
                except (ValueError, zlib.error, struct.error) as e:
                    raise ValueError(f"{name}: {e}") from e
                yield pd.DataFrame(rows, columns=["path", "way", "kind", "dims", "numbers", "text"])

    return files.mapInPandas(decode, SCHEMA).withColumn("numbers", F.transform("numbers", lambda v: F.when(~F.isnan(v), v)))


def _at(i: int) -> Column:
    return F.get("way", F.lit(i))


def positions(found: DataFrame, variable: str, field: str) -> DataFrame:
    """path, subject (number in the struct), run, tr, rn, x, y of the samples in ``variable``.``field``: cells of runs of cells of TRs, each 2 x n or n x 2; TRs without samples have no rows."""
    m = found.where((_at(0) == variable) & (_at(2) == field) & (F.size("way") == 5) & (F.col("kind") == "matrix"))
    tall = F.get("dims", F.lit(1)) == 2
    n = F.when(tall, F.get("dims", F.lit(0))).otherwise(F.get("dims", F.lit(1)))
    v, i = F.col("numbers"), F.col("rn").cast("int")
    rows = m.select("path", _at(1).cast("int").alias("subject"), _at(3).cast("int").alias("run"), _at(4).cast("long").alias("tr"), "numbers", tall.alias("tall"), n.alias("n"))
    rows = rows.where("n > 0").withColumn("rn", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    x, y = F.when(F.col("tall"), F.get(v, i)).otherwise(F.get(v, 2 * i)), F.when(F.col("tall"), F.get(v, F.col("n") + i)).otherwise(F.get(v, 2 * i + 1))
    return rows.select("path", "subject", "run", "tr", F.col("rn").cast("long").alias("rn"), x.alias("x"), y.alias("y"))


def subjects(found: DataFrame, variable: str, field: str = "subID") -> DataFrame:
    """path, subject, participant: the id of each of a struct's elements as text; a file whose struct has none is one participant, named by its path."""
    name = F.coalesce("text", F.get("numbers", F.lit(0)).cast("long").cast("string"))
    named = found.where((_at(0) == variable) & (_at(2) == field) & (F.size("way") == 3)).select("path", _at(1).cast("int").alias("subject"), name.alias("participant"))
    every = found.where((_at(0) == variable) & (F.size("way") >= 3)).select("path", _at(1).cast("int").alias("subject")).distinct()
    return every.join(named, ["path", "subject"], "left").select("path", "subject", F.coalesce("participant", "path").alias("participant"))


def samples(found: DataFrame, variable: str, target: str | None, measured: str | None, subject_field: str = "subID") -> DataFrame:
    """participant, run, tr, rn, rx, ry, tx, ty, as ``labels.with_fallback`` takes them, from the fields with target and measured positions (None: there are none)."""
    key = ["path", "subject", "run", "tr", "rn"]
    one = lambda field, c: positions(found, variable, field or "").select(*key, F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y"))
    both = one(measured, "r").join(one(target, "t"), key, "full")
    return both.join(subjects(found, variable, subject_field), ["path", "subject"]).select("participant", "run", "tr", "rn", "rx", "ry", "tx", "ty")


def expected(found: DataFrame, variable: str, fields: tuple[str, ...], subject_field: str = "subID") -> DataFrame:
    """participant, run, tr of all TRs that have a cell in one of the fields, with samples or without."""
    cells = found.where((_at(0) == variable) & _at(2).isin(list(fields)) & (F.size("way") == 5)).select("path", _at(1).cast("int").alias("subject"), _at(3).cast("int").alias("run"), _at(4).cast("long").alias("tr"))
    return cells.distinct().join(subjects(found, variable, subject_field), ["path", "subject"]).select("participant", "run", "tr").distinct()


def means(found: DataFrame, variable: str, field: str = "TR_xy", subject_field: str = "subID") -> DataFrame:
    """participant, run, tr, x, y from cells of runs, each TRs x 2 or 2 x TRs."""
    m = found.where((_at(0) == variable) & (_at(2) == field) & (F.size("way") == 4) & (F.col("kind") == "matrix")).withColumn("way", F.concat("way", F.array(F.lit("0"))))
    return positions(m, variable, field).join(subjects(found, variable, subject_field), ["path", "subject"]).select("participant", "run", F.col("rn").alias("tr"), "x", "y")
