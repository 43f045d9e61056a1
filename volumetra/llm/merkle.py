"""A Merkle manifest of a table: a digest for every row, one for all of it, and for each row a proof that it belongs.

Rows are leaves. The leaves of each group (language) are ordered by id, and while more than one node remains, every ``FANOUT`` consecutive ones become the digest of
their concatenation; what remains is the group's subroot. The subroots, ordered by group, are reduced likewise to the root.

Superblocks: node i of a run lies in bucket i div fanout^k, and one ``applyInPandas`` over the buckets collapses k levels at once, so the number of rows falls
by fanout^k with each exchange and no task has more than a bucket, however large a group is. The roots of the buckets are reduced in the same way until one is left in each group. A row's
proof is made of the proof within its bucket, that of its bucket in the next superblock, and so on up; lower proofs are only made when the upper ones are known, and are
never written. Positions are found without a global sort: rows are sorted within ranges, and a count for each range and group gives the first position.

A step of a proof is the run's other nodes, ``left|right``: both are empty where a node is alone.

Defined results: nulls are ``-`` and so differ from empty strings; a null group comes first and a null id last in its group; rows equal in id are ordered by
their digest, and equal rows are leaves of their own; texts of any length are digested whole; columns other than those named are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volumetra.llm.common import partitions, scratch, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT, LEVELS = 2, 10


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    """SHA-256 of the concatenation, in lowercase hex."""
    return F.sha2(F.concat(*values), 256)


def leaf(fields: tuple[str, ...] = FIELDS, **changed: Column) -> Column:
    return digest(*[encoded(changed.get(f, F.col(f))) for f in fields])


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, start, lambda node, step: digest(F.substring_index(step, "|", 1), node, F.substring_index(step, "|", -1)))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings in turn."""
    return F.sha2(F.replace(F.array_join(proof, ""), F.lit("|"), F.lit("")), 256)


def collapse(nodes: list[str], total: int, fanout: int, levels: int, proofs: bool) -> tuple[str, list[list[str]]]:
    """(node of the bucket, steps of each node level by level) after ``levels`` levels, or when one node remains of the ``total`` in the whole run."""
    steps: list[list[str]] = []
    leaves = np.arange(len(nodes)) if proofs else None
    for level in range(levels):
        if total == 1:
            break
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        if proofs:
            own = [f"{''.join(r[:j])}|{''.join(r[j + 1 :])}" for r in runs for j in range(len(r))]
            steps.append([own[i] for i in (leaves // fanout**level).tolist()])
        nodes = [hashlib.sha256("".join(r).encode()).hexdigest() for r in runs]
        total = -(-total // fanout)
    return nodes[0], steps


Keep = Callable[[DataFrame], DataFrame]


def positions(rows: DataFrame, key: str, order: list[Column], keep: Keep = lambda df: df) -> DataFrame:
    """``rows`` with ``index`` (from 0 within each key) and ``total`` (rows of the key), without a task that gets all rows of a key. ``keep`` gets the tables that the result reads."""
    by = [F.col(key).asc(), *order]
    part, at = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = keep(table(rows.repartitionByRange(partitions(rows.sparkSession), *by).sortWithinPartitions(*by).withColumns({"__part": part, "__at": at}), "leaves"))
    counts = dealt.groupBy("__part", key).agg(F.min("__at").alias("__from"), F.count(F.lit(1)).alias("__n"))
    own = Window.partitionBy(key)
    before = F.coalesce(F.sum("__n").over(own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = keep(table(counts.select("__part", key, (before - F.col("__from")).alias("__base"), F.sum("__n").over(own).alias("total")), "leaf-starts"))
    return dealt.join(starts, ["__part", key]).withColumn("index", F.col("__base") + F.col("__at")).drop("__part", "__at", "__base")


def _bucket(fanout: int, levels: int) -> Column:
    return F.call_function("div", F.col("index"), F.lit(fanout**levels)).alias("bucket")


def prove(nodes: DataFrame, key: str, fanout: int = FANOUT, levels: int = LEVELS, keep: Keep = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(``nodes`` with ``proof`` up to the root of their key, and key, ``root``); nodes: key, index, total, node and what else they carry. ``keep`` gets the table that the first reads."""
    size = fanout**levels
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    columns = list(kinds)

    def summit(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("index")
        total = int(p["total"].iloc[0])
        node, _ = collapse(p["node"].tolist(), total, fanout, levels, False)
        return pd.DataFrame({key: [p[key].iloc[0]], "index": [int(p["index"].iloc[0]) // size], "total": [-(-total // size)], "node": [node]})

    def within(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("index")
        _, steps = collapse(p["node"].tolist(), int(p["total"].iloc[0]), fanout, levels, True)
        out = p[columns].assign(bucket=p["index"] // size)
        out["proof"] = [list(s) for s in zip(*steps)] if steps else [[] for _ in range(len(p))]
        return out

    slim = nodes.select(key, "index", "total", "node")
    tops = table(slim.groupBy(key, _bucket(fanout, levels)).applyInPandas(summit, f"{key} {kinds[key]}, index long, total long, node string"), "superblocks")
    if (tops.agg(F.max("total")).first()[0] or 1) > 1:
        upper, roots = prove(tops, key, fanout, levels)
        upper = keep(table(upper.select(key, F.col("index").alias("bucket"), F.col("proof").alias("upper")), "upper-proofs"))
    else:
        upper, roots = None, tops.select(key, F.col("node").alias("root"))
    lower = nodes.groupBy(key, _bucket(fanout, levels)).applyInPandas(within, ", ".join([f"{c} {k}" for c, k in kinds.items()] + ["bucket long", "proof array<string>"]))
    if upper is not None:
        lower = lower.join(upper, [key, "bucket"]).withColumn("proof", F.concat("proof", "upper"))
    return lower.select(*columns, "proof"), roots


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", id_col: str = "doc_id", tampered: Column | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """One row per document: id, leaf, shown (digest of ``tampered``, or the leaf), subroot, root, proof (steps from the leaf to the root).

    ``tampered``: the leaf of a row as someone shows it; null where it is the row's own.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("key"), F.col(id_col).alias("id"), leaf(fields).alias("node"),
        (F.lit(None).cast("string") if tampered is None else tampered).alias("shown"))
    with scratch(spark) as keep:
        placed = positions(rows, "key", [F.col("id").asc_nulls_last(), F.col("node").asc(), F.col("shown").asc()], keep)
        slim = placed.withColumn("id", F.col("id").cast("string"))  # pandas has no whole numbers with nulls
        proved, subroots = prove(slim, "key", fanout, levels, keep)
        groups = positions(subroots.select(F.lit("").alias("all"), "key", F.col("root").alias("node")), "all", [F.col("key").asc()])
        above, root = prove(groups, "all", fanout, levels)
        tops = above.join(root, "all").select("key", F.col("node").alias("subroot"), F.col("proof").alias("above"), "root")
        tops = keep(table(tops, "group-proofs"))
    out = proved.join(tops, "key")
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("node").alias("leaf"), F.coalesce("shown", "node").alias("shown"), "subroot", "root", F.concat("proof", "above").alias("proof"))


def digests(proved: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Every proof checked: its digest, the root it leads to from what is shown, and whether that is the root."""
    folded = proved.withColumn("folded_root", fold(F.col("shown"), F.col("proof")))
    return folded.select(id_col, "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def one_more_character(every: int = 7, id_col: str = "doc_id") -> Column:
    """The leaf with ``n_chars`` one higher, for the rows whose id's checksum ``every`` divides; null for the others."""
    picked = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(every)) == 0
    return F.when(picked, leaf(n_chars=F.col("n_chars") + 1))
