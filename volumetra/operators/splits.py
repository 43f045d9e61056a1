"""Reproducible splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volumetra.operators.metrics import complete_trs


#: Parts in which units are ranked.
BUCKETS = 1024


def mixed_hash(c: str) -> str:
    """A cheap hash that any engine can replay."""
    return f"({c} * 7919 + 13) % 100003"


def holdout(units: DataFrame, dataset: str, unit: str, share: float) -> DataFrame:
    """The first part of each dataset, in hash order, trains."""
    w = Window.partitionBy(dataset)
    rn = F.row_number().over(w.orderBy(F.expr(mixed_hash(unit)), unit))
    return units.withColumn("part", F.when(rn <= F.floor(F.lit(share) * F.count(F.lit(1)).over(w)), "train").otherwise("test"))


def placed(units: DataFrame, unit: str) -> DataFrame:
    """``units`` with ``place`` (from 0) and ``total``, in the order of a bucket of the unit's hash and then the unit (a number).

    Each bucket is ranked on its own; what comes before a bucket is a sum over the ``BUCKETS`` counts, so no task gets all units.
    """
    dealt = units.withColumn("bucket", F.expr(f"pmod({mixed_hash(unit)}, {BUCKETS})"))
    counts = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("bucket", before.alias("start"), F.sum("n").over(Window.partitionBy()).alias("total"))  # BUCKETS rows at most
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(unit)) - 1
    return dealt.withColumn("rank", rank).join(F.broadcast(starts), "bucket").withColumn("place", F.col("start") + F.col("rank")).drop("bucket", "rank", "start")


def folds(units: DataFrame, unit: str, k: int) -> DataFrame:
    """(fold, unit, part): in fold f its units test and all others train. The first n mod k folds have one unit more."""
    f = placed(units.select(unit), unit).withColumns({"q": F.expr(f"total div {k}"), "r": F.expr(f"total % {k}")})
    own = F.expr("case when place < r * (q + 1) then place div (q + 1) else r + (place - r * (q + 1)) div q end")
    f = f.select(unit, own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
    return f.select(F.col("fold").cast("long").alias("fold"), unit, F.when(F.col("fold") == F.col("own"), "test").otherwise("train").alias("part"))


def leave_one_out(units: DataFrame, dataset: str, unit: str) -> DataFrame:
    """(held_out, unit, part) for each dataset. The output is units times datasets by design; the list of dataset names that is sent to each task has one name a dataset."""
    names = units.select(dataset).distinct().agg(F.sort_array(F.collect_list(dataset)).alias("names"))
    every = units.join(F.broadcast(names)).withColumn("held_out", F.explode("names"))  # one row, one list of dataset names
    return every.select("held_out", unit, F.when(F.col(dataset) == F.col("held_out"), "test").otherwise("train").alias("part"))


def subset(units: DataFrame, column: str, members) -> DataFrame:
    """Only units whose ``column`` is among ``members``: a list, or a DataFrame with that column."""
    return units.join(members.select(column).distinct(), column, "left_semi") if isinstance(members, DataFrame) else units.where(F.col(column).isin(list(members)))


def split(units: DataFrame, how: str, unit: str, dataset: str | None = None, share: float = 0.6, k: int = 5, members=None) -> DataFrame:
    """(round, unit, part) by any of the ways: ``holdout`` (one round), ``folds``, ``leave_one_out``; ``members``: only these datasets take part."""
    units = units if members is None else subset(units, dataset, members)
    if how == "holdout":
        return holdout(units, dataset, unit, share).select(F.lit("0").alias("round"), unit, "part")
    if how == "folds":
        return folds(units, unit, k).select(F.col("fold").cast("string").alias("round"), unit, "part")
    if how == "leave_one_out":
        return leave_one_out(units, dataset, unit).select(F.col("held_out").cast("string").alias("round"), unit, "part")
    raise ValueError(f"no way of splitting: {how}")


def sides(samples: DataFrame, parts: DataFrame, round_: str, unit: str) -> tuple[DataFrame, DataFrame]:
    """(train, test): the samples of the units that a round of ``split`` puts on each side."""
    own = parts.where(F.col("round") == round_)
    return tuple(samples.join(own.where(F.col("part") == side).select(unit), unit, "left_semi") for side in ("train", "test"))


def within(g: DataFrame, a: float, b: float) -> DataFrame:
    """By time in a participant: the share [a, b) of its TRs trains, what comes after (or, if a > 0, before) tests. Half-open: no TR is in both."""
    n = F.max("tr").over(Window.partitionBy("participant")) + 1
    lo, hi = F.floor(F.lit(a) * n), F.floor(F.lit(b) * n)
    test = (F.col("tr") >= hi) if a == 0 else (F.col("tr") < lo)
    return g.withColumn("part", F.when((F.col("tr") >= lo) & (F.col("tr") < hi), "train").when(test, "test")).where("part is not null")


def _people(g: DataFrame) -> DataFrame:
    """(participant, n, place, total) of participants with samples."""
    return placed(g.groupBy("participant").agg(F.count(F.lit(1)).alias("n")), "participant")


def _fetch(at: DataFrame, g: DataFrame) -> DataFrame:
    return at.join(g.select("participant", "rn", "x", "y"), ["participant", "rn"])


def mixed_batch(g: DataFrame, slots: int) -> DataFrame:
    """With replacement: each slot draws a participant, all alike, then one of its samples."""
    people = _people(g)
    size = people.agg(F.max("total").alias("m"))
    drawn = g.sparkSession.range(slots).withColumnRenamed("id", "slot").join(F.broadcast(size)).withColumn("place", F.expr(f"{mixed_hash('slot')} % m"))  # one row
    at = drawn.select("slot", "place").join(people.select("place", "participant", "n"), "place").withColumn("rn", F.expr("(slot * 104729 + 7) % 99991 % n"))
    return _fetch(at.select("slot", "participant", "rn"), g)


def batches(g: DataFrame, epochs: int, steps: int, batch: int, mixed: bool = True) -> DataFrame:
    """(epoch, step, slot, participant, rn, x, y): a bounded stream of batches. ``mixed``: each slot draws its participant, else one is drawn a step."""
    drawn = g.sparkSession.range(epochs * steps * batch).select("id", *[F.expr(e).alias(c) for c, e in (("epoch", f"id div {steps * batch}"), ("step", f"id div {batch} % {steps}"), ("slot", f"id % {batch}"))])
    return filled(drawn, g, steps, mixed)


def filled(slots: DataFrame, g: DataFrame, steps: int, mixed: bool = True) -> DataFrame:
    """The samples that the slots (id, epoch, step, slot) of batches draw; ``slots`` may be a stream."""
    people = _people(g)
    size = people.agg(F.max("total").alias("m"))
    drawn = slots.join(F.broadcast(size)).withColumn("place", F.expr(f"{mixed_hash('id' if mixed else f'(epoch * {steps} + step)')} % m"))  # one row
    at = drawn.join(people.select("place", "participant", "n"), "place").withColumn("rn", F.expr("(id * 104729 + 7) % 99991 % n"))
    return _fetch(at.select("epoch", "step", "slot", "participant", "rn"), g)


def own_draws(g: DataFrame, draws: int) -> DataFrame:
    """(participant, draw, rn, x, y): ``draws`` samples of each participant, with replacement."""
    n = g.groupBy("participant").agg(F.count(F.lit(1)).alias("n"))
    at = n.select("participant", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))).alias("draw")).withColumn("rn",
        F.expr("(draw * 104729 + participant * 7919 + 7) % 99991 % n"))
    return _fetch(at.select("participant", "draw", "rn"), g)


def complete_index(p: DataFrame) -> DataFrame:
    """(participant, i, tr): the complete TRs of each participant, numbered from 0, to be joined to its files."""
    w = Window.partitionBy("participant").orderBy("tr")
    return complete_trs(p).select("participant", "tr").distinct().select("participant", (F.row_number().over(w) - 1).cast("long").alias("i"), "tr")


def concatenate_runs(g: DataFrame) -> DataFrame:
    """``g`` with the TRs of each participant's runs numbered on from run to run."""
    lengths = g.groupBy("participant", "run").agg((F.max("tr") + 1).alias("length"))
    before = F.coalesce(F.sum("length").over(Window.partitionBy("participant").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0))  # runs of one participant
    return g.join(lengths.select("participant", "run", before.alias("before")), ["participant", "run"]).withColumn("tr", F.col("tr") + F.col("before")).drop("before")


def names(paths: DataFrame, path: str = "path", cut: int = 7) -> DataFrame:
    """``paths`` with ``name``: the last ``cut`` characters of the file's name before its suffixes."""
    return paths.withColumn("name", F.right(F.substring_index(F.substring_index(path, "/", -1), ".", 1), F.lit(cut)))
