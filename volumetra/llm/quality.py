"""Quality rules: a threshold table compiled into one projection.

Each rule names a measure and the range in which it must lie. ``compile_rules`` turns the table into columns
of a single projection of built-in functions: no user function, no shuffle, no explode.

Defined results: a null or empty text has no words, fails the base rule and is not kept; repeated rows are judged alike; columns with
clashing names don't matter, as only id and text are read and only new columns come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volumetra.llm.common import SPACE, text_or_empty

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it was for on as with be by at this are or from "
    "der die das und ist nicht ein eine mit auf den von zu im in sich des für "
    "le la les et de des un une que est pour dans en du au sur par "
    "el la los las y de que en un una por con no se su es lo"
).split()

#: (rule, measure, least, most); None: no bound on that side.
RULES = (
    ("words", "n_words", 10, None),
    ("word_length", "mean_word_chars", 1.5, 20.0),
    ("symbols", "symbol_ratio", None, 0.5),
    ("stop_words", "stop_ratio", 0.005, None),
    ("dup_lines", "dup_line_ratio", None, 0.5),
    ("repeats", "repeat_ratio", None, 0.2),
)


def repeated_words(words: Column, width: int = 5) -> Column:
    """How many words lie in a window of ``width`` words that occurs twice or more in the text.

    Windows are compared by a 64-bit hash of their words. If all are different, a hash set says so at once; else the
    (hash, position) pairs are sorted, and each window equal to a neighbour covers its words once.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    starts = F.sequence(F.lit(1), F.size(words) - width + 1)
    windows = lambda h: F.transform(starts, lambda i: F.xxhash64(*[F.element_at(h, (i + k).cast("int")) for k in range(width)]))
    one = lambda x: F.array(x)

    def covered(w: Column) -> Column:
        pairs = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, i, j: (j >= 0) & (j < F.size(s)) & (F.get(s, i)["h"] == F.get(s, j)["h"])
        at = lambda s: F.array_sort(F.transform(F.filter(F.transform(s, lambda p, i: F.struct(p["i"].alias("i"), (same(s, i, i - 1) | same(s, i,
            i + 1)).alias("twice"))), lambda p: p["twice"]), lambda p: p["i"]))
        width_sum = lambda a: F.aggregate(F.transform(a, lambda x, i: F.when(i + 1 < F.size(a), F.least(F.lit(width), F.get(a,
            i + 1) - x)).otherwise(width)), F.lit(0), lambda s, x: s + x)
        return F.element_at(F.transform(F.transform(one(pairs), at), width_sum), 1)

    count = lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w))
    full = F.element_at(F.transform(F.transform(one(hashes), windows), count), 1)
    return F.when(F.size(words) > width, full).otherwise(0).cast("long")


def measures(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: doc_id, the counts, and the ratios that the rules use."""
    text = text_or_empty(text_col)
    parts = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    parts = parts.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stop = F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))
    counted = parts.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.coalesce(F.length("text") - F.regexp_count("text", F.lit(SPACE)), F.lit(0)).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("own"))).getItem(0).alias("lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size(stop).cast("long").alias("n_stop"),
    )
    n = F.greatest("n_words", F.lit(1))
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols",
        (F.col("lines.n") - F.col("lines.own")).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        (F.col("word_chars") / n).alias("mean_word_chars"),
        (F.col("n_symbols") / n).alias("symbol_ratio"),
        (F.col("n_stop") / n).alias("stop_ratio"),
        ((F.col("lines.n") - F.col("lines.own")) / F.greatest("lines.n", F.lit(1))).alias("dup_line_ratio"),
        (F.col("n_repeat_words") / n).alias("repeat_ratio"),
    )


def compile_rules(rules=RULES) -> dict[str, Column]:
    """Rule name -> whether the rule is broken."""
    broken = {}
    for name, measure, least, most in rules:
        tests = [F.col(measure) < least] * (least is not None) + [F.col(measure) > most] * (most is not None)
        broken[name] = tests[0] if len(tests) == 1 else tests[0] | tests[1]
    return broken


def judge(docs: DataFrame, rules=RULES, id_col="doc_id", text_col="text") -> DataFrame:
    """Measures, ``base_failed``, ``kept`` and ``broken`` (names of the rules that a document breaks) of each document."""
    found = compile_rules(rules)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    names = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in found.items()]), lambda x: x.isNotNull())
    out = measures(docs, id_col, text_col).withColumns({"base_failed": base, "broken": names})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
