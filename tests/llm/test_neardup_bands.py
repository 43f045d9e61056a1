"""Near copies by how similar they are: all at 0.8 and above are linked, none below."""

import collections
import random

from tests.llm.test_ops import words
from volumetra.llm import neardup
from volumetra.llm.wordhash import shingle_bag


def similarity(a, b):
    x, y = shingle_bag(a), shingle_bag(b)
    return len(x & y) / len(x | y)


def copies(rng, kind, n):
    """A text and a copy of it with ``n`` edits of one kind, spread over it."""
    own = words(rng.randint(80, 260), rng.random()).split()
    other = list(own)
    for at in sorted(rng.sample(range(len(own)), n), reverse=True):
        if kind == "replace":
            other[at] = f"zz{rng.randrange(10**6)}"
        elif kind == "insert":
            other.insert(at, f"zz{rng.randrange(10**6)}")
        elif kind == "delete":
            del other[at]
        else:
            other += own[at : at + 3]
    return " ".join(own), " ".join(other)


def test_recall_by_similarity(spark):
    rng, rows, at = random.Random(0), [], {}
    for kind in ("replace", "insert", "delete", "append"):
        for n in range(1, 8):
            for _ in range(12):
                a, b = copies(rng, kind, n)
                at[len(rows), len(rows) + 1] = similarity(a, b)
                rows += [(len(rows), a), (len(rows) + 1, b)]
    out = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    found, count = collections.Counter(), collections.Counter()
    for (a, b), s in at.items():
        band = int(s * 20)
        count[band] += 1
        found[band] += out[a] == out[b]
    assert all(count[band] >= 15 for band in range(14, 20))  # 0.7 to 1 by 0.05
    assert all(found[band] == (count[band] if band >= 16 else 0) for band in count), (found, count)
