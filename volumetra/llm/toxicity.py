"""Toxicity by a subsequence string kernel support vector machine with Nyström landmarks.

The kernel of two words counts their common subsequences of three characters that span at most ``SPAN`` places, each gap
costing a factor ``DECAY``, so an insult with inserted or replaced characters stays close to the plain one.
Training is by multiple instances: a labelled text, taken as the bag of its words, says that a toxic bag holds words that mark it and a clean one
none. Round after round, at most ``ROUNDS`` of them, the marks
of the toxic bags are taken anew by the machine of the round before (at first by how often words occur in toxic and clean bags), and every word of a clean bag that
comes too near joins the negative side, so that the working set tends to that of all words. Nyström features come from a few landmark words; on them a linear
support vector machine (squared hinge,
Newton steps) is trained. As the machine is linear in the kernel with the landmarks, it folds into one
weight a subsequence, and a word is scored by a sum over its own subsequences. A document's margins are those of its ``TOP`` worst words (runs of
single characters count as one word). A logistic curve over them makes a score; it is fitted on bags that its machine was not trained on, weighted to
the true share of toxic ones.

The classifier is fitted on at most ``SAMPLE`` toxic and as many clean labelled documents, chosen by a hash of the id; no other bound is set.
Everything else sees whole texts.

Defined results: null and empty texts get the score of the lowest margins; null ids or labels take no part in training; of rows with one id the least
text trains; equal texts score alike; texts and words of any length are
scored whole; other columns are carried but not read, whatever their names; without toxic or without clean training
documents every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volumetra.llm import wordhash as wh
from volumetra.llm.common import lean, release, text_or_empty

U = np.uint64
SAMPLE, LANDMARKS, DECAY, SPAN, BITS = 2000, 192, 0.6, 6, 16
LONGEST = 32
FLOOR = -2.0
THRESHOLD = 0.3
#: Words whose margins make a document's score, rounds of training.
TOP, ROUNDS = 3, 5
#: Words whose subsequences are taken at a time.
CHUNK = 2000
_PAIRS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def normal(word: str) -> str:
    """Lower case, without signs at the ends."""
    word = word.lower()
    i, j = 0, len(word)
    while i < j and not word[i].isalnum():
        i += 1
    while j > i and not word[j - 1].isalnum():
        j -= 1
    return word[i:j]


def _parts(word: str) -> list[str]:
    """A very long token is taken in overlapping stretches, so all of it is seen."""
    bare = "".join(c for c in word if c.isalnum())
    forms = [word] if bare == word else [word, bare]  # signs between all characters are no hiding place
    return [p for w in forms for p in ([w] if len(w) <= LONGEST else [w[i : i + LONGEST] for i in range(0, len(w) - SPAN, LONGEST - SPAN)])]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, weight), normalised so that each word has kernel 1 with itself; summed by word and subsequence."""
    width = max(map(len, words), default=0) + 1
    grid = np.zeros((len(words), width + SPAN), U)
    for i, w in enumerate(words):
        grid[i, : len(w) + 1] = [2, *map(ord, w)]
    keys, weights, owner = [], [], np.repeat(np.arange(len(words)), width).reshape(len(words), width)
    for a, b in _PAIRS:
        x, y, z = grid[:, :width], grid[:, a : a + width], grid[:, b : b + width]
        there = z > 0
        code = wh.mix(x * U(0x9E3779B1) + (y << U(21)) + (z << U(42)))[there] >> U(64 - BITS)
        keys.append((owner[there].astype(np.int64) << BITS) + code.astype(np.int64))
        weights.append(np.full(len(code), DECAY ** (b - 2)))
    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    if not len(key):
        return key, key, weight
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    key, weight = key[first], np.add.reduceat(weight, first)
    word = key >> BITS
    norm = np.sqrt(np.bincount(word, weights=weight**2, minlength=len(words)))
    return word, key & ((1 << BITS) - 1), weight / norm[word]


def _different(bags: list[list[str]]) -> list[int]:
    """One bag of each group of near copies, so that a word of a text that is copied often doesn't look frequent."""
    seen, kept = set(), []
    for i, bag in enumerate(bags):
        if not bag:
            kept.append(i)
            continue
        h = np.array([zlib.crc32(w.encode()) for w in bag], U)
        least = [int(wh.mix(h * U(0x9E3779B97F4A7C15) + U(k)).min()) for k in range(6)]
        bands = {(k, least[k], least[k + 1], least[k + 2]) for k in (0, 3)}
        if not bands & seen:
            kept.append(i)
        seen |= bands
    return kept


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: np.ndarray
    shift: float

    def words(self, words: list[str]) -> np.ndarray:
        """Margin of each word."""
        out = np.empty(len(words))
        for s in range(0, len(words), CHUNK):
            some = [_parts(normal(w)) for w in words[s : s + CHUNK]]
            flat = [p for ps in some for p in ps]
            word, key, weight = subsequences(flat)
            value = np.bincount(word, weights=weight * self.weights[key], minlength=len(flat)) + self.bias
            value = np.where(np.bincount(word, minlength=len(flat)) > 0, value, FLOOR)
            at = np.cumsum([0] + [len(ps) for ps in some])[:-1]
            out[s : s + CHUNK] = np.maximum.reduceat(value, at)
        return np.maximum(out, FLOOR)

    def score(self, margins: np.ndarray) -> np.ndarray:
        """Of rows of ``TOP`` margins."""
        return 1 / (1 + np.exp(-(np.clip(margins, -1, 1) @ self.slope + self.shift)))


def _dense(words: list[str]) -> np.ndarray:
    word, key, weight = subsequences(words)
    out = np.zeros((len(words), 1 << BITS), np.float32)
    out[word, key] = weight
    return out


def _project(words: list[str], basis: np.ndarray) -> np.ndarray:
    """Kernel features of the words times ``basis`` (2**BITS, k)."""
    out = np.zeros((len(words), basis.shape[1]), np.float32)
    for i in range(0, len(words), CHUNK // 20):  # a row of the basis for each subsequence
        word, key, weight = subsequences(words[i : i + CHUNK // 20])
        if len(word):
            own, first = np.unique(word, return_index=True)
            out[i + own] = np.add.reduceat(basis[key] * weight[:, None].astype(np.float32), first, axis=0)
    return out


def _machine(z: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 50.0) -> np.ndarray:
    """Linear machine with squared hinge loss; the last column of z is the constant."""
    w = np.zeros(z.shape[1])
    for _ in range(30):
        live = y * (z @ w) < 1
        a = z[live] * weight[live, None]
        new = np.linalg.solve(a.T @ z[live] * cost + np.eye(z.shape[1]), cost * a.T @ y[live])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def _landmarks(marks: list[str], others: list[str], n: int) -> list[str]:
    """Marks far from each other, farthest first, and common other words."""
    picked, near = [], np.full(len(marks), -1.0)
    while len(picked) < min(n * 3 // 4, len(marks)):
        i = int(np.argmin(near))
        if near[i] > 0.999:
            break
        picked.append(i)
        near = np.maximum(near, _project(marks, _dense([marks[i]]).T)[:, 0])
    return [marks[i] for i in picked] + others[: n - len(picked)]


class _Bags:
    """Bags of words with their labels and how likely each word marks a toxic one."""

    def __init__(self, bags: list[list[str]], y: np.ndarray, share: float):
        self.bags, self.y = bags, y
        toxic, self.clean = Counter(), Counter()
        for bag, label in zip(bags, y):
            (toxic if label else self.clean).update(bag)
        self.n1, self.n0 = int(y.sum()), int(len(y) - y.sum())
        # share of toxic ones among documents that hold the word, at the true share of toxic documents
        likely = lambda w, p: p / self.n1 * share / (p / self.n1 * share + (self.clean[w] + 0.05) / self.n0 * (1 - share))
        self.likely = {w: likely(w, p) for w, p in toxic.items()}
        self.toxic = toxic

    def first_marks(self) -> list[str]:
        """Words so frequent in toxic bags alone that chance would not make one among all words; bags without such a word give their likeliest repeated word."""
        rare = np.log(max(2, len(self.toxic)) / 0.05) / -np.log(self.n1 / (self.n1 + self.n0))
        good = {w for w, r in self.likely.items() if r > 0.8 and len(w) > 2}
        marks = {w for w in good if self.toxic[w] >= rare}
        for bag, label in zip(self.bags, self.y):
            if label and not marks.intersection(bag):
                own = [w for w in bag if w in good and self.toxic[w] >= 3]
                if own:
                    marks.add(max(own, key=lambda w: (self.toxic[w], w)))
        return sorted(marks, key=lambda w: (-self.toxic[w], w))


def _trained(data: _Bags, landmarks: int) -> Model | None:
    """The machine, without a curve."""
    marks = data.first_marks()
    negative = [w for w, _ in sorted(data.clean.items(), key=lambda x: (-x[1], x[0])) if data.likely.get(w, 0.0) < 0.5]
    if not marks or not negative:
        return None
    base = _dense(_landmarks(marks, negative, landmarks))
    value, vector = np.linalg.eigh((base @ base.T).astype(float))
    good = value > 1e-6
    root = vector[:, good] / np.sqrt(value[good])
    basis = (base.T @ root.astype(np.float32)).astype(np.float32, copy=False)
    del base
    maybe = sorted(w for w, r in data.likely.items() if r > 0.8 and len(w) > 2)
    live = set(negative[: max(1000, len(marks))])  # the working set of the negative side
    z_of: dict[str, np.ndarray] = {}
    model = None
    for step in range(ROUNDS):
        words = marks + sorted(live)
        new = [w for w in words if w not in z_of]
        z_of.update(zip(new, _project(new, basis)))
        z = np.hstack([np.stack([z_of[w] for w in words]).astype(float), np.ones((len(words), 1))])
        side = np.concatenate([np.ones(len(marks)), -np.ones(len(live))])
        weight = np.where(side > 0, len(words) / (2 * len(marks)), len(words) / (2 * len(live)))
        w = _machine(z, side, weight / weight.mean())
        model = Model((basis @ w[:-1].astype(np.float32)).astype(float), float(w[-1]), np.ones(TOP), 0.0)
        if step == ROUNDS - 1:
            break
        near = model.words(negative)
        more = {x for x, m in zip(negative, near) if m > -1} - live
        margin = dict(zip(maybe, model.words(maybe)))
        again = [x for x in maybe if margin[x] > 0 and data.toxic[x] >= 2 or margin[x] > 1]
        for bag, label in zip(data.bags, data.y):
            own = [x for x in bag if x in margin] if label else []
            if own and not any(margin[x] > 0 for x in own):
                best = max(own, key=lambda x: (margin[x], x))
                if margin[best] > -0.5:
                    again.append(best)
        again = sorted(set(again))
        if not more and again == sorted(marks):
            break
        live |= more
        marks = again or marks
    return model


def _margins(model: Model, bags: list[Counter]) -> np.ndarray:
    """(bag, TOP): margins of each bag's worst words, repeated ones as often as they occur."""
    every = sorted({w for bag in bags for w in bag})
    margin = dict(zip(every, model.words(every)))
    top = [sorted((margin[w] for w, n in bag.items() for _ in range(min(n, TOP))), reverse=True)[:TOP] for bag in bags]
    return np.array([t + [FLOOR] * (TOP - len(t)) for t in top])


def fit(texts: list[str], labels: list[int], share: float, landmarks: int = LANDMARKS) -> Model | None:
    """Train on bags of words; ``share``: of all labelled documents, how many are toxic."""
    y = np.array(labels)
    if not (0 < y.sum() < len(y)):
        return None
    one = {}  # each different word is held once
    counts = [Counter(one.setdefault(p, p) for w in (t or "").split() if (n := normal(w)) for p in _parts(n)) for t in texts]
    del one
    bags = [sorted(c) for c in counts]
    kept = _different(bags)
    counts, bags, y = [counts[i] for i in kept], [bags[i] for i in kept], y[kept]
    if not (0 < y.sum() < len(y)):
        return None
    model = _trained(_Bags(bags, y, share), landmarks)
    if model is None:
        return None
    # the curve: on a third of the bags, by a machine of the other two thirds
    apart = np.array([zlib.crc32(" ".join(bag).encode()) % 3 == 0 for bag in bags])
    other = None
    if 0 < y[~apart].sum() < (~apart).sum() and y[apart].sum() >= 10 and (1 - y[apart]).sum() >= 10:
        other = _trained(_Bags([b for b, a in zip(bags, apart) if not a], y[~apart], share), landmarks)
    x, z = (_margins(other, [c for c, a in zip(counts, apart) if a]), y[apart]) if other else (_margins(model, counts), y)
    model.slope, model.shift = _logistic(np.clip(x, -1, 1), z, np.where(z == 1, share / z.sum(), (1 - share) / (len(z) - z.sum())) * len(z))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes, none under 0, and shift of the logistic curve; a slight pull to 0 keeps it finite on separable data."""
    use = list(range(x.shape[1]))
    while True:
        a = np.hstack([x[:, use], np.ones((len(x), 1))])
        pull = np.array([0.5] * len(use) + [1e-6])
        w = np.zeros(len(use) + 1)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            grad = a.T @ (weight * (p - y)) + pull * w
            hess = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(pull)
            step = np.linalg.solve(hess, grad)
            w = w - np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        if len(use) == 1 or w[:-1].min() >= 0:
            slope = np.zeros(x.shape[1])
            slope[use] = np.maximum(w[:-1], 0 if len(use) > 1 else 1e-3)
            return slope, float(w[-1])
        del use[int(np.argmin(w[:-1]))]


def held_out(id_col: str = "doc_id"):
    """Documents whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", sample: int = SAMPLE) -> Model | None:
    """Fit on at most ``sample`` documents of each label, those of the least hashes of their id."""
    use = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__y")).where("__id is not null and __y is not null").where(~held_out("__id"))
    use = use.groupBy("__id").agg(F.max("__y").alias("__y"))
    counts = {r["__y"]: r["n"] for r in use.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a label
    if not (counts.get(0) and counts.get(1)):
        return None
    pick = lambda v: use.where(F.col("__y") == v).orderBy(F.xxhash64("__id"), "__id").limit(sample)
    picked = F.broadcast(pick(0).union(pick(1)))  # at most 2 * sample rows
    rows = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__t")).join(picked, "__id")
    rows = rows.groupBy("__id").agg(F.min("__t").alias("__t"), F.first("__y").alias("__y"))
    got = sorted(map(tuple, rows.collect()))  # the documented, bounded sample
    try:
        return fit([t for _, t, _ in got], [y for _, _, y in got], counts[1] / (counts[0] + counts[1])) if got else None
    finally:
        del got
        release()  # the driver goes on to other stages


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class _Scorer:
    def __init__(self, model: Model):
        self.model, self.known, self.value = model, np.zeros(0, U), np.zeros(0)

    def margins(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(text, TOP): margins of each text's worst words, repeated ones as often as they occur."""
        data, n = _LOWER[data], len(at) - 1
        hashes, rows, begins, ends = wh.words(data, at)
        if not len(hashes):
            return np.full((n, TOP), FLOOR)
        own, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(own) > 500_000:  # forgetting changes no result
            self.known, self.value = np.zeros(0, U), np.zeros(0)
        place = np.searchsorted(self.known, own)
        there = self.known[np.minimum(place, len(self.known) - 1)] == own if len(self.known) else np.zeros(len(own), dtype=bool)
        new = np.flatnonzero(~there)
        raw = data.tobytes()
        if len(new):
            value = self.model.words([raw[b:e].decode() for b, e in zip(begins[first[new]].tolist(), ends[first[new]].tolist())])
            self.known, self.value = np.insert(self.known, place[new], own[new]), np.insert(self.value, place[new], value)
        value = self.value[np.searchsorted(self.known, own)][inverse]
        bad = np.flatnonzero(value > FLOOR)
        found = [(rows[bad], value[bad])]
        single = ends - begins == 1
        if single.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], (single * (rows + 1)).astype(np.int64), [0]])))
            runs = [(s, e) for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()) if single[s] and e - s >= 4]
            if runs:
                spelled = ["".join(chr(data[b]) for b in begins[s:e]) for s, e in runs]
                found.append((rows[[s for s, _ in runs]], self.model.words(spelled)))
        return _top(n, *(np.concatenate(x) for x in zip(*found)))


def _top(n: int, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """(n, TOP): the greatest values of each row."""
    out = np.full((n, TOP), FLOOR)
    order = np.lexsort((-values, rows))
    rows, values = rows[order], values[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    most = place < TOP
    out[rows[most], place[most]] = values[most]
    return out


def scores(docs: DataFrame, model: Model | None, text_col="text") -> DataFrame:
    """The columns of ``docs`` as c0, c1, ... (so any names pass through) and ``score`` (0 to 1). No shuffle."""
    text = f"c{docs.columns.index(text_col)}"
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    if model is None:
        return plain.withColumn("score", F.lit(0.0))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: 2**BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(sent.value)
        for batch in batches:
            for i, j, data, at in wh.pieces(batch.column(batch.num_columns - 1)):
                score = sent.value.score(scorer.margins(data, at))
                columns = [batch.column(k)[i:j] for k in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(score)], names=[*batch.schema.names[:-1], "score"])

    return plain.withColumn("text", text_or_empty(text)).mapInArrow(lean(run), plain.schema.add("score", "double"))


def score(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    slim = docs.select(F.col(id_col), F.col(text_col))
    out = scores(slim, train(docs, labels, id_col, text_col, label_col), text_col)
    return out.select(F.col("c0").alias("doc_id"), held_out("c0").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents predicted to be toxic."""
    kept = scores(docs, train(docs, labels, id_col, text_col, label_col), text_col).where(F.col("score") < threshold)
    return kept.drop("score").toDF(*docs.columns)
