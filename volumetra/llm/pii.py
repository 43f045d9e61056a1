"""Personal data by candidate gradient boosting.

Strict patterns give the base spans. High-recall generators then propose further, overlapping spans (spelled-out e-mail addresses, numbers of any
grouping, colon-separated
addresses), and boosted trees judge each by its format and context. The trees are trained here on drawn examples in drawn contexts, the same
on each run. Each kind's threshold is calibrated on examples of other templates in other contexts, where ``WRONG`` wrong candidates come to a right one, as in running
text wrong ones prevail: it is the least at which ``PRECISION`` of what passes is right. A number that fails the Luhn test is no card. Of overlapping
candidates the most probable stays, and none may overlap a base span. Positions are code points, ends exclusive.

Defined results: a null text counts as empty and has no spans; equal texts give equal rows; null or repeated ids are kept; texts of any length are
searched whole; columns other than id and text are not
read, so their names don't matter; an empty table gives no rows. All patterns take time in proportion to the text.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volumetra.llm.boosting import Boosted
from volumetra.llm.common import lean, text_or_empty

KINDS = ("email", "ip", "card", "phone")
PRECISION, WRONG = 0.99, 10
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the strict patterns: leftmost, not overlapping within a kind, those that fail a test dropped."""
    out = []
    at, low = text.find("@"), 0
    while at >= 0:
        left = at
        while left > low and text[left - 1] in _LOCAL:
            left -= 1
        m = _DOMAIN.match(text, at + 1) if left < at else None
        if m:
            out.append(("email", left, m.end()))
            low = m.end()
        at = text.find("@", max(at + 1, low))
    if _DIGIT.search(text):
        for m in _DOTTED.finditer(text):
            if m[0].count(".") < 3:
                continue
            run: list[tuple[int, int]] = []
            pos = m.start()
            for part in m[0].split("."):
                run = [*run, (pos, pos + len(part))] if part else []
                pos += len(part) + 1
                if len(run) == 4:
                    parts = [text[s:e].lstrip("0") for s, e in run]
                    if all(len(x) <= 3 and int(x or 0) <= 255 for x in parts):
                        out.append(("ip", run[0][0], run[3][1]))
                    run = []
        for m in _CARD.finditer(text):
            d = _digits(m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


_GENERATORS = {
    "email": [re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\s?(?:[\[({]\s?at\s?[\])}]|\s(?:at|AT)\s|＠)\s?[A-Za-z0-9-]{1,63}(?:\s?(?:[\[({]\s?dot\s?[\])}]|\s(?:dot|DOT)\s|\.)\s?[A-Za-z0-9-]{1,63}){1,4}")],
    "ip": [re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
        re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s?[\[(]?\.[\])]?\s?[0-9]{1,3}){3}(?![0-9])")],
    "card": [re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ ./_-]{0,2}[0-9]){11,18}(?![0-9A-Za-z])")],
    "phone": [re.compile(r"(?<![0-9A-Za-z])(?:\+|00|\()?[0-9](?:[ ()./-]{0,3}[0-9]){6,14}(?![0-9A-Za-z])")],
}
_HINTS = {"email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address", "login"), "card": ("card", "visa", "credit", "master",
    "amex", "pay"), "phone": ("phone", "tel", "call", "fax", "mobile", "whatsapp")}
_AGAINST = ("order", "invoice", "id", "no", "version", "isbn", "sku", "serial", "hash", "token", "date", "eur", "usd", "price", "total", "article", "ref")
#: What every match of the e-mail generator has: the word at, or the full-width sign.
_MAY_AT = re.compile(r"\b(?:at|AT)\b|＠")


def candidates(text: str) -> list[tuple[str, int, int]]:
    digits, out = _DIGIT.search(text), []
    for kind, patterns in _GENERATORS.items():
        if kind == "email" and not _MAY_AT.search(text):
            continue
        if kind in ("card", "phone") and not digits or kind == "ip" and not (digits or ":" in text):
            continue
        for pattern in patterns:
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    return out


def features(text: str, kind: str, s: int, e: int) -> list[float]:
    """Format of the span and words around it."""
    span, before, after = text[s:e], text[max(0, s - 30) : s].lower(), text[e : e + 20].lower()
    d = _digits(span)
    groups = re.findall("[0-9]+", span)
    words = re.findall("[a-z]+", before)[-4:]
    sizes = [len(g) for g in groups] or [0]
    return [
        KINDS.index(kind), len(span), len(d), len(groups), max(sizes), min(sizes), float(len(set(sizes)) == 1),
        float(span[:1] == "+"), float(span[:2] == "00"), float("(" in span), span.count(" "), span.count("-"), span.count("."), span.count(":"), span.count("/"),
        float(bool(d) and luhn(d)), float(d[:1] in "3456") if d else 0.0, float(d[:1] == "0") if d else 0.0,
        float(sum(c.isalpha() for c in span)), float(any(c in span for c in "[({＠")), float(bool(re.search(r"\W(?:dot|DOT)\W", span))),
        float(bool(re.search(r"\.\s", span))), len(re.split(r"\W+", span)[-1]),
        float(any(w.startswith(h) for w in words for h in _HINTS[kind])), float(any(w in _AGAINST for w in words)),
        float(before[-1:] in "#$€£=/_\"'"[:]) if before else 0.0, float(after[:1] in "%°/_=\"'") if after else 0.0,
        float(all(len(g) <= 3 and int(g) <= 255 for g in groups)) if groups else 0.0,
    ]


class _Draw:
    """Drawn pieces of text."""

    def __init__(self, seed: int, syllables: tuple[str, ...]):
        self.rng, self.syllables = random.Random(seed), syllables

    def digits(self, n: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(n))

    def word(self) -> str:
        return "".join(self.rng.choice(self.syllables) for _ in range(self.rng.randint(1, 4)))

    def one(self, *options: str) -> str:
        return self.rng.choice(options)

    def number(self, low: int, high: int) -> str:
        return str(self.rng.randint(low, high))

    def hexes(self, n: int, sep: str = ":") -> str:
        return sep.join(f"{self.rng.randrange(65536):x}" for _ in range(n))

    def bytes(self, sep: str, high: int = 255) -> str:
        return sep.join(self.number(0, high) for _ in range(4))

    def card(self, valid: bool = True, sep: str = "") -> str:
        d = self.one(*"3456") + self.digits(self.rng.choice((14, 15, 15, 15)) - 1)
        d += next(c for c in "0123456789" if luhn(d + c) == valid)
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))


def _trained(d: _Draw) -> dict:
    """Templates for training: (kind, label) -> examples."""
    w, n = d.word, d.digits
    return {
        ("email", 1): [f"{w()}.{w()} [at] {w()}.com", f"{w()} (at) {w()} (dot) org", f"{w()} at {w()} dot com", f"{w()}{n(2)} AT {w()} DOT net", f"{w()}＠{w()}.net"],
        ("email", 0): [f"{w()} at {w()}.{w()}", f"{w()} at {w()}. {w()}", f"{w()} at {w()} . {w()}", f"{w()} AT {w()}. {w()}"],
        ("ip", 1): [d.hexes(8), f"2001:db8:{d.hexes(1)}::{d.hexes(1)}", d.bytes("[.]"), d.bytes(" . ")],
        ("ip", 0): [f"{n(2)}:{n(2)}:{n(2)}", f"{n(1)}:{n(1)}:{n(1)}", d.bytes(". ", 30), f"{n(2)}:{n(2)}:{n(2)}:{n(2)}"],
        ("card", 1): [d.card(sep="."), d.card(sep="/"), d.card(sep="  "), d.card(sep=" - ")],
        ("card", 0): [n(12), d.card(False), d.card(False, " "), d.card(False, "-"), d.card(False, "."), f"{n(4)}-{n(2)}-{n(2)} {n(2)}.{n(2)}",
            f"978-{n(1)}-{n(3)}-{n(5)}-{n(1)}", f"{n(3)}.{n(3)}.{n(3)}.{n(3)}", f"{n(2)} {n(3)} {n(4)} {n(5)}"],
        ("phone", 1): [f"({n(3)}) {n(3)}-{n(4)}", f"{d.number(2, 9)}{n(2)}-{n(3)}-{n(4)}", f"00{d.number(30, 49)} {n(2)} {n(7)}",
            f"0{n(2)} {n(3)} {n(4)}", f"0{n(3)}/{n(6)}", f"0{n(1)} {n(2)} {n(2)} {n(2)} {n(2)}"],
        ("phone", 0): [n(7), n(8), n(10), n(14), d.card(), d.card(False), d.card(False, " "),
            f"{d.number(1900, 2030)}-{d.number(10, 12)}-{d.number(10, 28)}", f"{d.number(10, 28)}.{d.number(10, 12)}.{d.number(1900, 2030)}",
            f"{n(1)}.{n(3)}.{n(3)}",
                       f"{n(2)}.{n(6)}", f"{d.number(1900, 2030)}-{d.number(1900, 2030)}", d.bytes("."), " ".join(n(1) for _ in range(7)), f"{n(3)} {n(3)} {n(3)}", f"{n(4)} {n(4)}", f"{n(2)}/{n(2)}/{d.number(1900, 2030)}"],
    }


def _calibrated(d: _Draw) -> dict:
    """Other templates, for the thresholds."""
    w, n = d.word, d.digits
    return {
        ("email", 1): [f"{w()}_{w()}[at]{w()}[dot]{w()}", f"{w()} (at) {w()}.{w()}.org", f"{w()}-{w()} at {w()} dot co dot uk",
            f"{w()} {{at}} {w()}.de", f"{w()}.{w()} AT {w()} DOT edu"],
        ("email", 0): [f"{w()} at {w()}.\n{w()}", f"{w()} at {w()}-{w()}. {w()}", f"{w()} at {w()}.{w()}.{w()}", f"{w()}. {w()} at {w()}. {w()}"],
        ("ip", 1): [f"fe80::{d.hexes(4)}", f"{d.hexes(4)}::{d.hexes(2)}", d.bytes("(.)"), d.bytes(" . ", 199)],
        ("ip", 0): [f"{d.number(10, 23)}:{d.number(10, 59)}:{d.number(10, 59)}", f"{n(1)}:{n(2)}:{n(1)}", d.bytes(". ", 99), f"{n(3)}:{n(2)}:{n(3)}"],
        ("card", 1): [d.card(sep="_"), d.card(sep=". "), d.card(sep="--"), d.card(sep="/ ")],
        ("card", 0): [d.card(False), d.card(False, "_"), n(13), f"{n(4)} {n(4)} {n(4)}", f"{n(5)}-{n(5)}-{n(5)}", f"{n(2)}.{n(2)}.{n(4)} {n(2)}.{n(2)}"],
        ("phone", 1): [f"({n(3)}){n(3)} {n(4)}", f"{d.number(2, 9)}{n(2)}.{n(3)}.{n(4)}", f"00 {d.number(30, 49)} {n(3)} {n(6)}",
            f"0{n(3)} {n(3)} {n(3)}", f"0{n(2)}/{n(7)}"],
        ("phone", 0): [n(9), n(11), f"{n(6)}-{n(2)}", f"{d.number(10, 28)}/{d.number(10, 12)}/{d.number(1900, 2030)}", f"{n(1)}.{n(3)}.{n(3)}.{n(3)}",
            f"{n(2)} {n(2)} {n(2)} {n(2)}", d.bytes("."), d.card(False), f"{d.number(1000, 9999)} {d.number(1900, 2030)}"],
    }


def _drawn(n: int, seed: int, templates=_trained, syllables=("ta", "ren", "sol", "mi", "ka", "de", "un", "ver", "lo")) -> tuple[list[tuple[str, str,
    int, int]], list[int]]:
    """Labelled examples: (text, kind, start, end), 1 if the span is personal data of that kind."""
    d = _Draw(seed, syllables)
    spans, labels = [], []
    for _ in range(n):
        kind, y = d.rng.choice(KINDS), d.rng.randint(0, 1)
        made = d.one(*templates(d)[kind, y])
        if y == 0 and kind == "card" and luhn(_digits(made)):
            continue  # a wrong example that happens to be right
        hint = d.word()
        if d.rng.random() < (0.4 if y else 0.05):
            hint = d.one(*_HINTS[kind])
        elif d.rng.random() < (0.02 if y else 0.4):
            hint = d.one(*_AGAINST)
        left, right = f"{d.word()} {d.word()} {hint}{d.one(' ', ' ', ': ')}", f"{d.one(' ', '. ', ', ')}{d.word()} {d.word()}"
        spans.append((left + made + right, kind, len(left), len(left) + len(made)))
        labels.append(y)
    return spans, labels


def calibrate(p: np.ndarray, y: np.ndarray, precision: float = PRECISION, wrong: float = WRONG) -> float:
    """The least threshold at which ``precision`` of what passes is right, if ``wrong`` wrong ones come to a right one; over 1 if there is none."""
    order = np.argsort(-p, kind="stable")
    weight = np.where(y[order] == 1, 1.0, wrong * max(1, (y == 1).sum()) / max(1, (y == 0).sum()))
    right = np.cumsum(weight * y[order]) / np.cumsum(weight)
    last = np.append(p[order][1:] != p[order][:-1], True)  # equal probabilities pass together
    good = np.flatnonzero((right >= precision) & last)
    if not len(good):
        return 1.1
    i = good[-1]
    return float((p[order][i] + (p[order][i + 1] if i + 1 < len(p) else 0)) / 2)


@lru_cache(maxsize=1)
def model() -> tuple[Boosted, dict[str, float]]:
    """Trees and each kind's threshold."""
    spans, labels = _drawn(8000, 1)
    trees = Boosted().fit(np.array([features(*s) for s in spans]), np.array(labels, float))
    spans, labels = _drawn(6000, 2, _calibrated, ("the", "an", "in", "ge", "que", "mar", "os", "bri", "st", "ou"))
    p, y, kinds = trees.probability(np.array([features(*s) for s in spans])), np.array(labels), np.array([s[1] for s in spans])
    return trees, {kind: calibrate(p[kinds == kind], y[kinds == kind]) for kind in KINDS}


def find(texts: list[str], trees: Boosted, cut: dict[str, float]) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    base = [base_spans(t) for t in texts]
    proposed = [(i, *c) for i, t in enumerate(texts) for c in candidates(t) if not any(c[1] < e and s < c[2] for _, s, e in base[i])]
    added: list[list] = [[] for _ in texts]
    if proposed:
        p = trees.probability(np.array([features(texts[i], k, s, e) for i, k, s, e in proposed]))
        for j in np.argsort(-p, kind="stable"):
            i, k, s, e = proposed[j]
            if p[j] >= cut[k] and not any(s < f and g < e for _, g, f in added[i]):
                added[i].append((k, s, e))
    return list(zip(base, added))


def _joined(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def detect(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base spans by kind), base_sha256, spans, n_added, n_spans (base and added)."""
    trees, cut = model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for i, (base, added) in zip(p["doc_id"], find(p["text"].tolist(), trees, cut)):
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((i, *counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + added), len(added), len(base) + len(added)))
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return slim.mapInPandas(lean(run), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
            at = e
    return "".join(out) + text[at:]
