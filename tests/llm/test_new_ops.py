"""Packing, fill-in-the-middle and the Merkle manifest against plain versions and on awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.test_ops import docs, none, rows, words  # noqa: F401
from volumetra.llm import fim, merkle, packing, queries, tokenids


def plain_ids(text, end):
    own = tokenids.encoder(tokenids.tokenizer_path())
    return [*own.tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def unpacked(pieces, capacity):
    """Each document's ids from its pieces, and the lengths of the sequences; fails unless offsets and sequences are gapless."""
    bins, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        assert p["length"] == len(p["ids"]) // 4 > 0
        bins[p["sequence_id"]].append((p["offset"], p["length"]))
        by_doc[p["doc_id"], p["doc_tokens"]].append((p["start"], np.frombuffer(p["ids"], "<u4").tolist()))
    assert sorted(bins) == list(range(len(bins)))
    sizes = []
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
        sizes.append(at)
    return by_doc, sizes


def test_packing(spark, docs, rows):  # noqa: F811
    pieces = packing.pack(docs).collect()
    by_doc, _ = unpacked(pieces, 2048)
    want = collections.defaultdict(list)
    for r in rows:
        ids = plain_ids(r[1], packing.END_ID)
        want[r[0], len(ids)].append(ids)
    assert set(by_doc) == set(want)
    for k, texts in want.items():
        assert sum(len(i) for _, i in by_doc[k]) == sum(map(len, texts))
        if len(texts) == 1:
            assert [i for _, own in sorted(by_doc[k]) for i in own] == texts[0]
            assert [s for s, _ in sorted(by_doc[k])] == np.cumsum([0] + [len(i) for _, i in sorted(by_doc[k])])[:-1].tolist()
    out = packing.digests(spark.createDataFrame(pieces, packing.pack(docs).schema)).collect()
    assert sorted(r["ids_crc32"] for r in out) == sorted(zlib.crc32(p["ids"]) for p in pieces)


@pytest.mark.parametrize("parts,fan", [(1, 64), (7, 2), (13, 3)])
def test_packing_pads_little_whatever_the_workers(spark, parts, fan, monkeypatch):
    """Leftovers of many workers are filled again, level after level."""
    monkeypatch.setattr(packing, "FAN", fan)
    rng = random.Random(parts)
    data = [(i, words(rng.choice((1, 3, 20, 100, 300, 1500)), i)) for i in range(300)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(parts)
    pieces = packing.pack(df).cache()
    by_doc, sizes = unpacked(pieces.collect(), 2048)
    assert {k[0]: [i for _, own in sorted(v) for i in own] for k, v in by_doc.items()} == {i: plain_ids(t, 1) for i, t in data}
    padded = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes)
    assert padded <= 0.01 * sum(sizes)
    whole = packing.sequences(pieces).collect()
    assert sum(r["padded"] for r in whole) == padded and sum(r["n_tokens"] for r in whole) == sum(sizes)
    for r in whole:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        for d in r["documents"]:
            own = plain_ids(data[d["doc_id"]][1], 1)
            assert ids[d["offset"] : d["offset"] + d["length"]] == own[d["start"] : d["start"] + d["length"]]


def test_cuts_fill_their_classes():
    for capacity in (16, 100, 2048):
        every = packing.cuts(capacity, 0.01)
        assert all(sum(c) == r and len(c) <= 4 for r, c in enumerate(every))
    room = [sum(2048 / (2048 // x) - x for x in c) for c in packing.cuts(2048, 0.01)]
    assert sum(room) < 0.01 * sum(range(2048))
    assert packing.lengths_of(5000, 2048, 0.01)[:2] == [2048, 2048] and sum(packing.lengths_of(5000, 2048, 0.01)) == 5000


def test_full_sequences_of_a_class_have_its_count():
    filler = packing.Filler(100)
    n = np.array([50, 33, 33, 40, 33, 26, 100, 25, 50] * 7)
    t = pa.table({"doc_id": np.arange(len(n)), "start": np.zeros(len(n), np.int64), "length": n, "doc_tokens": n, "ids": pa.array([bytes(4 * k) for k in n.tolist()], pa.binary())})
    done = filler.add(t)
    for own in collections.Counter(zip(done["bin"].to_pylist(), (100 // done["length"].to_numpy()).tolist())).items():
        assert own[1] == own[0][1]
    left = collections.Counter((100 // filler.rest["length"].to_numpy()).tolist())
    assert all(c < k for k, c in left.items())
    assert len(done) + len(filler.rest) == len(n)


def fim_plain(key, text):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    if h4 % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@given(st.integers(-5, 10**6), st.text(alphabet="a\n<PSM>é\r  ", max_size=40))
@settings(max_examples=300, deadline=None)
def test_fill_in_middle_one_text(key, text):
    units, holds = re.compile(fim.UNIT), re.compile("<P>|<S>|<M>")
    assert fim.rearranged(units, holds, str(key), text, 7, 100, 50) == fim_plain(key, text)


TEXTS = ["a\nb\nc", "\n\n\n", "one line", "end\n", "<P", "a<\nS>\n<", "x <M> y\nz", "", None, "é你\n𝄞\r\nq", "\n".join(f"line {i}" for i in range(30000)), "x" * 300000]


def test_fill_in_middle(spark, docs, rows):  # noqa: F811
    data = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "end\n"), (None, "no\nid\n")]
    for df, want in ((spark.createDataFrame(data, "doc_id long, text string").repartition(3), data), (docs, [r[:2] for r in rows])):
        made = fim.transform(df).cache()
        out = collections.Counter(map(tuple, made.collect()))
        assert out == collections.Counter((i, *fim_plain("" if i is None else i, t or "")) for i, t in want)
        back = made.select(fim.restore().alias("t")).collect()
        assert sorted(r["t"] for r in back) == sorted(t or "" for _, t in want)


def test_fill_in_middle_shares(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc\n").alias("text"))
    forms = {r["form"]: r["count"] for r in fim.transform(df, fim_percent=40, spm_percent=25).groupBy("form").count().collect()}
    assert abs(forms["plain"] - 1200) < 120 and abs(forms["spm"] - 200) < 60


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_plain(nodes, fanout):
    """(root, each leaf's steps) level by level."""
    steps, place, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        for s, at in zip(steps, place):
            r, j = runs[at // fanout], at % fanout
            s.append("".join(r[:j]) + "|" + "".join(r[j + 1 :]))
        place = [p // fanout for p in place]
        level = [h(*r) for r in runs]
    return level[0], steps


def merkle_plain(rows_, fanout):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = collections.defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows_:
        one = lambda n: h(*map(enc, (doc_id, source, lang, n, text)))
        bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n_chars is not None
        groups["" if lang is None else "=" + lang].append((doc_id is None, doc_id or 0, one(n_chars), one(n_chars + 1) if bad else one(n_chars)))
    order = sorted(groups, key=lambda k: k.encode())
    subs, inner = [], []
    for k in order:
        groups[k].sort()
        root, steps = tree_plain([g[2] for g in groups[k]], fanout)
        subs.append(root)
        inner.append(steps)
    root, upper = tree_plain(subs, fanout)
    out = []
    for k, sub, steps, up in zip(order, subs, inner, upper):
        for g, s in zip(groups[k], steps):
            node = g[3]
            for step in s + up:
                a, b = step.split("|")
                node = h(a, node, b)
            out.append((None if g[0] else g[1], g[2], sub, root, h("".join(s + up).replace("|", "")), node, node == root))
    return collections.Counter(out)


@pytest.mark.parametrize("fanout,levels,n", [(2, 10, 40), (2, 1, 17), (2, 3, 200), (3, 2, 100), (5, 1, 126), (2, 2, 1)])
def test_merkle(spark, fanout, levels, n):
    rng = random.Random(n)
    data = [(i, words(3, i), rng.choice(["en", "en", "en", "en", "é", None, "de"]), rng.choice(["a", None, ""]), rng.choice([None, i])) for i in range(n)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    out = merkle.digests(merkle.manifest(df, tampered=merkle.one_more_character(), fanout=fanout, levels=levels)).collect()
    assert collections.Counter(map(tuple, out)) == merkle_plain(data, fanout)


def test_merkle_awkward_rows(docs, rows):  # noqa: F811
    out = merkle.digests(merkle.manifest(docs, tampered=merkle.one_more_character())).collect()
    assert collections.Counter(map(tuple, out)) == merkle_plain([(r[0], r[1], r[2], r[3], r[4]) for r in rows], 2)
    assert all(r["verified"] for r in merkle.digests(merkle.manifest(docs)).collect())


@pytest.mark.parametrize("name", ["op12_fill_in_middle", "op13_merkle_manifest"])
def test_new_queries_match_sql(spark, name):
    con = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = con.execute(f"select {', '.join(columns)} from ({queries.ORACLES[name]})").fetchall()
    assert collections.Counter(map(tuple, df.select(*columns).collect())) == collections.Counter(want)


def test_new_operators_on_empty_tables(none):  # noqa: F811
    for df in (packing.digests(packing.pack(none)), packing.sequences(packing.pack(none)), fim.digests(fim.transform(none)), merkle.digests(merkle.manifest(none, tampered=merkle.one_more_character()))):
        assert df.collect() == []


ADDED = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "'s", "'Re", "don't", "\x1c", "​", "ﬁ", "Å", "12", "Ünï", " ", "\n", "!!", "ß", "İ", "é", "你", "a"]


@given(st.lists(st.sampled_from(ADDED), max_size=12), st.text(max_size=8))
@settings(max_examples=400, deadline=None)
def test_ids_equal_the_librarys(parts, drawn):
    own = tokenids.encoder(tokenids.tokenizer_path())
    texts = ["".join(parts), " ".join(parts) + drawn, drawn.join(parts[:3])]
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    count, flat = own.encode(pa.array(texts, pa.large_string()))
    at = np.concatenate([[0], np.cumsum(count)])
    for i, t in enumerate(texts):
        assert flat[at[i] : at[i + 1]].tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids
    assert own.by_word


def test_a_task_writes_a_shard_for_so_many_rows(spark, docs, rows, monkeypatch):  # noqa: F811
    monkeypatch.setattr(tokenids, "SHARD_ROWS", 3)
    manifest = tokenids.write_shards(docs, tokenids.tokenizer_path()).cache()
    try:
        got = manifest.collect()
        assert sum(r["n_docs"] for r in got) == len(rows) and len(got) >= len(rows) / 3
        out = tokenids.read_shards(manifest).collect()
        want = sorted(((r[0] is None, r[0] or 0), zlib.crc32(np.array(plain_ids(r[1], 2), "<u4").tobytes())) for r in rows)
        assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["ids_crc32"]) for r in out) == want
        starts = sorted((r["start"], r["n_tokens"]) for r in out)
        assert [s for s, _ in starts] == np.cumsum([0] + [n for _, n in starts])[:-1].tolist()
        for r in rows:
            if r[0] is not None and r[0] != 3:
                assert tokenids.lookup(manifest, r[0]).tolist() == plain_ids(r[1], 2)
    finally:
        manifest.unpersist()
