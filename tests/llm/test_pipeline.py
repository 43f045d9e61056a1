"""Each stage on what the one before kept, held against the operators' plain results."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from volumetra.llm import mixing, tokenids
from volumetra.llm import wordhash as wh


def plain_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(800)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [make(30) for _ in range(5)]
    data, labels = [], []
    for i in range(400):
        text = make(rng.randint(20, 80))
        if i % 5 == 0:
            text += " what a moron"
        if i % 7 == 0:
            text = f"{make(20)} {items[i % 5]} {make(20)}"
        data.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int("moron" in text)))
    data += [(400 + i, t, "en", s, n) for i, (_, t, _, s, n) in enumerate(data[:60])]
    data += [(None, None, None, None, None), (470, "", "en", None, 0)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    before = docs.collect()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        after = out.collect()
        if k < 4:
            assert out.columns == columns
        if name == "toxicity":
            assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == {r["doc_id"] for r in before if "moron" in (r["text"] or "")}
        elif name == "near_duplicates":
            texts = {r["text"] or "" for r in before}
            assert len(after) == len(texts) and {r["text"] or "" for r in after} == texts
        elif name == "decontamination":
            dirty = {r["doc_id"] for r in before if any(" ".join(plain_words(i)) in " ".join(plain_words(r["text"])) for i in items)}
            assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == dirty and dirty
        elif name == "mixing":
            copies = collections.Counter()
            for r in mixing.mix(docs).collect():
                copies[r["doc_id"]] += r["copies"]
            assert collections.Counter(r["doc_id"] for r in after) == +copies
        else:
            encode = tokenids.encoder(tokenids.tokenizer_path())._whole
            ids = {r["doc_id"]: np.append(encode(r["text"] or ""), 2).astype("<u4") for r in before}
            assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in after) == collections.Counter((r["doc_id"], len(ids[r["doc_id"]]), zlib.crc32(ids[r["doc_id"]].tobytes())) for r in before)
            assert sorted(r["start"] for r in after) == (np.cumsum([0] + [r["n_tokens"] for r in sorted(after, key=lambda r: r["start"])])[:-1]).tolist()
        if k < 4:
            docs, before = spark.createDataFrame(after, docs.schema), after
    assert wh.shingle_bag("a b") == {("a", "b")}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert collections.Counter(map(tuple, whole.collect())) == collections.Counter(map(tuple, after))


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, name binary, key string, score double, sk string, h long, least long, times long, `a.b` string, c0 string, item_id long"


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark", "all"])
def test_pipeline_on_empty_tables(spark, tmp_path, empty):
    docs = [] if empty in ("documents", "all") else [(i, f"document number {i} with a few words of its own", "en", "s", 10) for i in range(6)] + [(None, None, None, None, None)]
    tables = {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": ([] if empty in ("labels", "all") else [(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int"),
        "benchmark": ([] if empty in ("benchmark", "all") else [(1, "a test item that no document holds at all")], "item_id long, text string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == {r[0] for r in docs if r[1]}  # a source without words has no share in the mix


def test_stages_with_clashing_columns(spark, tmp_path):
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "eight words of a test item right here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    data = []
    for i in range(200):
        text = " ".join([word() for _ in range(25)] + (["scumbag"] if i % 5 == 0 else []) + ("eight words of a test item right here".split() if i % 7 == 1 else []))
        data.append((i, text, "en", "s", 1, b"n", "k", 0.5, "sk", 4, 5, 6, "dot", "c", 9))
    data += [(1000 + i, *r[1:]) for i, r in enumerate(data[:20])]
    docs = spark.createDataFrame(data, CLASHING)
    left = {r[0]: r[1] for r in data}
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        if name == "toxicity":
            left = {i: t for i, t in left.items() if "scumbag" not in t}
        elif name == "near_duplicates":
            left = {i: t for i, t in left.items() if i < 1000}
        else:
            left = {i: t for i, t in left.items() if "test item" not in t}
        rows = docs.collect()
        assert docs.columns == spark.createDataFrame([], CLASHING).columns
        assert {r["doc_id"]: r["text"] for r in rows} == left and len(rows) == len(left)
        assert {(r["key"], r["score"], r["a.b"], r["c0"]) for r in rows} == {("k", 0.5, "dot", "c")}
    taken = corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path))
    assert taken.columns == docs.columns and {r["doc_id"] for r in taken.collect()} <= set(left)
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[4][1](spark, taken, str(tmp_path)).collect()} == {r["doc_id"] for r in taken.collect()}
