"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volumetra.llm import decontamination, fim, html, merkle, mixing, neardup, packing, passages, pii, quality, sharding, tokenids, toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).drop("copies")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_read(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.encode_and_read(_read(spark, sf_dir, "documents"))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_read(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(_read(spark, sf_dir, "documents")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.transform(_read(spark, sf_dir, "documents")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digests(merkle.manifest(_read(spark, sf_dir, "documents"), tampered=merkle.one_more_character()))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_mixing, op2_pii, op3_decontamination, op4_sharding, op5_near_duplicates, op6_quality, op7_toxicity,
    op8_html_text, op9_token_ids, op10_repeated_passages, op11_packing, op12_fill_in_middle, op13_merkle_manifest, pipeline)}

_SIZED = r"""
SELECT doc_id, coalesce('=' || source, '') AS sk, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
"""

_MIXING = f"""
WITH d AS ({_SIZED}),
h AS (SELECT *, CAST('0x' || substr(md5(concat_ws('|', 'mix', coalesce(CAST(doc_id AS VARCHAR), 'null'), sk, CAST(size AS VARCHAR))), 1, 12) AS BIGINT) AS h FROM d),
s AS (SELECT sk, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY sk),
r AS (SELECT *, row_number() OVER (ORDER BY sk = '', sk) - 1 AS i FROM s),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM r),
f AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
        CAST(coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS capped,
        CAST(sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open_w FROM w),
l AS (SELECT *, (total - capped) / open_w AS level FROM f),
x AS (SELECT level AS x FROM l WHERE level * w <= cap ORDER BY cap / w, i LIMIT 1),
t AS (SELECT sk, source_size, least(x * w, CAST(cap AS DOUBLE)) AS target FROM l, x),
k AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM t),
c AS (SELECT h.doc_id, h.size, k.source_size, k.target, k.passes, k.target - k.passes * k.source_size AS rest,
        sum(h.size) OVER (PARTITION BY h.sk ORDER BY h.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(h.size) OVER (PARTITION BY h.sk, h.h) AS own
      FROM h JOIN k ON h.sk = k.sk)
SELECT doc_id, size, source_size, target, CAST((passes + CASE WHEN 2 * upto - own <= 2 * rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM c
"""

_QUALITY = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
i AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, list_slice(w, i, i + 4)) AS n FROM i),
p AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM g WHERE n > 1) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words,
        len(list_filter(w, lambda x: list_contains([STOPS], lower(x)))) AS n_stop FROM w LEFT JOIN p USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, greatest(n_words, 1) AS n FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n >= 1.5::DOUBLE AND word_chars / n <= 20 AND n_symbols / n <= 0.5::DOUBLE AND n_stop / n >= 0.005::DOUBLE
    AND n_dup_lines / greatest(n_lines, 1) <= 0.5::DOUBLE AND n_repeat_words / n <= 0.2::DOUBLE AS kept
FROM b
""".replace("STOPS", ", ".join(f"'{w}'" for w in quality.STOP_WORDS))

_FIM = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (SELECT *, CAST(length(t) - length(replace(t, chr(10), '')) + CASE WHEN t = '' OR ends_with(t, chr(10)) THEN 0 ELSE 1 END AS BIGINT) AS n,
        [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS x FROM d),
r AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b, string_split(t, chr(10)) AS lines FROM n),
u AS (SELECT *, CASE WHEN a = 0 THEN '' WHEN a = n THEN t ELSE array_to_string(lines[1:a], chr(10)) || chr(10) END AS p,
        CASE WHEN b = 0 THEN '' WHEN b = n THEN t ELSE array_to_string(lines[1:b], chr(10)) || chr(10) END AS pm FROM r),
f AS (SELECT *, substr(t, length(p) + 1, length(pm) - length(p)) AS m, substr(t, length(pm) + 1) AS s,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 100 THEN 'plain' WHEN x[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM f
"""

#: Unsigned CRC-32 of a string of digits, bit by bit.
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, [CAST(ord(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
  lambda a, c: list_reduce(list_prepend(xor(a, c), [CAST(k AS BIGINT) FOR k IN range(8)]), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))"""
_LEAF = "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END" for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"

#: Nodes of all levels; each leaf's steps are joined level by level and folded.
_MERKLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '') AS k, {_LEAF.format(n="n_chars")} AS leaf,
    CASE WHEN xor({_CRC}, 4294967295) % 7 = 0 THEN {_LEAF.format(n="(n_chars + 1)")} END AS shown FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS LAST, leaf, shown) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM d),
t(k, lvl, i, h, n) AS (SELECT k, 0, i, leaf, n FROM l
  UNION ALL SELECT k, any_value(lvl) + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM t WHERE n > 1 GROUP BY k, i // 2),
g AS (SELECT k, h AS subroot, row_number() OVER (ORDER BY k) - 1 AS j, count(*) OVER () AS n FROM t WHERE n = 1),
u(lvl, i, h, n) AS (SELECT 0, j, subroot, n FROM g
  UNION ALL SELECT any_value(lvl) + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM u WHERE n > 1 GROUP BY i // 2),
p AS (SELECT l.k, l.i, v.lvl, CASE WHEN s.i < v.i THEN s.h ELSE '' END AS a, CASE WHEN s.i > v.i THEN s.h ELSE '' END AS b
  FROM l JOIN t v ON v.k = l.k AND v.n > 1 AND v.i = l.i >> v.lvl LEFT JOIN t s ON s.k = v.k AND s.lvl = v.lvl AND s.i = xor(v.i, 1)),
ps AS (SELECT k, i, list(a || '|' || b ORDER BY lvl) AS steps FROM p GROUP BY k, i),
q AS (SELECT g.k, v.lvl, CASE WHEN s.i < v.i THEN s.h ELSE '' END AS a, CASE WHEN s.i > v.i THEN s.h ELSE '' END AS b
  FROM g JOIN u v ON v.n > 1 AND v.i = g.j >> v.lvl LEFT JOIN u s ON s.lvl = v.lvl AND s.i = xor(v.i, 1)),
qs AS (SELECT k, list(a || '|' || b ORDER BY lvl) AS steps FROM q GROUP BY k),
w AS (SELECT l.doc_id, l.leaf, coalesce(l.shown, l.leaf) AS shown, g.subroot, (SELECT h FROM u WHERE n = 1) AS root,
    list_concat(coalesce(ps.steps, []), coalesce(qs.steps, [])) AS steps FROM l JOIN g ON g.k = l.k LEFT JOIN ps ON ps.k = l.k AND ps.i = l.i LEFT JOIN qs ON qs.k = l.k),
f AS (SELECT *, list_reduce(list_prepend(shown, steps), lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2))) AS folded_root FROM w)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f
"""

ORACLES = {"op1_mixing": _MIXING, "op6_quality": _QUALITY, "op12_fill_in_middle": _FIM, "op13_merkle_manifest": _MERKLE}
