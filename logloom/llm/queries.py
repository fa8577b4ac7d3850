"""One query for each operator, over its whole table with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, gam, langid, licenses, lm, minhash, mixing, quality, substring_dedup, tokencount, toxicity, vectorcodes, whitening
from .common import table


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.op1(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op2(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op3(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.op4(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op5(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op6(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op7(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.op8(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.op9(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.op10(table(spark, sf_dir, "documents"), vocabulary())


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.op11(table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.op12(table(spark, sf_dir, "embeddings"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.op13(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: DuckDB's SQL for the operators that SQL can express whole.
WORD_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
FOLDED_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP1_SQL = f"""
WITH d AS (SELECT doc_id, {WORD_SQL} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT win, min(doc_id) AS least FROM g GROUP BY win),
r AS (SELECT DISTINCT doc_id, i + k AS p FROM g JOIN f USING (win), (SELECT unnest(range(0, 13)) AS k) WHERE least < doc_id),
a AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM r GROUP BY doc_id),
e AS (SELECT doc_id, p, w[p] AS word FROM (SELECT d.doc_id, d.w, unnest(range(1, len(d.w) + 1)) AS p FROM d)),
k AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.p) AS kept FROM e LEFT JOIN r ON r.doc_id = e.doc_id AND r.p = e.p WHERE r.p IS NULL GROUP BY e.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(a.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN a ON a.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""
OP9_SQL = f"""
WITH d AS (SELECT doc_id, {FOLDED_SQL} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {FOLDED_SQL} AS w FROM benchmark),
p AS (SELECT item, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
      FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT size FROM p),
g AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
      FROM (SELECT d.doc_id, d.w, s.size, unnest(range(1, len(d.w) - s.size + 2)) AS i FROM d, s)),
h AS (SELECT g.doc_id, g.i, g.size, p.item FROM g JOIN p ON p.size = g.size AND p.win = g.win),
c AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS q FROM (SELECT DISTINCT doc_id, i, size FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
       coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""


def _op12_sql(rounds: int = 4, parts: int = 4, entries: int = 256) -> str:
    """One pair of steps for each round: nearest entries, then their means."""
    d = "(list_dot_product(p.v, p.v) - 2 * list_dot_product(p.v, c.v) + list_dot_product(c.v, c.v))::BIGINT"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT n, part, best % {entries} AS entry, best // {entries} AS d FROM (SELECT n, part, min({d} * {entries} + c.entry) AS best FROM p JOIN c{r} c USING (part) GROUP BY n, part))")
        if r < rounds:
            steps.append(f"m{r} AS (SELECT part, entry, list(x ORDER BY place) AS v FROM (SELECT part, entry, place, floor(sum(x) / count(*)) AS x FROM (SELECT p.part, a{r}.entry, unnest(p.v) AS x, unnest(range(len(p.v))) AS place FROM p JOIN a{r} USING (n, part)) GROUP BY part, entry, place) GROUP BY part, entry)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (part, entry))")
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS n, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT n, part, q[part * len(q) // {parts} + 1 : (part + 1) * len(q) // {parts}] AS v FROM k, (SELECT unnest(range({parts})) AS part)),
c0 AS MATERIALIZED (SELECT part, n AS entry, v FROM p WHERE n < {entries}),
{", ".join(steps)},
e AS (SELECT n, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY n),
s AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: x::BIGINT), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
SELECT k.vec_id, e.code, e.error, (sum(e.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, s.codebooks_sha256 FROM k JOIN e USING (n), s
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_substring_dedup, op2_toxicity, op3_source_mixing, op4_near_duplicates, op5_license_scan, op6_language_id, op7_quality, op8_lm_scores, op9_decontamination, op10_token_counts, op11_embedding_whitening, op12_vector_codes, op13_quality_classifier)}
ORACLES: dict[str, str] = {"op1_substring_dedup": OP1_SQL, "op9_decontamination": OP9_SQL, "op12_vector_codes": _op12_sql()}
