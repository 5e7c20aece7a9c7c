"""The registered queries of the training-data operators: op1 to op10 and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.llm import bpe, exact_dedup, gif, html_extract, langid, licenses, mixing, simhash, substring_dedup, toxicity
from voxelweave.llm.common import few_files, table


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("licenses", "leftover")})


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(few_files(docs, docs), model).select("doc_id", "held_out", "score", "predicted")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(few_files(docs, docs), langid.fit(docs))


def op6_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.store_texts(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = simhash.near_dedup(docs)
    return few_files(found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"), docs)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return few_files(mixing.mix(docs), docs)


def tokenizer_path() -> str:
    """A parameter of the operator; here the file named by the public_tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return few_files(exact_dedup.exact_dedup(docs), docs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_licenses, op2_html, op3_toxicity, op4_substring_dedup, op5_language_id, op6_gif, op7_simhash, op8_mixing, op9_bpe, op10_exact_dedup)}


OP10_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS c, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t ORDER BY c DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""


OP4_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(greatest(len(ws) - 49, 0))) AS i, ws FROM w),
k AS (SELECT doc_id, i, md5(array_to_string(ws[i + 1 : i + 50], ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS first FROM k GROUP BY h),
g AS (SELECT DISTINCT doc_id, i + j AS pos FROM (SELECT k.doc_id, k.i FROM k JOIN m USING (h) WHERE first < k.doc_id), range(50) r(j)),
l AS (SELECT doc_id, list(pos) AS gone FROM g GROUP BY doc_id),
x AS (SELECT w.doc_id, pos, ws[pos + 1] AS word FROM (SELECT doc_id, ws, unnest(range(len(ws))) AS pos FROM w) w),
kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.pos) AS t, count(*) AS n FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.pos = x.pos WHERE g.pos IS NULL GROUP BY x.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

OP8_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
s1 AS (SELECT *, ([5, 2, 1])[((n - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s0),
s2 AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS gone, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS free FROM s1 WINDOW b AS (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, (total - gone) / free AS level, (total - gone) / free * weight >= cap AS capped FROM s2),
s4 AS (SELECT *, CASE WHEN capped THEN cap ELSE least(cap, (max(CASE WHEN NOT capped THEN level END) OVER ()) * weight) END AS target FROM s3),
s5 AS (SELECT *, sum(target) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING) / sum(target) OVER () AS high FROM s4),
s AS (SELECT *, coalesce(lag(high) OVER (ORDER BY n), 0) AS low, n = max(n) OVER () AS last FROM s5),
t AS (SELECT slot, (((slot + 1) % 1048576)::DOUBLE * {mixing.PHI!r}::DOUBLE + ((slot + 1) // 1048576)::DOUBLE * {mixing.PHI_HIGH!r}::DOUBLE) % 1::DOUBLE AS u
      FROM range((SELECT round_even(sum(target) / {mixing.BLOCK}, 0)::BIGINT FROM s)) r(slot)),
b AS (SELECT n, row_number() OVER (PARTITION BY n ORDER BY slot) - 1 AS block FROM t JOIN s ON u >= low AND (u < high OR last)),
r AS (SELECT doc_id, n, size, round, md5('mix/' || round || '/' || doc_id) AS mixed FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, range(2) q(round) WHERE size > 0),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY n ORDER BY round, mixed, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM r),
p AS (SELECT doc_id, n, start, size, unnest(range(start // {mixing.BLOCK}, (start + size - 1) // {mixing.BLOCK} + 1)) AS block FROM o),
k AS (SELECT doc_id, sum(least(start + size, (p.block + 1) * {mixing.BLOCK}) - greatest(start, p.block * {mixing.BLOCK})) AS taken FROM p JOIN b ON b.n = p.n AND b.block = p.block GROUP BY doc_id)
SELECT d.doc_id, d.size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN k ON k.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_licenses": licenses.duckdb_sql(), "op4_substring_dedup": OP4_SQL, "op8_mixing": OP8_SQL, "op10_exact_dedup": OP10_SQL}
