"""A training-corpus pipeline over documents: language ID, exact dedup, near-dedup, mixing to weights, BPE.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns of
documents. ``run`` writes each stage's rows as Parquet into the shared folder and reads them again for the next.

Defined cases, stage by stage: null texts and texts without a letter leave with the first stage, as no language can be
told; null ids, langs and sources are kept, and null sources form one source of the mix; of repeated rows and equal texts
one stays, of near copies the smallest id's (rows without an id are near copies of each other alone), whatever other texts
have its id; ties are broken by id, then by the other columns; a very long text is read whole by each stage; further columns
pass through, whatever their names; an empty table passes as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelweave.llm import bpe, exact_dedup, langid, mixing, simhash
from voxelweave.llm.common import materialise
from voxelweave.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: no letter, or no language with a score of a half."""
    return langid.keep_identified(docs, langid.fit(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest, then smallest id stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose five-word shingles have a Jaccard similarity of 0.8 or more link: by SimHash with an exact check, then
    exactly what its bits miss; the smallest id of each group stays."""
    return simhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids: one row for each document of the mix."""
    return bpe.encode_decode(docs, tokenizer_path(), keep_ids=True)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("bpe", tokens)]

#: BPE can't be expressed in SQL; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
