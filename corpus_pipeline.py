"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of
documents, the last one the encoded corpus. run() applies them to the documents table,
each stage to all that the one before has kept.

1. quality_rules: documents that the base rules or the fertility bands reject go.
2. ngram_jaccard_join: of each group of near duplicates (shingles of five words, similar from 0.8 on) the smallest doc_id stays.
3. benchmark_decontamination: documents with a passage of a benchmark item go.
4. pii: personal data in the texts is replaced by the name of its kind; n_chars follows.
5. byte_bpe: token counts and digests of the byte-level BPE ids, and of the decoded text.

Rows that share a doc_id are one document: they stay or go together. Null and empty
texts fail the quality rules; an empty table gives an empty table at every stage. Texts of
any length are read whole. Further columns of documents are dropped by the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.byte_bpe import round_trip
from termloom.llm.common import cut, discard, table
from termloom.llm.decontamination import decontaminate
from termloom.llm.jaccard_join import jaccard_components
from termloom.llm.pii import mask_pii
from termloom.llm.quality_rules import quality_rules
from termloom.llm.queries import VOCABULARIES

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Ids of documents to drop that may be broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Near duplicates: words of a shingle, and the similarity in percent.
WIDTH, PERCENT = 5, 80


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id is not among ids."""
    ids = cut(ids.select(F.col("doc_id").alias("gone")).distinct())
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("gone")), "left_anti")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    judged = quality_rules(docs, [public_tokenizers.path(name) for name in VOCABULARIES])
    return without(docs, judged.where(~F.col("kept")))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    return without(docs, jaccard_components(docs, WIDTH, PERCENT, count_links=False).where("component_id != doc_id"))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    return without(docs, decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = mask_pii(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars")))


def encode_corpus(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", keep_quality),
    ("ngram_jaccard_join", keep_one_of_near_duplicates),
    ("benchmark_decontamination", keep_uncontaminated),
    ("pii", mask_personal_data),
    ("byte_bpe", encode_corpus),
]

#: Fertility, similarity components and BPE can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
            discard(before)
    return docs
