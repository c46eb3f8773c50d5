"""Precision, recall, reciprocal rank and nDCG of ranked runs against graded judgments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.text import TokenizerConfig
from termloom.operators.index import build_index, stored
from termloom.operators.ranking import search_batch

RELEVANT = 2


def reject_repeated(judgments: DataFrame) -> None:
    repeated = judgments.groupBy("query_id", "doc_id").count().where("count > 1").first()
    if repeated is not None:
        raise ValueError(f"document {repeated.doc_id!r} is judged more than once for query {repeated.query_id!r}")


def per_query(queries: DataFrame, run: DataFrame, judgments: DataFrame, k: int = 10, threshold: int = RELEVANT) -> DataFrame:
    """query_id, precision_at_k, recall_at_k, reciprocal_rank, ndcg_at_k of every query, with results or without.

    Precision divides by k whatever was found, recall is 1 where nothing is relevant, the
    reciprocal rank looks at the whole run, and the ideal gain is that of all judgments.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    judged = judgments.select("query_id", "doc_id", "relevance")
    hits = run.select("query_id", "rank", "doc_id").join(judged, ["query_id", "doc_id"], "left")
    relevant, near = F.coalesce(F.col("relevance") >= threshold, F.lit(False)), F.col("rank") <= k
    gain = F.coalesce("relevance", F.lit(0)) / F.log2(F.col("rank") + 1.0)
    found = hits.groupBy("query_id").agg(F.sum((near & relevant).cast("int")).alias("found"), F.min(F.when(relevant, F.col("rank"))).alias("first"), F.sum(F.when(near, gain)).alias("dcg"))
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id")
    best = judged.withColumn("at", F.row_number().over(order))
    ideal = best.groupBy("query_id").agg(F.sum((F.col("relevance") >= threshold).cast("int")).alias("relevant"), F.sum(F.when(F.col("at") <= k, F.col("relevance") / F.log2(F.col("at") + 1.0))).alias("idcg"))
    joined = queries.select("query_id").join(found, "query_id", "left").join(ideal, "query_id", "left")
    hit = F.coalesce("found", F.lit(0))
    return joined.select(
        "query_id",
        (hit / F.lit(float(k))).alias("precision_at_k"),
        F.when(F.coalesce("relevant", F.lit(0)) == 0, 1.0).otherwise(F.try_divide(hit, F.col("relevant"))).alias("recall_at_k"),
        F.coalesce(F.try_divide(F.lit(1.0), F.col("first")), F.lit(0.0)).alias("reciprocal_rank"),
        F.when(F.coalesce("idcg", F.lit(0.0)) > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0).alias("ndcg_at_k"),
    )


def report(metrics: DataFrame, k: int) -> DataFrame:
    """One row: the means over all queries, k and num_queries; zeros without queries."""
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}") for c in ("precision_at_k", "recall_at_k", "reciprocal_rank", "ndcg_at_k")]
    return metrics.agg(*means, F.lit(k).alias("k"), F.count("*").alias("num_queries"))


def evaluate(queries: DataFrame, run: DataFrame, judgments: DataFrame, k: int = 10, threshold: int = RELEVANT, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """(one row per query, the one-row report)."""
    if check:
        reject_repeated(judgments)
    metrics = per_query(queries, run, judgments, k, threshold)
    return metrics, report(metrics, k)


def gaps(judgments: DataFrame, run: DataFrame, documents: DataFrame, text_column: str = "text", threshold: int = RELEVANT) -> DataFrame:
    """query_id, doc_id, relevance, text of the relevant documents that the run misses."""
    missed = judgments.where(F.col("relevance") >= threshold).join(run.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return missed.join(documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(text_column).alias("text")), "doc_id", "left").select("query_id", "doc_id", "relevance", "text")


@dataclass(frozen=True)
class Demo:
    """results (query_id, rank, doc_id, score, text), metrics by query, their means, and missed, as gaps() has it."""

    results: DataFrame
    metrics: DataFrame
    means: DataFrame
    missed: DataFrame


def demo(documents: DataFrame, queries: DataFrame, judgments: DataFrame, k: int = 5, shown: int = 3) -> Demo:
    """Search, evaluation at k and gaps of a judged collection, by an index without stopwords; the first shown results have their texts."""
    index = stored(build_index(documents, config=TokenizerConfig(drop_stopwords=True)), positions=False)
    found = search_batch(queries, index, top_k=k)
    metrics, means = evaluate(queries, found, judgments, k)
    texts = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    results = found.where(F.col("rank") <= shown).join(texts, "doc_id").select("query_id", "rank", "doc_id", "score", "text")
    return Demo(results, metrics, means, gaps(judgments, found, documents))
