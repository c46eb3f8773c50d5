"""BM25 ranking of one query or of a table of queries."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.text import tokens
from termloom.operators.index import SearchIndex


@dataclass(frozen=True)
class ScorerConfig:
    k1: float = 1.2
    b: float = 0.75


def idf(df: Column, n: Column) -> Column:
    """ln((N - df + 0.5) / (df + 0.5)), below zero for terms in most documents; 0 for a term in none."""
    return F.when(df > 0, F.log((n - df + 0.5) / (df + 0.5))).otherwise(0.0)


def bm25(tf: Column, dl: Column, avgdl: Column, weight: Column, k1: Column, b: Column) -> Column:
    return weight * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * dl / avgdl))


def weighted_postings(index: SearchIndex, wanted: DataFrame | None = None, terms: Sequence[str] | None = None) -> DataFrame:
    """term, doc_id, tf, dl, idf, avgdl of the wanted terms' postings. df is counted before any restriction to documents."""
    postings = index.postings.select("term", "doc_id", "tf")
    if terms is not None:
        postings = postings.where(F.col("term").isin(list(terms)))
    if wanted is not None:
        postings = postings.join(wanted, "term", "left_semi")
    if index.term_table is None:
        dfs = postings.groupBy("term").agg(F.count("*").alias("df"))
    else:
        dfs = index.term_table.select("term", "df")
        dfs = dfs.where(F.col("term").isin(list(terms))) if terms is not None else dfs
    one_row = F.broadcast(index.stats().select("document_count", "avgdl"))
    joined = postings.join(dfs, "term").join(index.doc_lengths, "doc_id").crossJoin(one_row)
    return joined.withColumn("idf", idf(F.col("df"), F.col("document_count")))


def idf_of(index: SearchIndex, terms: Sequence[str]) -> DataFrame:
    """term and idf, 0 for terms that no document has."""
    spark = index.postings.sparkSession
    asked = spark.createDataFrame([(t,) for t in dict.fromkeys(terms)], "term string")
    dfs = index.postings.where(F.col("term").isin(list(terms))).groupBy("term").agg(F.count("*").alias("df"))
    return asked.join(dfs, "term", "left").crossJoin(F.broadcast(index.stats())).select("term", idf(F.coalesce("df", F.lit(0)), F.col("document_count")).alias("idf"))


def term_scores(index: SearchIndex, terms: Sequence[str], config: ScorerConfig = ScorerConfig()) -> DataFrame:
    """term, doc_id, score of each posting of the terms."""
    found = weighted_postings(index, terms=terms)
    return found.select("term", "doc_id", bm25(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("idf"), F.lit(config.k1), F.lit(config.b)).alias("score"))


def ranked(scores: DataFrame, top_k: int) -> DataFrame:
    """query_id, rank, doc_id, score: best first, ties by doc_id. Scores rank by nine decimals, so the order of their sums cannot break a tie."""
    if top_k < 0:
        raise ValueError("top_k must not be negative")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("query_id", "rank", "doc_id", "score")


def query_terms(queries: DataFrame, index: SearchIndex, id_column: str = "query_id", text_column: str = "query") -> DataFrame:
    """query_id, term, qtf of a table of query texts, with the tokenizer of the index."""
    split = queries.select(F.col(id_column).cast("string").alias("query_id"), F.explode_outer(tokens(F.col(text_column), index.config)).alias("term"))
    return split.where("term IS NOT NULL").groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def score_queries(terms: DataFrame, index: SearchIndex, config: ScorerConfig = ScorerConfig(), candidates: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, score of every document with a term of the query; a repeated term counts as often.

    candidates (query_id, doc_id) restricts the documents below the aggregate: the
    corpus constants do not depend on them.
    """
    found = weighted_postings(index, terms.select("term").distinct()).join(terms, "term")
    if candidates is not None:
        found = found.join(candidates, ["query_id", "doc_id"], "left_semi")
    score = F.col("qtf") * bm25(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("idf"), F.lit(config.k1), F.lit(config.b))
    return found.groupBy("query_id", "doc_id").agg(F.sum(score).alias("score"))


def search_batch(queries: DataFrame, index: SearchIndex, config: ScorerConfig = ScorerConfig(), top_k: int = 10) -> DataFrame:
    """query_id, rank, doc_id, score for a table query_id, query: one job for all queries."""
    return ranked(score_queries(query_terms(queries, index), index, config), top_k)


def search(terms: Sequence[str], index: SearchIndex, config: ScorerConfig = ScorerConfig(), top_k: int = 10) -> DataFrame:
    """rank, doc_id, score for a list of terms as the index has them."""
    spark = index.postings.sparkSession
    if top_k < 0:
        raise ValueError("top_k must not be negative")
    counted = Counter(terms)
    weights = F.lit(0)
    for term, n in counted.items():
        weights = F.when(F.col("term") == term, F.lit(n)).otherwise(weights)
    if not counted:
        return spark.createDataFrame([], "rank int, doc_id string, score double")
    found = weighted_postings(index, terms=list(counted))
    score = weights * bm25(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("idf"), F.lit(config.k1), F.lit(config.b))
    best = found.groupBy("doc_id").agg(F.sum(score).alias("score")).orderBy(F.desc(F.round("score", 9)), "doc_id").limit(top_k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "doc_id"))).select("rank", "doc_id", "score")


def parameter_grid(queries: DataFrame, index: SearchIndex, k1s: Sequence[float], bs: Sequence[float], top_k: int = 10) -> DataFrame:
    """k1, b, query_id, rank, doc_id, score for every pair of parameters: the postings are joined once."""
    spark = index.postings.sparkSession
    grid = F.broadcast(spark.createDataFrame([(float(k), float(b)) for k in k1s for b in bs], "k1 double, b double"))
    terms = query_terms(queries, index)
    found = weighted_postings(index, terms.select("term").distinct()).join(terms, "term").crossJoin(grid)
    score = F.col("qtf") * bm25(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("idf"), F.col("k1"), F.col("b"))
    scores = found.groupBy("k1", "b", "query_id", "doc_id").agg(F.sum(score).alias("score"))
    order = Window.partitionBy("k1", "b", "query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("k1", "b", "query_id", "rank", "doc_id", "score")
