"""Tokenising a stream of documents with the batch expressions, and running counts of its terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import DEFAULT, TokenizerConfig, tokenize_documents


def term_stream(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id", config: TokenizerConfig = DEFAULT) -> DataFrame:
    """doc_id, term of a streaming or batch DataFrame; a narrow plan."""
    tokenized = tokenize_documents(docs, text_column, id_column, config)
    return tokenized.select("doc_id", F.explode_outer("tokens").alias("term")).where("term IS NOT NULL")


def running_frequencies(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id", config: TokenizerConfig = DEFAULT) -> DataFrame:
    """term, df, cf so far (complete or update mode); each document arrives once."""
    tokenized = tokenize_documents(docs, text_column, id_column, config)
    own = F.transform(F.array_distinct("tokens"), lambda t: F.struct(t.alias("term"), F.size(F.filter("tokens", lambda x: x == t)).alias("tf")))
    return tokenized.select(F.explode_outer(own).alias("x")).where("x IS NOT NULL").groupBy("x.term").agg(F.count("*").alias("df"), F.sum("x.tf").alias("cf"))
