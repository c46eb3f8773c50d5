"""CSV tables, the JSON form of an index, and relevance judgments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from termloom.functions.text import DEFAULT, TokenizerConfig
from termloom.operators.index import SearchIndex, load_index
from termloom.runtime import exists

# Grades of the labels exact, substitute, complement and irrelevant.
ESCI_GRADES = {"E": 3, "S": 2, "C": 1, "I": 0}
INDEX_SCHEMA = "document_count bigint, total_terms bigint, document_lengths map<string,bigint>, postings map<string,array<struct<doc_id:string,term_frequency:bigint>>>"


@dataclass(frozen=True)
class PreparedFile:
    path: str
    row_count: int


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """All columns as strings, header names trimmed, empty cells as empty strings; quotes inside quotes are doubled.

    With line breaks inside quotes a file is one task's; without multi_line, for tables
    that have none, files are split.
    """
    rows = spark.read.csv(path, header=True, multiLine=multi_line, quote='"', escape='"', inferSchema=False)
    named = rows.toDF(*(c.strip().removeprefix("﻿") for c in rows.columns))
    return named.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in named.columns))


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> PreparedFile:
    """A folder with one CSV file with a header; the rows are counted while they are written."""
    counted = Observation()
    out = rows.select(*columns).observe(counted, F.count(F.lit(1)).alias("n"))
    out.coalesce(1).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")
    return PreparedFile(path, counted.get["n"])


def read_documents(spark: SparkSession, path: str, text_column: str = "title", id_column: str = "product_id", limit: int | None = None) -> DataFrame:
    """doc_id and text of a CSV table; a limit of 0 still gives one row, as rows are counted after they are taken."""
    rows = read_csv(spark, path)
    for column in (text_column, id_column):
        if column not in rows.columns:
            raise ValueError(f"{path} has no column {column!r}")
    rows = rows.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return rows if limit is None else rows.limit(max(1, limit))


def read_queries(spark: SparkSession, path: str, id_column: str = "query_id", text_column: str = "query") -> DataFrame:
    rows = read_csv(spark, path)
    return rows.select(F.trim(id_column).alias("query_id"), F.trim(text_column).alias("query"))


def esci_grade(label):
    """The grade of a label column, in any case; an unknown label raises an error that names it."""
    upper = F.upper(F.trim(label))
    grade = None
    for name, value in ESCI_GRADES.items():
        grade = F.when(upper == name, F.lit(value)) if grade is None else grade.when(upper == name, F.lit(value))
    return grade.otherwise(F.raise_error(F.concat(F.lit("unknown ESCI label: "), upper)).cast("int"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id, relevance: of the columns esci_label and product_id where there is a label, else relevance and doc_id. Rows whose first cell starts with # are comments."""
    rows = read_csv(spark, path)
    first = F.col(f"`{rows.columns[0]}`")
    rows = rows.where(~F.trim(first).startswith("#"))
    if "esci_label" in rows.columns:
        return rows.select(F.trim("query_id").alias("query_id"), F.trim("product_id").alias("doc_id"), esci_grade(F.col("esci_label")).alias("relevance"))
    return rows.select(F.trim("query_id").alias("query_id"), F.trim("doc_id").alias("doc_id"), F.trim("relevance").cast("int").alias("relevance"))


def write_qrels(judgments: DataFrame, path: str) -> PreparedFile:
    return write_csv(judgments, path, ["query_id", "doc_id", "relevance"])


def text_source(spark: SparkSession, *texts: str) -> DataFrame:
    """Literal texts as documents text-1, text-2, and so on."""
    return spark.createDataFrame([(f"text-{i}", t) for i, t in enumerate(texts, 1)], "doc_id string, text string")


def write_index_json(index: SearchIndex, path: str) -> None:
    """One JSON document in one file, for exchange; it is built in one task and so for small indexes only. Parquet is the native form."""
    lists = index.postings.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("doc_id", F.col("tf").alias("term_frequency")))).alias("list"))
    whole = lists.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", "list")))).alias("postings"))
    lengths = index.doc_lengths.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("doc_id", "dl")))).alias("document_lengths"))
    row = index.stats().crossJoin(lengths).crossJoin(whole)
    row.select(F.to_json(F.struct("document_count", "total_terms", "document_lengths", "postings"))).coalesce(1).write.mode("overwrite").text(path)


def read_index_json(spark: SparkSession, path: str, config: TokenizerConfig = DEFAULT) -> SearchIndex:
    """An index without positions; counts and the average length are derived anew, never trusted."""
    row = spark.read.text(path, wholetext=True).select(F.from_json("value", INDEX_SCHEMA).alias("x"))
    lists = row.select(F.explode("x.postings").alias("term", "list")).select("term", F.explode("list").alias("p"))
    postings = lists.select("term", "p.doc_id", F.col("p.term_frequency").alias("tf"), F.lit(None).cast("array<int>").alias("positions"))
    return SearchIndex(postings, row.select(F.explode("x.document_lengths").alias("doc_id", "dl")), config)


def write_index(index: SearchIndex, path: str) -> None:
    """As JSON if the path says so, else as Parquet."""
    if path.endswith(".json"):
        write_index_json(index, path)
    else:
        index.save(path)


def open_index(spark: SparkSession, path: str, config: TokenizerConfig | None = None) -> SearchIndex:
    """An index in either form. One in Parquet refuses a config that it was not built with; one in JSON names none."""
    if exists(spark, f"{path}/postings"):
        return load_index(spark, path, config)
    return read_index_json(spark, path, config or DEFAULT)
