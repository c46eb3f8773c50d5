"""Preparation of product titles and of labelled query sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.sources.files import PreparedFile, read_csv, write_csv


def numbered(rows: DataFrame) -> DataFrame:
    """The rows with their 1-based number n in input order, without gathering them in one task.

    Rows are counted in their partitions, and moved on by the sizes of the partitions
    before: one row for each partition, so these are broadcast.
    """
    marked = rows.withColumn("_id", F.monotonically_increasing_id())
    part, inside = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = marked.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return marked.withColumn("_part", part).join(F.broadcast(offsets), "_part").select(*rows.columns, (F.col("_before") + inside + 1).alias("n"))


def first_rows(rows: DataFrame, limit: int | None) -> DataFrame:
    return rows if limit is None else rows.orderBy("n").limit(limit)


def prepare_titles(rows: DataFrame, text_column: str, id_column: str | None = None, limit: int | None = None, prefix: str = "flipkart") -> DataFrame:
    """product_id and title of the rows (n: input order) whose title is not blank. Without an id column, ids name the row's number in the input."""
    for column in filter(None, (text_column, id_column)):
        if column not in rows.columns:
            raise ValueError(f"there is no column {column!r}")
    title = F.trim(F.coalesce(F.col(text_column), F.lit("")))
    made = F.format_string(f"{prefix}-%06d", F.col("n"))
    own = F.trim(F.coalesce(F.col(id_column), F.lit(""))) if id_column else made
    kept = rows.select(own.alias("product_id"), title.alias("title"), "n").where(F.col("title") != "")
    return first_rows(kept, None if limit is None else max(1, limit)).select("product_id", "title", "n")


def either(rows: DataFrame, *columns: str):
    """The first of the columns that is there and not empty."""
    there = [F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns if c in rows.columns]
    return F.coalesce(*there, F.lit(""))


def prepare_esci(products: DataFrame, queries: DataFrame, labels: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(products, queries, labels), each with n, the input order. A limit takes the first queries, their labels, and the labels' products."""
    made = F.format_string("query-%06d", F.col("n"))
    q = queries.select(F.coalesce(F.nullif(either(queries, "query_id"), F.lit("")), made).alias("query_id"), either(queries, "query").alias("query"), "n")
    p = products.select(either(products, "product_id").alias("product_id"), either(products, "title", "product_title").alias("title"), "n")
    j = labels.select(either(labels, "query_id").alias("query_id"), either(labels, "product_id").alias("product_id"), either(labels, "esci_label", "label").alias("esci_label"), "n")
    if limit is not None:
        q = first_rows(q, limit)
        j = j.join(q.select("query_id"), "query_id", "left_semi")
        p = p.join(j.select("product_id"), "product_id", "left_semi")
    return p, q, j


def prepare_flipkart_titles(spark: SparkSession, input_path: str, output_path: str, text_column: str, doc_id_column: str | None = None, limit: int | None = None) -> PreparedFile:
    rows = prepare_titles(numbered(read_csv(spark, input_path)), text_column, doc_id_column, limit)
    return write_csv(rows.orderBy("n"), output_path, ["product_id", "title"])


def prepare_amazon_esci(spark: SparkSession, products_path: str, queries_path: str, labels_path: str, output_dir: str, limit: int | None = None) -> tuple[PreparedFile, PreparedFile, PreparedFile]:
    tables = prepare_esci(*(numbered(read_csv(spark, p)) for p in (products_path, queries_path, labels_path)), limit)
    names = (("products", ["product_id", "title"]), ("queries", ["query_id", "query"]), ("relevance_labels", ["query_id", "product_id", "esci_label"]))
    return tuple(write_csv(t.orderBy("n"), f"{output_dir}/{name}.csv", columns) for t, (name, columns) in zip(tables, names, strict=True))
