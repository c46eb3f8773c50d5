"""Positional inverted index and vocabulary as DataFrames."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.functions.text import DEFAULT, TokenizerConfig, tokenize_documents
from termloom.runtime import work_path


@dataclass(frozen=True)
class SearchIndex:
    """postings(term, doc_id, tf, positions), doc_lengths(doc_id, dl) and the tokenizer that made them.

    One table serves term and positional queries: positions are pruned where unused. A
    saved index also has its terms and its one row of statistics as tables.
    """

    postings: DataFrame
    doc_lengths: DataFrame
    config: TokenizerConfig = DEFAULT
    term_table: DataFrame | None = None
    stats_row: DataFrame | None = None

    def stats(self) -> DataFrame:
        """One row: document_count, total_terms, avgdl (0 if there are no documents). Empty documents count."""
        if self.stats_row is not None:
            return self.stats_row
        row = self.doc_lengths.agg(F.count("*").alias("document_count"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_terms"))
        return row.withColumn("avgdl", F.coalesce(F.try_divide("total_terms", "document_count"), F.lit(0.0)))

    def terms(self) -> DataFrame:
        """term, df, cf."""
        if self.term_table is not None:
            return self.term_table
        return self.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))

    def save(self, path: str, positions: bool = True) -> None:
        """Parquet, postings clustered by term so that look-ups prune row groups; beside them lengths, terms, statistics and the tokenizer.

        Texts are tokenised once: lengths and terms come from the postings that have been
        written. Without positions the index serves ranking only.
        """
        spark = self.postings.sparkSession
        columns = ["term", "doc_id", "tf", *(["positions"] if positions else [])]
        self.postings.select(*columns).repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        written = spark.read.parquet(f"{path}/postings")
        # Only the ids of the documents are read here, the tokens are pruned.
        own = written.groupBy("doc_id").agg(F.sum("tf").alias("dl"))
        lengths = self.doc_lengths.select("doc_id").join(own, "doc_id", "left").select("doc_id", F.coalesce("dl", F.lit(0)).cast("bigint").alias("dl"))
        lengths.write.mode("overwrite").parquet(f"{path}/doc_lengths")
        saved = SearchIndex(written, spark.read.parquet(f"{path}/doc_lengths"), self.config)
        saved.terms().repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        saved.stats().coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
        spark.createDataFrame([(json.dumps(self.config.as_dict()),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def load_index(spark: SparkSession, path: str, config: TokenizerConfig | None = None) -> SearchIndex:
    """A saved index; a config other than the one it was built with is refused."""
    saved = TokenizerConfig(**json.loads(spark.read.text(f"{path}/config").first().value))
    if config is not None and config != saved:
        raise ValueError(f"the index was built with {saved}, not {config}")
    postings, lengths, terms, stats = (spark.read.parquet(f"{path}/{name}") for name in ("postings", "doc_lengths", "terms", "stats"))
    return SearchIndex(postings, lengths, saved, terms, stats)


def stored(index: SearchIndex, positions: bool = True) -> SearchIndex:
    """The index, saved in the application's work folder: what it serves reads Parquet and tokenises nothing anew."""
    spark = index.postings.sparkSession
    path = work_path(spark)
    index.save(path, positions)
    return load_index(spark, path, index.config)


def reject_duplicates(docs: DataFrame, id_column: str) -> None:
    repeated = docs.groupBy(id_column).count().where("count > 1").select(id_column).first()
    if repeated is not None:
        raise ValueError(f"document id {repeated[0]!r} occurs more than once")


def build_index(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id", config: TokenizerConfig = DEFAULT, check_ids: bool = True) -> SearchIndex:
    """Postings with ascending 0-based positions in the token stream that is left after stopwords; one shuffle on (term, doc_id)."""
    if check_ids:
        reject_duplicates(docs, id_column)
    tokenized = tokenize_documents(docs, text_column, id_column, config)
    # posexplode_outer: a plain posexplode would have Catalyst repeat the tokenizer in a filter.
    stream = tokenized.select("doc_id", F.posexplode_outer("tokens").alias("pos", "term")).where("term IS NOT NULL")
    postings = stream.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    return SearchIndex(postings, tokenized.select("doc_id", F.col("token_count").alias("dl")), config)


def lookup(index: SearchIndex, term: str) -> DataFrame:
    """doc_id and tf of a term, by doc_id; no rows if it is absent."""
    return index.postings.where(F.col("term") == term).select("doc_id", "tf").orderBy("doc_id")


def index_summary(index: SearchIndex) -> DataFrame:
    """One row: documents, unique_terms, total_terms, avg_doc_len (one decimal)."""
    unique = index.postings.agg(F.countDistinct("term").alias("unique_terms"))
    return index.stats().crossJoin(unique).select(F.col("document_count").alias("documents"), "unique_terms", "total_terms", F.round("avgdl", 1).alias("avg_doc_len"))


def vocabulary(index: SearchIndex) -> DataFrame:
    """token, token_id (dense, alphabetical, from 1), df, cf.

    Tokens are numbered inside buckets of three leading characters (of 36 kinds, so their
    number is bounded) and moved on by the sizes of the buckets before: no task orders
    all tokens.
    """
    terms = index.terms().withColumn("bucket", F.substring("term", 1, 3))
    sizes = terms.groupBy("bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("bucket", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy("term"))
    return terms.withColumn("inside", inside).join(offsets, "bucket").select(F.col("term").alias("token"), (F.col("before") + F.col("inside")).alias("token_id"), "df", "cf")


def vocabulary_summary(index: SearchIndex) -> DataFrame:
    """One row: documents, total_terms, vocab_size."""
    return index_summary(index).select("documents", "total_terms", F.col("unique_terms").alias("vocab_size"))


def most_frequent(index: SearchIndex, n: int) -> DataFrame:
    """rank, term, cf of the n most frequent terms."""
    top = index.terms().orderBy(F.desc("cf"), "term").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cf"), "term"))).select("rank", "term", "cf")


def hapax_ratio(index: SearchIndex) -> DataFrame:
    """One row: the share of terms that one document alone has."""
    return index.terms().agg(F.coalesce(F.avg((F.col("df") == 1).cast("int")), F.lit(0.0)).alias("hapax_ratio"))
