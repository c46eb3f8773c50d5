"""Command line: tokenize, vocab, index, lookup, search, search-structured, eval, eval-structured, demo, prepare-titles, prepare-esci, make-titles.

An index is a folder of Parquet tables, or JSON where its path ends in .json.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from termloom.functions.text import TokenizerConfig, tokenize
from termloom.operators.evaluation import demo, evaluate
from termloom.operators.index import SearchIndex, build_index, index_summary, lookup, vocabulary_summary
from termloom.operators.prep import prepare_amazon_esci, prepare_flipkart_titles
from termloom.operators.ranking import ScorerConfig, search, search_batch
from termloom.operators.structured import search_structured, search_structured_batch
from termloom.operators.titles import make_titles
from termloom.sources.files import open_index, read_documents, read_qrels, read_queries, write_csv, write_index

TOKENIZER, TABLE, SCORER, RESULTS = object(), object(), object(), object()
#: Options of each command: groups above, or (flag, keywords of argparse).
COMMANDS = {
    "tokenize": [("--text", {"required": True}), TOKENIZER],
    "vocab": [TABLE, TOKENIZER],
    "index": [TABLE, ("--output", {"required": True}), TOKENIZER],
    "lookup": [("--index", {"required": True}), ("--term", {"required": True})],
    "search": [("--index", {"required": True}), ("--query", {"required": True}), RESULTS, SCORER],
    "search-structured": [TABLE, ("--query", {"required": True}), RESULTS, SCORER, TOKENIZER],
    "eval": [("--index", {"required": True}), ("--qrels", {"required": True}), ("--queries", {"required": True}), ("--k", {"type": int, "default": 10}), ("--per-query", {"action": "store_true"}), RESULTS, SCORER, TOKENIZER],
    "eval-structured": [TABLE, ("--qrels", {"required": True}), ("--queries", {"required": True}), ("--k", {"type": int, "default": 10}), ("--per-query", {"action": "store_true"}), RESULTS, SCORER, TOKENIZER],
    "demo": [TABLE, ("--qrels", {"required": True}), ("--queries", {"required": True}), ("--show", {"type": int, "default": 5})],
    "make-titles": [("--output", {"required": True}), ("--rows", {"type": int, "default": 500}), ("--seed", {"type": int, "default": 42})],
    "prepare-titles": [("--input", {"required": True}), ("--output", {"required": True}), ("--text-column", {"required": True}), ("--doc-id-column", {}), ("--limit", {"type": int})],
    "prepare-esci": [("--products", {"required": True}), ("--queries", {"required": True}), ("--labels", {"required": True}), ("--output-dir", {"required": True}), ("--limit", {"type": int})],
}
GROUPS = {
    TOKENIZER: [("--no-lowercase", {"action": "store_true"}), ("--drop-stopwords", {"action": "store_true"}), ("--stemming", {"choices": ["none", "suffix"], "default": "none"}), ("--strip-accents", {"action": "store_true"}), ("--split-numeric", {"action": "store_true"})],
    TABLE: [("--csv", {"required": True}), ("--text-column", {"default": "title"}), ("--doc-id-column", {"default": "product_id"}), ("--limit", {"type": int})],
    SCORER: [("--k1", {"type": float, "default": 1.2}), ("--b", {"type": float, "default": 0.75})],
    RESULTS: [("--top-k", {"type": int, "default": 10})],
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="termloom", description=__doc__)
    commands = top.add_subparsers(dest="command")
    for name, options in COMMANDS.items():
        sub = commands.add_parser(name)
        for option in options:
            for flag, keywords in GROUPS.get(option, [option]) if not isinstance(option, tuple) else [option]:
                sub.add_argument(flag, **keywords)
    return top


def tokenizer(args) -> TokenizerConfig:
    return TokenizerConfig(not args.no_lowercase, args.strip_accents, args.split_numeric, args.drop_stopwords, args.stemming)


def indexed(spark: SparkSession, args) -> SearchIndex:
    return build_index(read_documents(spark, args.csv, args.text_column, args.doc_id_column, args.limit), config=tokenizer(args))


def show(found, query: str, label: str) -> None:
    rows = found.orderBy("rank").collect()
    print(f"Top {len(rows)} {label}results for '{query}':" if rows else f"No results for '{query}'.")
    for row in rows:
        print(f"  {row['rank']}. {row['doc_id']}  score={row['score']:.4f}")


def show_report(queries, run, judgments, args, title: str) -> None:
    metrics, means = evaluate(queries, run, judgments, args.k)
    row = means.first()
    print(f"{title} (k={row.k}, queries={row.num_queries})")
    for name, value in ((f"Mean P@{args.k}", row.mean_precision_at_k), (f"Mean R@{args.k}", row.mean_recall_at_k), ("MRR", row.mean_reciprocal_rank), (f"Mean nDCG@{args.k}", row.mean_ndcg_at_k)):
        print(f"  {name}: {value:.4f}")
    if args.per_query:
        for q in metrics.orderBy("query_id").toLocalIterator():
            print(f"  {q.query_id}: P={q.precision_at_k:.3f} R={q.recall_at_k:.3f} RR={q.reciprocal_rank:.3f} nDCG={q.ndcg_at_k:.3f}")


def show_demo(spark: SparkSession, args) -> None:
    """What is found, how good it is, and what is missed."""
    documents = read_documents(spark, args.csv, args.text_column, args.doc_id_column, args.limit)
    queries = read_queries(spark, args.queries)
    found = demo(documents, queries, read_qrels(spark, args.qrels))
    shown = [r.query_id for r in queries.orderBy("query_id").limit(args.show).collect()]
    print("1. What the index finds")
    for row in found.results.where(F.col("query_id").isin(shown)).orderBy("query_id", "rank").collect():
        print(f"  {row.query_id}  {row['rank']}. {row.doc_id}  score={row.score:.4f}  {row.text}")
    means = found.means.first()
    print(f"2. How good that is (k={means.k}, queries={means.num_queries})")
    print(f"  P {means.mean_precision_at_k:.4f}  R {means.mean_recall_at_k:.4f}  MRR {means.mean_reciprocal_rank:.4f}  nDCG {means.mean_ndcg_at_k:.4f}")
    for q in found.metrics.where(F.col("query_id").isin(shown)).orderBy("query_id").collect():
        print(f"  {q.query_id}: P={q.precision_at_k:.3f} nDCG={q.ndcg_at_k:.3f}")
    print("3. What it misses")
    for row in found.missed.orderBy("query_id", F.desc("relevance"), "doc_id").toLocalIterator():
        print(f"  {row.query_id}  {row.doc_id}  relevance={row.relevance}  {row.text}")


def run(spark: SparkSession, args) -> None:
    command = args.command
    if command in ("vocab", "index"):
        index = indexed(spark, args)
        for name, value in (vocabulary_summary(index) if command == "vocab" else index_summary(index)).first().asDict().items():
            print(f"{name} = {value}")
        if command == "index":
            write_index(index, args.output)
            print(f"saved to = {args.output}")
    elif command == "lookup":
        term = args.term.strip().lower()
        rows = lookup(open_index(spark, args.index), term).collect()
        print(f"Term '{term}' found in {len(rows)} document(s):" if rows else f"Term '{term}' not found in index.")
        for row in rows:
            print(f"  {row.doc_id}  tf={row.tf}")
    elif command == "search":
        show(search(args.query.strip().lower().split(), open_index(spark, args.index), ScorerConfig(args.k1, args.b), args.top_k), args.query, "")
    elif command == "search-structured":
        show(search_structured(args.query, indexed(spark, args), ScorerConfig(args.k1, args.b), args.top_k), args.query, "structured ")
    elif command == "eval":
        index = open_index(spark, args.index, tokenizer(args))
        queries = read_queries(spark, args.queries)
        show_report(queries, search_batch(queries, index, ScorerConfig(args.k1, args.b), args.top_k), read_qrels(spark, args.qrels), args, "Evaluation Report")
    elif command == "eval-structured":
        queries = read_queries(spark, args.queries)
        pairs = [(r.query_id, r.query) for r in queries.collect()]
        show_report(queries, search_structured_batch(pairs, indexed(spark, args), ScorerConfig(args.k1, args.b), args.top_k), read_qrels(spark, args.qrels), args, "Structured Evaluation Report")
    elif command == "demo":
        show_demo(spark, args)
    elif command == "make-titles":
        done = write_csv(make_titles(spark, args.rows, args.seed).orderBy("product_id"), args.output, ["product_id", "title", "category"])
        print(f"{done.path}: {done.row_count} rows")
    elif command == "prepare-titles":
        done = prepare_flipkart_titles(spark, args.input, args.output, args.text_column, args.doc_id_column, args.limit)
        print(f"{done.path}: {done.row_count} rows")
    elif command == "prepare-esci":
        for done in prepare_amazon_esci(spark, args.products, args.queries, args.labels, args.output_dir, args.limit):
            print(f"{done.path}: {done.row_count} rows")


def main(argv: list[str] | None = None) -> int:
    top = parser()
    args = top.parse_args(argv)
    if args.command is None:
        top.print_help()
        return 1
    if args.command == "tokenize":
        print(tokenize(args.text, tokenizer(args)))
        return 0
    run(SparkSession.builder.appName("termloom").config("spark.ui.enabled", "false").getOrCreate(), args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
