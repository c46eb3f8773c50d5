"""Indexing, ranking, structured retrieval, evaluation and preparation."""

from termloom.operators.index import SearchIndex, build_index, hapax_ratio, index_summary, load_index, lookup, most_frequent, stored, vocabulary, vocabulary_summary
from termloom.operators.ranking import ScorerConfig, bm25, idf, idf_of, parameter_grid, query_terms, ranked, score_queries, search, search_batch, term_scores
from termloom.operators.structured import retrieve, search_structured, search_structured_batch
from termloom.operators.evaluation import Demo, demo, evaluate, gaps, per_query, report
from termloom.operators.prep import numbered, prepare_amazon_esci, prepare_esci, prepare_flipkart_titles, prepare_titles
from termloom.operators.titles import make_titles

__all__ = ["Demo", "ScorerConfig", "SearchIndex", "bm25", "build_index", "demo", "evaluate", "gaps", "hapax_ratio", "idf", "idf_of", "index_summary", "load_index", "lookup", "make_titles", "most_frequent", "numbered", "parameter_grid", "per_query", "prepare_amazon_esci", "prepare_esci", "prepare_flipkart_titles", "prepare_titles", "query_terms", "ranked", "report", "retrieve", "score_queries", "search", "search_batch", "search_structured", "search_structured_batch", "stored", "term_scores", "vocabulary", "vocabulary_summary"]
