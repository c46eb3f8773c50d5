"""Boolean, phrase and proximity retrieval: a query tree becomes one Boolean column.

The postings of the query's terms are gathered once per document as a map from term to
positions (as many entries as the query has terms), and the whole tree is evaluated on
that map.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import TokenizerConfig, tokenize
from termloom.operators.index import SearchIndex
from termloom.operators.ranking import ScorerConfig, ranked, score_queries, search
from termloom.plans.query import AndNode, NearNode, NotNode, OrNode, PhraseNode, QueryNode, QueryParseError, TermNode, has_structure, parse_query, terms_of

POSITIONS = "map<string,array<int>>"


def positions_of(term: str) -> Column:
    return F.coalesce(F.try_element_at("found", F.lit(term)), F.array().cast("array<int>"))


def phrase_at(terms: tuple[str, ...]) -> Column:
    """Some position of the first term from which the others follow one by one: positions moved back by each term's place in the phrase have one in common (by hashing, in linear time)."""

    def moved(k: int) -> Column:
        return F.transform(positions_of(terms[k]), lambda p: p - k)

    return F.size(reduce(F.array_intersect, map(moved, range(len(terms))))) > 0


def near(left: str, right: str, distance: int) -> Column:
    """Of all positions in one order, some two neighbours are of different sides and close: the closest pair always is neighbours."""

    def marked(term: str, side: int) -> Column:
        return F.transform(positions_of(term), lambda p: F.struct(p.alias("at"), F.lit(side).alias("side")))

    def close(order: Column) -> Column:
        steps = F.greatest(F.size(order) - 1, F.lit(0))
        return F.array_contains(F.zip_with(F.slice(order, F.lit(1), steps), F.slice(order, F.lit(2), steps), lambda a, b: (a["side"] != b["side"]) & (b["at"] - a["at"] <= distance)), True)

    return F.transform(F.array(F.sort_array(F.concat(marked(left, 0), marked(right, 1)))), close)[0]


def condition(node: QueryNode) -> Column:
    """The tree over the map ``found`` of a document."""
    if isinstance(node, TermNode):
        return F.map_contains_key("found", node.term)
    if isinstance(node, PhraseNode):
        return phrase_at(node.terms) if node.terms else F.lit(False)
    if isinstance(node, NearNode):
        return near(node.left, node.right, node.distance)
    if isinstance(node, AndNode):
        return condition(node.left) & condition(node.right)
    if isinstance(node, OrNode):
        return condition(node.left) | condition(node.right)
    if isinstance(node, NotNode):
        return ~condition(node.child)
    raise TypeError(f"not a query node: {node!r}")


def gathered(index: SearchIndex, terms: list[str]) -> DataFrame:
    own = index.postings.where(F.col("term").isin(sorted(set(terms))))
    return own.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", F.col("positions").cast("array<int>")))).alias("found"))


def retrieve(node: QueryNode, index: SearchIndex) -> DataFrame:
    """doc_id of every document that satisfies the tree; NOT is against all documents, empty ones too."""
    found = gathered(index, terms_of(node))
    every = index.doc_lengths.select("doc_id").join(found, "doc_id", "left").withColumn("found", F.coalesce("found", F.create_map().cast(POSITIONS)))
    return every.where(condition(node)).select("doc_id")


def structured_tree(text: str, config: TokenizerConfig) -> QueryNode:
    tree = parse_query(text, config)
    if isinstance(tree, NotNode):
        raise QueryParseError("a query of negations only selects nothing to rank")
    return tree


def search_structured(text: str, index: SearchIndex, config: ScorerConfig = ScorerConfig(), top_k: int = 10) -> DataFrame:
    """rank, doc_id, score. A text without structure is a bag of words; a blank one finds nothing.

    Ranked are documents with a term of the query alone, so those without any need not
    be tried against the tree. Terms below NOT count in the scores.
    """
    if not text.strip():
        return search([], index, config, top_k)
    if not has_structure(text):
        return search(tokenize(text, index.config), index, config, top_k)
    tree = structured_tree(text, index.config)
    found = batch([("q", tree)], index, config, top_k)
    return found.select("rank", "doc_id", "score")


def batch(trees: list[tuple[str, QueryNode]], index: SearchIndex, config: ScorerConfig, top_k: int) -> DataFrame:
    """query_id, rank, doc_id, score of query trees: one gathering of all terms, one scoring for all queries."""
    spark = index.postings.sparkSession
    terms = [(name, t) for name, tree in trees for t in terms_of(tree)]
    found = gathered(index, [t for _, t in terms])
    holds = F.array(*(F.when(condition(tree), F.lit(name)) for name, tree in trees))
    candidates = found.select("doc_id", F.explode(holds).alias("query_id")).where("query_id IS NOT NULL")
    table = spark.createDataFrame(terms, "query_id string, term string").groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    return ranked(score_queries(table, index, config, candidates), top_k)


def search_structured_batch(queries: list[tuple[str, str]], index: SearchIndex, config: ScorerConfig = ScorerConfig(), top_k: int = 10, chunk: int = 25) -> DataFrame:
    """query_id, rank, doc_id, score for (query_id, text) pairs. Queries without structure are one batch, trees go by chunks so that plans stay small.

    The first query that is not well formed stops the batch.
    """
    spark = index.postings.sparkSession
    trees = [(q, structured_tree(t, index.config)) for q, t in queries if t.strip() and has_structure(t)]
    plain = [(q, term) for q, t in queries if t.strip() and not has_structure(t) for term in tokenize(t, index.config)]
    parts = [batch(trees[i : i + chunk], index, config, top_k) for i in range(0, len(trees), chunk)]
    if plain:
        table = spark.createDataFrame(plain, "query_id string, term string").groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        parts.append(ranked(score_queries(table, index, config), top_k))
    if not parts:
        return spark.createDataFrame([], "query_id string, rank int, doc_id string, score double")
    return reduce(DataFrame.unionByName, parts)
