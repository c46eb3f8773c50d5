"""The query language."""

from termloom.plans.query import AndNode, NearNode, NotNode, OrNode, PhraseNode, QueryNode, QueryParseError, TermNode, has_structure, leaves, parse_query, terms_of

__all__ = ["AndNode", "NearNode", "NotNode", "OrNode", "PhraseNode", "QueryNode", "QueryParseError", "TermNode", "has_structure", "leaves", "parse_query", "terms_of"]
