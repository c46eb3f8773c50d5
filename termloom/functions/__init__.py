"""Text to tokens."""

from termloom.functions.text import DEFAULT, STOPWORDS, TokenizerConfig, lookup_form, normalized_text, search_form, stem, stem_token, term_counts, tokenize, tokenize_documents, tokens

__all__ = ["DEFAULT", "STOPWORDS", "TokenizerConfig", "lookup_form", "normalized_text", "search_form", "stem", "stem_token", "term_counts", "tokenize", "tokenize_documents", "tokens"]
