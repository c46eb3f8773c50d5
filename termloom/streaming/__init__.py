"""Tokens and term frequencies of streams."""

from termloom.streaming.terms import running_frequencies, term_stream

__all__ = ["running_frequencies", "term_stream"]
