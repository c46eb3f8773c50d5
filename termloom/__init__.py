"""Lexical search and retrieval evaluation on Spark DataFrames.

The API is in the subpackages functions, operators, plans, sources and streaming.
"""
