"""The query language: text to a tree, on the driver.

Operators bind NOT, then AND (also written by putting things side by side), then OR.
``"a b"`` is a phrase, ``a NEAR/3 b`` two terms at most three positions apart.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from termloom.functions.text import DEFAULT, TokenizerConfig, tokenize


class QueryParseError(ValueError):
    """The query text is not well formed."""


@dataclass(frozen=True)
class TermNode:
    term: str


@dataclass(frozen=True)
class PhraseNode:
    terms: tuple[str, ...]


@dataclass(frozen=True)
class NearNode:
    left: str
    right: str
    distance: int


@dataclass(frozen=True)
class AndNode:
    left: QueryNode
    right: QueryNode


@dataclass(frozen=True)
class OrNode:
    left: QueryNode
    right: QueryNode


@dataclass(frozen=True)
class NotNode:
    child: QueryNode


QueryNode = TermNode | PhraseNode | NearNode | AndNode | OrNode | NotNode

# The words and signs of the query language.
LEXEME = re.compile(r'(?P<phrase>"[^"]*")|(?P<open>\()|(?P<close>\))|(?P<near>\bNEAR/\d+\b)|(?P<op>\b(?:AND|OR|NOT)\b)|(?P<term>[^\s()]+)')
STRUCTURE = re.compile(r'["()]|\b(?:AND|OR|NOT|NEAR/\d+)\b')
#: How tightly the infix operators bind.
BINDS = {"OR": 1, "AND": 2}


def lex(text: str) -> list[tuple[str, str]]:
    """(kind, text) of each lexeme; a keyword is its own kind."""
    out = []
    for m in LEXEME.finditer(text):
        kind, raw = m.lastgroup, m[0]
        if kind == "op":
            kind = raw
        elif kind == "term" and raw.startswith('"'):
            raise QueryParseError("a quote is not closed")
        elif kind == "term" and raw.startswith("NEAR/"):
            kind = "near"
        out.append((kind, raw))
    return out


def parse_query(text: str, config: TokenizerConfig = DEFAULT) -> QueryNode:
    """The tree of a query, its terms normalised by the tokenizer; QueryParseError if it is not well formed."""
    lexemes = [*lex(text), ("end", "")]
    at = 0

    def peek() -> str:
        return lexemes[at][0]

    def take() -> tuple[str, str]:
        nonlocal at
        at += 1
        return lexemes[at - 1]

    def one_term(raw: str) -> str:
        found = tokenize(raw, config)
        if len(found) != 1:
            raise QueryParseError(f"{raw!r} is not exactly one term")
        return found[0]

    def operand() -> QueryNode:
        kind, raw = take()
        if kind == "NOT":
            return NotNode(operand())
        if kind == "open":
            inner = expression(0)
            if take()[0] != "close":
                raise QueryParseError("a parenthesis is not closed")
            return inner
        if kind == "phrase":
            words = tuple(tokenize(raw[1:-1], config))
            if not words:
                raise QueryParseError("a phrase has no terms")
            return PhraseNode(words)
        if kind != "term":
            raise QueryParseError("the query ends too early" if kind == "end" else f"unexpected {raw!r}")
        if peek() != "near":
            return TermNode(one_term(raw))
        number = take()[1].removeprefix("NEAR/")
        if not number.isdecimal() or int(number) < 1:
            raise QueryParseError(f"NEAR/{number} needs a whole number from 1 on")
        kind, other = take()
        if kind != "term":
            raise QueryParseError("NEAR needs a single term on each side")
        return NearNode(one_term(raw), one_term(other), int(number))

    def expression(least: int) -> QueryNode:
        left = operand()
        while True:
            op = peek()
            implied = op in ("term", "phrase", "open", "NOT")
            binds = BINDS["AND"] if implied else BINDS.get(op, 0)
            if binds <= least:
                return left
            if not implied:
                take()
            right = expression(binds)
            left = OrNode(left, right) if op == "OR" else AndNode(left, right)

    if peek() == "end":
        raise QueryParseError("the query is empty")
    tree = expression(0)
    if peek() != "end":
        raise QueryParseError(f"unexpected {lexemes[at][1]!r}")
    return tree


def has_structure(text: str) -> bool:
    return STRUCTURE.search(text) is not None


def leaves(node: QueryNode) -> list[TermNode | PhraseNode | NearNode]:
    """From left to right, those below NOT too."""
    if isinstance(node, NotNode):
        return leaves(node.child)
    if isinstance(node, AndNode | OrNode):
        return leaves(node.left) + leaves(node.right)
    if isinstance(node, TermNode | PhraseNode | NearNode):
        return [node]
    raise TypeError(f"not a query node: {node!r}")


def terms_of(node: QueryNode) -> list[str]:
    """The terms of a query from left to right, repeated ones too."""
    out: list[str] = []
    for leaf in leaves(node):
        out += [leaf.term] if isinstance(leaf, TermNode) else leaf.terms if isinstance(leaf, PhraseNode) else (leaf.left, leaf.right)
    return out
