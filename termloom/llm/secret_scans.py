"""Secret scans with a trigram inverted index, in DataFrame operations only.

From each rule's pattern a Boolean trigram query is derived: clauses of trigrams, one of
which every match must contain whole. The index has the postings of the trigrams that
the queries name; one pass over each lower-cased text finds them all. A join with the
clauses and a count of their trigrams intersects the postings; only the candidates are
verified with the pattern. Patterns that need no trigram scan all texts.

Spans are code points, ends exclusive; those that start together are ordered as their kinds
are listed. Null and empty
texts have none; an empty table gives an empty table. Texts of any length and with any
number of matches are scanned whole. Repeated rows give repeated results; rows that share
an id share candidates, which verification settles. Further columns, whatever their names,
are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _parser as regex_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import cut

#: Strings that a part of a pattern may stand for before its trigrams are taken, and clauses of a query.
MOST_STRINGS, MOST_CLAUSES = 64, 64
#: Candidate rows that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Group whose length, in a match, must be at least so much.
    group: int = 0
    least: int = 0


#: The fixed kinds. For access and hex the least length is part of the pattern: runs are maximal, so a shorter one has no other match inside.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Well-known formats of credentials that the method adds.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^/\s:@]{1,64}:[^/\s:@]{1,64}@[A-Za-z0-9.-]+"),
)

Clauses = frozenset[frozenset[str]]
ANYTHING: Clauses = frozenset([frozenset()])


def simplest(clauses) -> Clauses:
    """Without the clauses that hold another one; ANYTHING if there are too many."""
    own = set(clauses)
    kept = frozenset(c for c in own if not any(o < c for o in own))
    return kept if len(kept) <= MOST_CLAUSES else ANYTHING


def both(left: Clauses, right: Clauses) -> Clauses:
    if len(left) * len(right) > MOST_CLAUSES**2:
        return left
    return simplest(a | b for a, b in product(left, right))


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def letters_of(node) -> frozenset[str] | None:
    """The lower-cased characters of a class, None if there are many."""
    found = set()
    for op, value in node:
        name = str(op)
        if name == "LITERAL":
            found.add(chr(value).lower())
        elif name == "RANGE" and value[1] - value[0] < 8:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return frozenset(found) if len(found) <= 8 else None


def analyse(parsed) -> tuple[frozenset[str] | None, Clauses]:
    """(the strings that a part stands for, if few; the query that any match satisfies)."""
    query, strings = ANYTHING, frozenset([""])

    def settle():
        nonlocal query, strings
        query = both(query, simplest(map(trigrams, strings)))
        strings = frozenset([""])

    exact = True
    for op, value in parsed:
        name = str(op)
        own: frozenset[str] | None = None
        more = ANYTHING
        if name == "LITERAL":
            own = frozenset([chr(value).lower()])
        elif name == "IN":
            own = letters_of(value)
        elif name == "SUBPATTERN":
            own, more = analyse(value[-1])
        elif name == "BRANCH":
            parts = [analyse(p) for p in value[1]]
            if all(p[0] is not None for p in parts):
                own = frozenset().union(*(p[0] for p in parts))
            more = simplest(c for p in parts for c in p[1])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = value
            inside, needed = analyse(inner)
            if (low, high) == (0, 1) and inside is not None:
                own = inside | {""}
            elif low == high == 1:
                own, more = inside, needed
            elif low:
                more = needed
        elif name == "AT":
            continue
        if own is not None and len(own) * len(strings) <= MOST_STRINGS:
            strings = frozenset(a + b for a, b in product(strings, own))
        else:
            settle()
            query = both(query, more)
            if own is not None:
                strings = own
            exact = False
    if exact:
        return strings, simplest(map(trigrams, strings))
    settle()
    return None, query


def trigram_query(pattern: str) -> Clauses:
    """Clauses of lower-case trigrams; ANYTHING if the pattern has no mandatory ones."""
    return analyse(regex_parser.parse(pattern))[1]


def escaped(c: str) -> str:
    return c if c.isalnum() else f"\\x{{{ord(c):x}}}"


def any_of(named: list[str]) -> str:
    """A pattern of the trigrams that shares their beginnings, so that a position is tried against few of them."""
    tree: dict[str, dict[str, list[str]]] = {}
    for x, y, z in sorted(named):
        tree.setdefault(x, {}).setdefault(y, []).append(z)

    def one(letters: list[str]) -> str:
        return f"[{''.join(escaped(c) for c in letters)}]"

    return "|".join(f"{escaped(x)}(?:{'|'.join(escaped(y) + one(z) for y, z in own.items())})" for x, own in tree.items())


def candidates(source: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """id and rules (at most one entry per rule) of the texts that satisfy a query; None if no rule has one."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) != ANYTHING}
    named = sorted(set().union(*(c for q in queries.values() for c in q))) if queries else []
    if not named:
        return None
    clauses = [(kind, k, t, len(c)) for kind, q in queries.items() for k, c in enumerate(sorted(q, key=sorted)) for t in c]
    spark = source.sparkSession
    # As large as the rules, whatever the texts.
    wanted = F.broadcast(spark.createDataFrame(clauses, "rule string, clause int, trigram string, needs int"))
    # Looked for ahead of each position, so that overlapping ones are found too.
    present = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"(?=({any_of(named)}))"), F.lit(1)))
    postings = source.select("id", F.explode(present).alias("trigram"))
    whole = postings.distinct().join(wanted, "trigram").groupBy("id", "rule", "clause", "needs").agg(F.count("*").alias("n")).where("n = needs")
    return whole.groupBy("id").agg(F.collect_set("rule").alias("rules"))


def running(items: Column, size: Column) -> Column:
    """Items of array<struct<gap, n, good>> with their starts added up: array<struct<start, stop, good>>.

    A fold that carries the list copies it at each item, so lists are folded in pieces of
    about the root of their length: first in each piece, then over the pieces' totals.
    """
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(size)).cast("int"))
    number = F.ceil(size / width).cast("int")
    kind = "array<struct<start:bigint,stop:bigint,good:boolean>>"

    def inside(piece: Column) -> Column:
        def step(state: Column, x: Column) -> Column:
            begin = state["at"] + x["gap"]
            own = F.struct(begin.alias("start"), (begin + x["n"]).alias("stop"), x["good"].alias("good"))
            return F.struct((begin + x["n"]).alias("at"), F.array_append(state["found"], own).alias("found"))

        return F.aggregate(piece, F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(kind).alias("found")), step)

    def before(state: Column, piece: Column) -> Column:
        return F.struct((state["at"] + piece["at"]).alias("at"), F.array_append(state["starts"], state["at"]).alias("starts"))

    def whole(pieces: Column) -> Column:
        starts = F.aggregate(pieces, F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("starts")), before)["starts"]
        moved = F.zip_with(pieces, starts, lambda piece, at: F.transform(piece["found"], lambda x: F.struct((x["start"] + at).alias("start"), (x["stop"] + at).alias("stop"), x["good"].alias("good"))))
        return F.flatten(moved)

    cut_up = F.transform(F.sequence(F.lit(0), number - 1), lambda k: inside(F.slice(items, k * width + 1, width)))
    return F.when(size > 0, F.transform(F.array(cut_up), whole)[0]).otherwise(F.array().cast(kind))


def spans(rule: Rule, text: Column) -> Column:
    """array<struct<start, stop>> of the rule's matches: lengths of the text between the matches and of the matches, added up."""
    pattern = F.lit(rule.pattern)
    found = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits"), F.split(text, rule.pattern, -1).alias("gaps"))
    good = (lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least) if rule.least else (lambda m: F.lit(True))

    def measured(both: Column) -> Column:
        return F.zip_with(F.slice(both["gaps"], F.lit(1), F.size(both["hits"])), both["hits"], lambda gap, hit: F.struct(F.length(gap).cast("bigint").alias("gap"), F.length(hit).cast("bigint").alias("n"), good(hit).alias("good")))

    items = F.transform(F.array(found), measured)
    added = F.transform(items, lambda x: running(x, F.size(x)))[0]
    return F.transform(F.filter(added, lambda x: x["good"]), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", more: tuple[Rule, ...] = MORE_RULES) -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256 of the fixed kinds' spans, and spans, all of them, for every row."""
    rules = (*BASE_RULES, *more)
    source = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    found = candidates(source, rules)
    if found is None:
        joined = source.withColumn("rules", F.array().cast("array<string>"))
    else:
        found = cut(found).withColumnRenamed("id", "own")
        if found.count() <= BROADCAST_ROWS:
            found = F.broadcast(found)
        joined = source.join(found, F.col("id").eqNullSafe(F.col("own")), "left").drop("own")
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    columns = []
    for rule in rules:
        scans = trigram_query(rule.pattern) == ANYTHING
        tried = F.col("text").rlike(rule.pattern) if scans else F.coalesce(F.array_contains("rules", rule.kind), F.lit(False)) & F.col("text").rlike(rule.pattern)
        columns.append(F.when(tried, spans(rule, F.col("text"))).otherwise(none).alias(rule.kind))
    matched = joined.select("id", *columns)

    def text_of(own: tuple[Rule, ...]) -> Column:
        def named(rule: Rule, k: int):
            return lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), F.concat_ws(":", F.lit(rule.kind), s["start"].cast("string"), s["stop"].cast("string")).alias("name"))

        numbered = [F.transform(r.kind, named(r, k)) for k, r in enumerate(own)]
        return F.array_join(F.transform(F.sort_array(F.concat(*numbered)), lambda x: x["name"]), ",")

    return matched.select(F.col("id").alias(id_column), *(F.size(r.kind).cast("bigint").alias(f"n_{r.kind}") for r in BASE_RULES), F.sha2(text_of(BASE_RULES), 256).alias("base_sha256"), text_of(rules).alias("spans"))
