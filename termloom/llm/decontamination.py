"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of words of a benchmark item. Patterns of one length make a
search of their own: a shift table over blocks of two adjacent words (one for patterns
of one word) tells how far the search may move on from a block, the blocks that end a
pattern lead to a bucket keyed by that suffix, and the words of each test pattern there
are compared directly.

A benchmark of up to ``slice_bytes`` of text is broadcast whole. Of a larger one only
the shift tables are, in a fixed number of places that blocks share by their hash (a place
has the least shift of its blocks, so no occurrence is passed over). Windows of documents
that end at a block without a shift meet the patterns in a join on their hash, which can be
split where a window is frequent, and are compared there word by word. The result is the
same either way.

Null and empty texts have no words and no hits; null and empty items have no windows.
Repeated items count once per item_id; repeated documents are judged alike. With an
empty benchmark nothing is hit; an empty table of documents gives an empty table. Texts of
any length are searched whole. Occurrences may overlap: a word inside of any is hit once.
Items without an id are counted under the name "null". Further columns of either table,
whatever their names, are not read.
"""

from __future__ import annotations

from collections import defaultdict
from hashlib import sha256

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import arrow_map, cut, documents, resident

#: Bytes of benchmark text that may be broadcast; of a larger one no text is.
SLICE_BYTES = 8_000_000
#: Places of a shift table that is broadcast instead of a larger benchmark (a byte each).
PLACES = 1 << 22


def word_table() -> bytes:
    """ASCII outside digits and letters becomes a space, A-Z become a-z, the rest stays."""
    out = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        out[b] = ord(c.lower()) if c.isalnum() else 0x20
    return bytes(out)


TABLE = word_table()


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(TABLE).split() if text else []


class Search:
    """Shift and suffix tables of the patterns of one length."""

    def __init__(self, patterns: dict[tuple[int, ...], list[str]], length: int):
        self.length, self.block = length, min(2, length)
        self.default = length - self.block + 1
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, list[tuple[list[int], list[str]]]] = defaultdict(list)
        for pattern, items in patterns.items():
            for end in range(self.block - 1, length):
                key = self.key(pattern, end)
                self.shift[key] = min(self.shift.get(key, self.default), length - 1 - end)
            self.buckets[self.key(pattern, length - 1)].append((list(pattern), items))
        self.buckets = dict(self.buckets)

    def key(self, words, end: int) -> int:
        return words[end - 1] << 32 | words[end] if self.block == 2 else words[end]

    def run(self, words: list[int], hit: bytearray, items: set[str]) -> None:
        n, m, pair = len(words), self.length, self.block == 2
        shift, default, buckets = self.shift.get, self.default, self.buckets
        mark = b"\1" * m
        i = m - 1
        while i < n:
            key = words[i - 1] << 32 | words[i] if pair else words[i]
            step = shift(key, default)
            if step:
                i += step
                continue
            own = words[i - m + 1 : i + 1]
            for pattern, names in buckets[key]:
                if own == pattern:
                    hit[i - m + 1 : i + 1] = mark
                    items.update(names)
            i += 1


class WuManber:
    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.known: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
        for name, text in items:
            ids = [self.known.setdefault(w, len(self.known) + 1) for w in words_of(text)]
            m = min(window, len(ids))
            for i in range(len(ids) - m + 1 if m else 0):
                by_length[m][tuple(ids[i : i + m])].add(name)
        self.searches = [Search({p: sorted(n) for p, n in own.items()}, m) for m, own in sorted(by_length.items())]

    def find(self, words: list[bytes], hit: bytearray, items: set[str]) -> None:
        if not self.searches:
            return
        get = self.known.get
        ids = [get(w, 0) for w in words]
        for search in self.searches:
            search.run(ids, hit, items)


def tables(key: str, load) -> WuManber:
    return resident(__name__, key, lambda: WuManber(*load()))


def items_of(benchmark: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return benchmark.select(F.coalesce(F.col(id_column).cast("string"), F.lit("null")).alias("item"), F.col(text_column).cast("string").alias("text")).where(F.col("text").isNotNull())


SCHEMA = (("n_words", "bigint"), ("n_hit", "bigint"), ("n_items", "bigint"), ("items_sha256", "string"), ("contaminated", "boolean"))


def judged(n_words: int, n_hit: int, items) -> tuple:
    return n_words, n_hit, len(items), sha256(",".join(sorted(items)).encode()).hexdigest(), n_hit > 0


def by_broadcast(source: DataFrame, items: DataFrame, window: int, id_column: str) -> DataFrame:
    """One narrow stage over the documents; the items pass through the driver."""
    rows = sorted((r.item, r.text) for r in items.collect())
    key = sha256(repr((rows, window)).encode()).hexdigest()
    shared = source.sparkSession.sparkContext.broadcast((rows, window))

    def make():
        def block(columns):
            search = tables(key, lambda: shared.value)
            rows = []
            for text in columns[1]:
                words = words_of(text)
                hit, found = bytearray(len(words)), set()
                search.find(words, hit, found)
                rows.append(judged(len(words), sum(hit), found))
            return [columns[0], *(map(list, zip(*rows, strict=True)) if rows else [[]] * len(SCHEMA))]

        return block

    return arrow_map(source, make, [(id_column, "bigint"), *SCHEMA])


def place_of(words: list[bytes], size: int) -> int:
    """The place of a block in the shift table of patterns of so many words."""
    return xxhash.xxh64_intdigest(b" ".join(words), seed=size) % PLACES


def windows_of(items: DataFrame, window: int) -> DataFrame:
    """size (words), words and item of every pattern."""

    def make():
        def block(columns):
            rows = []
            for item, text in zip(*columns, strict=True):
                words = words_of(text)
                m = min(window, len(words))
                rows += [(m, b" ".join(words[i : i + m]), item) for i in range(len(words) - m + 1 if m else 0)]
            return list(map(list, zip(*rows, strict=True))) if rows else [[]] * 3

        return block

    return arrow_map(items, make, [("size", "int"), ("words", "binary"), ("item", "string")]).distinct()


def shift_tables(patterns: DataFrame) -> dict[int, np.ndarray]:
    """For each length of patterns the shift of each place: a bounded number of rows of the aggregation reaches the driver."""

    def make():
        def block(columns):
            rows = {}
            for size, words in zip(*columns, strict=True):
                own = words.split(b" ")
                b = min(2, size)
                for end in range(b, size + 1):
                    key = size, place_of(own[end - b : end], size)
                    rows[key] = min(rows.get(key, size), size - end)
            return [[m for m, _ in rows], [p for _, p in rows], list(rows.values())]

        return block

    placed = arrow_map(patterns.select("size", "words"), make, [("size", "int"), ("place", "int"), ("shift", "int")])
    found = {}
    for row in placed.groupBy("size", "place").agg(F.min("shift").alias("shift")).toLocalIterator():
        if row.size not in found:
            found[row.size] = np.full(PLACES, row.size - min(2, row.size) + 1, np.uint8)
        found[row.size][row.place] = row.shift
    return found


def by_join(source: DataFrame, items: DataFrame, window: int, id_column: str) -> DataFrame:
    """Windows that the shift tables let through meet the patterns in a join; hits are gathered by document."""
    patterns = cut(windows_of(items, window))
    shared = source.sparkSession.sparkContext.broadcast({m: t.tobytes() for m, t in shift_tables(patterns).items()})
    # Rows of one id and one text are hit alike.
    keyed = source.select("id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "text")

    def counts():
        return lambda columns: [columns[0], columns[1], [len(words_of(t)) for t in columns[2]]]

    counted = arrow_map(keyed, counts, [("id", "bigint"), ("digest", "string"), ("n_words", "bigint")])

    def make():
        tables = {m: np.frombuffer(t, np.uint8) for m, t in shared.value.items()}

        def block(columns):
            rows = []
            for key, digest, text in zip(*columns, strict=True):
                words = words_of(text)
                for m, table in tables.items():
                    i, b = m, min(2, m)
                    while i <= len(words):
                        shift = int(table[place_of(words[i - b : i], m)])
                        if not shift:
                            rows.append((key, digest, i - m, m, b" ".join(words[i - m : i])))
                        i += shift or 1
            return list(map(list, zip(*rows, strict=True))) if rows else [[]] * 5

        return block

    candidates = arrow_map(keyed, make, [("id", "bigint"), ("digest", "string"), ("start", "int"), ("size", "int"), ("words", "binary")])
    hashed = lambda frame: frame.withColumn("hash", F.xxhash64("size", "words"))
    met = hashed(candidates).join(hashed(patterns), ["hash", "size", "words"])
    found = cut(met.groupBy("id", "digest").agg(F.collect_set(F.struct("start", "size")).alias("at"), F.collect_set("item").alias("items")))
    joined = counted.join(found.withColumnRenamed("id", "own").withColumnRenamed("digest", "of"), F.col("id").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("of")), "left")

    def verdicts():
        def block(columns):
            rows = []
            for n_words, at, items in zip(*columns[1:], strict=True):
                n_hit, end = 0, 0
                for start, size in sorted((x["start"], x["size"]) for x in at or ()):
                    n_hit += max(0, start + size - max(start, end))
                    end = max(end, start + size)
                rows.append(judged(n_words, n_hit, items or ()))
            return [columns[0], *(map(list, zip(*rows, strict=True)) if rows else [[]] * len(SCHEMA))]

        return block

    return arrow_map(joined.select("id", "n_words", "at", "items"), verdicts, [(id_column, "bigint"), *SCHEMA])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row."""
    items = items_of(benchmark, item_column, item_text_column)
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    return (by_broadcast if size <= slice_bytes else by_join)(documents(docs, id_column, text_column), items, window, id_column)
