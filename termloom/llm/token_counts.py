"""Token counts without identifiers: heap-and-linked-list byte-pair merging.

Each pre-token starts as one symbol for each UTF-8 byte. A heap holds the adjacent
pairs that have a merge; the pair of the lowest rank is popped, its right symbol is
unlinked from a doubly linked list, and the two new neighbours enter the heap. The
number of tokens is the number of initial symbols minus the number of merges.

Null and empty texts have 0 bytes and 0 tokens; an empty table gives an empty table. Texts
and words of any length are counted whole. Of equal pairs in a pre-token the leftmost is
merged first. Repeated rows give repeated results. Further columns, whatever their names,
are not read. A special string inside a text counts as one token, as the library's default does.
"""

from __future__ import annotations

import json
import unicodedata
from heapq import heapify, heappop, heappush

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import Recent, arrow_map, documents, resident

#: Entries in each of a worker's two caches (a cache keeps up to twice as many).
CACHE_ENTRIES = 250_000

SHIFT = 20
LOW = (1 << SHIFT) - 1


def byte_characters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    own = set(printable)
    table, extra = {}, 0
    for byte in range(256):
        if byte in own:
            table[byte] = chr(byte)
        else:
            table[byte] = chr(256 + extra)
            extra += 1
    return [table[byte] for byte in range(256)]


class MergeCounter:
    """Counts the tokens of texts for a tokenizer file of lower-casing word-end BPE."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            whole = left + right
            self.merges[vocab[left] << SHIFT | vocab[right]] = rank << SHIFT | vocab[whole]
        characters = byte_characters()
        self.inner = [vocab[c] for c in characters]
        self.last = [vocab[c + end] for c in characters]
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall
        special = [x["content"] for x in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.marks = special
        self.by_piece = Recent(self.merge_count, entries)
        self.by_chunk = Recent(self.chunk_count, entries)

    def merge_count(self, piece: str) -> int:
        raw = piece.encode()
        n = len(raw)
        if n < 2:
            return n
        inner, get = self.inner, self.merges.get
        symbols = [inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        heap = []
        for i in range(n - 1):
            merge = get(symbols[i] << SHIFT | symbols[i + 1])
            if merge is not None:
                heap.append((merge >> SHIFT) << 40 | i)
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merged = 0
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFFFF
            j = after[i]
            if symbols[i] < 0 or j >= n:
                continue
            merge = get(symbols[i] << SHIFT | symbols[j])
            if merge is None or merge >> SHIFT != top >> 40:
                continue  # a pair that has changed since it entered
            whole = merge & LOW
            symbols[i], symbols[j] = whole, -1
            after[i] = k = after[j]
            merged += 1
            if k < n:
                before[k] = i
                merge = get(whole << SHIFT | symbols[k])
                if merge is not None:
                    heappush(heap, (merge >> SHIFT) << 40 | i)
            h = before[i]
            if h >= 0:
                merge = get(symbols[h] << SHIFT | whole)
                if merge is not None:
                    heappush(heap, (merge >> SHIFT) << 40 | h)
        return n - merged

    def chunk_count(self, chunk: bytes) -> int:
        by_piece = self.by_piece
        return sum([by_piece[piece] for piece in self.pieces(chunk.decode())])

    def segment_count(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower-cased one by one: no final form
        by_chunk = self.by_chunk
        total = 0
        for chunk in text.lower().encode().split():
            if len(chunk) > 256:  # long runs are not worth a place in the cache
                total += sum([self.by_piece[p] if len(p) <= 256 else self.merge_count(p) for p in self.pieces(chunk.decode())])
            else:
                total += by_chunk[chunk]
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not any(mark in text for mark in self.marks):
            return self.segment_count(text)
        segments = self.special.split(text)
        return len(segments) - 1 + sum(map(self.segment_count, segments))


def counter(path: str) -> MergeCounter:
    return resident(__name__, path, lambda: MergeCounter(path))


def token_counts(docs: DataFrame, path: str, max_tokens: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > max_tokens) of every row; a narrow plan without a shuffle."""

    def make():
        count = counter(path).count

        def block(columns):
            ids, texts = columns
            return [ids, [len(t.encode()) if t else 0 for t in texts], [count(t) for t in texts]]

        return block

    schema = [(id_column, "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint")]
    counts = arrow_map(documents(docs, id_column, text_column), make, schema)
    return counts.withColumn("over_limit", F.col("n_tokens") > F.lit(max_tokens))
