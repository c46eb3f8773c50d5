"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pieces of a block of texts form a small corpus: one array of symbols, a gap
after each piece, and links from each symbol to its neighbours. An inverted index leads
from the pairs that have a merge to the positions in the corpus where they stand; its
lists are kept by bands of ranks, each in the order of positions. Bands are taken from the
lowest rank up. Within one, each piece's entries of its lowest rank are merged, at all
their positions at once, of overlapping ones from left to right, until the band is empty.
A merge touches its two neighbours only: the pairs that they now make enter the index, and
an entry that has changed since is passed over. Pieces share no pairs, so each sees its
merges in rank order, and no pass reads a symbol that has nothing to merge. Where merges
made at once lead to a pair of a lower rank than their own, which had to come in between,
the piece is replayed alone, one merge at a time. Ids of pieces are kept in a bounded cache
from block to block.

Null and empty texts have no tokens and the digest of no bytes; an empty table gives an
empty table. A text of any length is one text: a piece of a million letters is replayed as
a short one is. Of equal pairs in a piece the leftmost is merged first. Repeated rows give
repeated results. Further columns, whatever their names, are not read. No special token is
ever produced.
"""

from __future__ import annotations

import base64
import re
from hashlib import sha256
from heapq import heapify, heappop, heappush

import numpy as np
import regex
from pyspark.sql import DataFrame

from termloom.llm.common import arrow_map, documents, resident

#: Chunks, and pieces, whose ids a worker keeps (two generations of so many each).
CACHE_ENTRIES = 100_000
#: Texts whose pieces are replayed as one corpus, at most: besides its caches, a worker holds the pieces of one block and the arrays of one corpus.
BLOCK_ROWS = 256
#: Bytes of new pieces replayed together at most.
CORPUS_BYTES = 250_000
#: No merge: above every rank.
NONE = 1 << 40
#: The symbol after each piece; it makes no pair.
GAP = (1 << 20) - 1
#: Bands of ranks of the index, at most; the lower the ranks, the narrower.
BANDS = 128


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def first_of_each(ordered: np.ndarray) -> np.ndarray:
    """Where an array in order has a value that the one before it is not."""
    return np.r_[np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]]


class Generations:
    """A cache of two generations that is turned between blocks: what a block has asked for stays in the new one until it ends."""

    def __init__(self, entries: int):
        self.new: dict = {}
        self.old: dict = {}
        self.entries = entries

    def turn(self) -> None:
        if len(self.new) >= self.entries:
            self.old, self.new = self.new, {}

    def has(self, key) -> bool:
        """Whether the key is cached; if so, it is in the new generation from now on."""
        if key in self.new:
            return True
        if key in self.old:
            self.new[key] = self.old[key]
            return True
        return False


class MergeReplay:
    def __init__(self, path: str, pattern: str, entries: int = CACHE_ENTRIES):
        self.ranks = load_ranks(path)
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)])
        self.pieces_of = regex.compile(pattern).findall
        self.hard = regex.compile(r"(?<=\S) (?=\S)").split
        self.loose = re.compile(r" \s|\s |\A\s|\s\Z").search  # its \s holds more than that of the pieces
        pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_values = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        # The last rank of each band, and one after all.
        self.bands = np.unique(np.geomspace(1, max(self.bytes_of) + 1, BANDS).astype(np.int64))
        # The ranks of pairs of single bytes, by the bytes; 256 is the gap.
        self.first = np.full((257, 257), NONE)
        for a in range(256):
            for b in range(256):
                self.first[a, b] = self.ranks.get(bytes([a, b]), NONE)
        self.by_chunk, self.by_piece = Generations(entries), Generations(entries)

    def replay(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, little-endian."""
        done: list[bytes] = [b""] * len(pieces)
        word = []
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is None:
                word.append(i)
            else:
                done[i] = rank.to_bytes(4, "little")
        if not word:
            return done
        ends = np.cumsum([len(pieces[i]) + 1 for i in word])
        raw = np.full(int(ends[-1]), 256)
        inside = np.ones(len(raw), bool)
        inside[ends - 1] = False
        raw[inside] = np.frombuffer(b"".join([pieces[i] for i in word]), np.uint8)
        symbols, alone = self.merge_all(raw, np.repeat(np.arange(len(word)), np.diff(np.r_[0, ends])))
        alive = symbols >= 0
        bounds = np.cumsum(alive)[ends - 1] - np.arange(1, len(word) + 1)  # ids up to each piece's end
        flat = symbols[alive & (symbols != GAP)].astype("<u4").tobytes()
        at = 0
        for i, end in zip(word, (4 * bounds).tolist(), strict=True):
            done[i] = flat[at:end]
            at = end
        for k in alone.tolist():
            done[word[k]] = self.replay_alone(pieces[word[k]])
        return done

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's joined bytes, NONE if they are no token."""
        keys = left << 20 | right
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_values[at], NONE)

    def merge_all(self, raw: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of a corpus of bytes (256: a gap) after all merges, -1 where one has become part of the one before, and the pieces that have to be replayed alone."""
        n = len(raw)
        symbols = np.r_[self.single, GAP][raw]
        pair = np.r_[self.first[raw[:-1], raw[1:]], NONE]  # the rank of the pair that starts at each position
        following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        now, alone = np.zeros(owner[-1] + 1, np.int64), np.zeros(owner[-1] + 1, bool)
        index: list[list[np.ndarray]] = [[] for _ in self.bands]

        def enter(at: np.ndarray) -> None:
            if not len(at):
                return
            band = np.searchsorted(self.bands, pair[at])
            order = np.argsort(band, kind="stable")
            own, at = band[order], at[order]
            starts = np.flatnonzero(first_of_each(own))
            for k, a, b in zip(own[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(own)], strict=True):
                index[k].append(at[a:b])

        enter(np.flatnonzero(pair != NONE))
        for k, top in enumerate(self.bands.tolist()):
            entries = np.concatenate(index[k]) if index[k] else np.empty(0, np.int64)
            index[k] = []
            while len(entries):
                entries = np.sort(entries[pair[entries] <= top])
                entries = entries[first_of_each(entries) & ~alone[owner[entries]]]
                if not len(entries):
                    break
                ranks, own = pair[entries], owner[entries]
                starts = np.flatnonzero(first_of_each(own))
                lowest = np.minimum.reduceat(ranks, starts)
                now[own[starts]] = lowest
                at = entries[ranks == now[own]]
                # Equal pairs that share symbols stand in a row: every second one from the left.
                apart = np.r_[True, following[at[:-1]] != at[1:]]
                place = np.arange(len(at)) - np.maximum.accumulate(np.where(apart, np.arange(len(at)), 0))
                at = at[place % 2 == 0]
                gone = following[at]
                after = following[gone]
                symbols[at], symbols[gone], pair[gone] = pair[at], -1, NONE
                following[at], before[after] = after, at
                left = before[at]
                touched = np.concatenate([at, left[left >= 0]])
                pair[touched] = new = self.pair_ranks(symbols[touched], symbols[following[touched]])
                sooner = owner[touched[new < now[owner[touched]]]]
                if len(sooner):
                    several = owner[at[1:]][owner[at[1:]] == owner[at[:-1]]]
                    alone[np.intersect1d(sooner, several)] = True
                enter(touched[(new > top) & (new != NONE)])
                entries = np.concatenate([entries, touched[new <= top]])
        return symbols, np.flatnonzero(alone)

    def replay_alone(self, piece: bytes) -> bytes:
        """The ids of one piece, one merge at a time: the lowest rank, of equals the leftmost."""
        n = len(piece)
        symbols = self.single[np.frombuffer(piece, np.uint8)].tolist()
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def merges(key: int) -> int | None:
            at = int(np.searchsorted(self.pair_keys, key))
            return int(self.pair_values[at]) if at < len(self.pair_keys) and self.pair_keys[at] == key else None

        queue = [(rank, i) for i in range(n - 1) if (rank := merges(symbols[i] << 20 | symbols[i + 1])) is not None]
        heapify(queue)
        while queue:
            rank, at = heappop(queue)
            gone = following[at]
            if symbols[at] < 0 or gone == n or merges(symbols[at] << 20 | symbols[gone]) != rank:
                continue
            after, left = following[gone], before[at]
            symbols[at], symbols[gone], following[at] = rank, -1, after
            if after < n:
                before[after] = at
                if (new := merges(rank << 20 | symbols[after])) is not None:
                    heappush(queue, (new, at))
            if left >= 0 and (new := merges(symbols[left] << 20 | rank)) is not None:
                heappush(queue, (new, left))
        return np.array([x for x in symbols if x >= 0], "<u4").tobytes()

    def pieces_in(self, texts: list[str]) -> list[list[bytes]]:
        """The ids of the pieces of each text. Pieces that are not cached are replayed together, so many bytes at once."""
        found = [[p.encode() for p in self.pieces_of(text)] for text in texts]
        known = self.by_piece
        known.turn()
        missing = [p for p in dict.fromkeys(p for own in found for p in own) if not known.has(p)]
        start = 0
        while start < len(missing):
            end, size = start, 0
            while end < len(missing) and (end == start or size < CORPUS_BYTES):
                size += len(missing[end])
                end += 1
            known.new.update(zip(missing[start:end], self.replay(missing[start:end]), strict=True))
            start = end
        get = known.new.__getitem__
        return [list(map(get, own)) for own in found]

    def chunks(self, text: str) -> list[str]:
        """Parts that no piece crosses: cut at each single space between other characters."""
        return self.hard(text) if self.loose(text) else text.split(" ")

    def encode_block(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian 32-bit integers."""
        split = [self.chunks(t) if t else [] for t in texts]
        # A chunk stands for " " + chunk, but a text's first for itself.
        firsts = list({own[0] for own in split if own})
        rest: set[str] = set()
        for own in split:
            rest.update(own[1:])
        known = self.by_chunk
        known.turn()
        missing = [chunk for chunk in rest if not known.has(chunk)]
        texts = [*firsts, *(" " + chunk for chunk in missing)]
        ids = [b"".join(own) for own in self.pieces_in(texts)]
        of_first = dict(zip(firsts, ids))
        known.new.update(zip(missing, ids[len(firsts) :], strict=True))
        get = known.new.__getitem__
        return [b"".join([of_first[own[0]], *map(get, own[1:])]) if own else b"" for own in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def replayer(path: str, pattern: str) -> MergeReplay:
    return resident(__name__, (path, pattern), lambda: MergeReplay(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and ids (array<bigint>) of every row."""

    def make():
        bpe = replayer(path, pattern)

        def block(columns):
            return [columns[0], [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_block(columns[1])]]

        return block

    return arrow_map(documents(docs, id_column, text_column), make, [(id_column, "bigint"), ("ids", "array<bigint>")], BLOCK_ROWS)


def decode(encoded: DataFrame, path: str, pattern: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """doc_id and text of every row of ids; null ids give an empty text, bytes that are no UTF-8 the replacement character."""

    def make():
        bpe = replayer(path, pattern)

        def block(columns):
            return [columns[0], [bpe.decode(np.array(x or [], "<u4").tobytes()).decode(errors="replace") for x in columns[1]]]

        return block

    return arrow_map(encoded.select(id_column, ids_column), make, [(id_column, "bigint"), ("text", "string")])


def round_trip(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: encoded, then decoded from the ids; one narrow stage."""

    def make():
        bpe = replayer(path, pattern)

        def block(columns):
            ids = bpe.encode_block(columns[1])
            return [columns[0], [len(x) // 4 for x in ids], [sha256(x).hexdigest() for x in ids], [sha256(bpe.decode(x)).hexdigest() for x in ids]]

        return block

    schema = [(id_column, "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    return arrow_map(documents(docs, id_column, text_column), make, schema, BLOCK_ROWS)
