import base64
import random
import time
import tracemalloc

import numpy as np
import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from tests.llm.helpers import EDGES, by_id, documents, edge_documents, no_documents, sha
from termloom.llm import byte_bpe
from termloom.llm.byte_bpe import MergeReplay, decode, encode, load_ranks, round_trip
from termloom.llm.token_counts import MergeCounter, token_counts

COUNTS, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
ALPHABET = [chr(c) for c in [*range(1, 0x250), 0x1C, 0x20, 0x20, 0x20, 0x2028, 0x3000, 0x85, 0xA0, 0x301, 0x308, 0x4E2D, 0x1F600, 0x10A]]


def random_texts(n):
    r = random.Random(7)
    return ["".join(r.choices(ALPHABET, k=r.randint(1, 60))) for _ in range(n)] + ["".join(r.choices("the aing tion  \n", k=r.randint(1, 80))) for _ in range(n)]


def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(RANKS), special_tokens={})


def test_counts_equal_the_library():
    texts = [t for t in EDGES if t] + random_texts(600) + ["Σας ΣΑΣ", "<|startoftext|>a<|ENDOFTEXT|>"]
    own = MergeCounter(COUNTS, entries=50)  # a small cache turns over
    assert [own.count(t) for t in texts] == [len(e.ids) for e in Tokenizer.from_file(COUNTS).encode_batch(texts, add_special_tokens=False)]


def test_token_counts(spark):
    got = by_id(token_counts(edge_documents(spark), COUNTS))
    lib = Tokenizer.from_file(COUNTS)
    for i, t in enumerate(EDGES):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 2048)
    assert token_counts(edge_documents(spark), COUNTS).count() == len(EDGES) + 2
    assert token_counts(no_documents(spark), COUNTS).count() == 0


def test_replay_equals_the_library():
    texts = [t for t in EDGES if t] + random_texts(600)
    own, lib = MergeReplay(RANKS, P.PATTERN, entries=100), library()
    for start in range(0, len(texts), 50):
        block = texts[start : start + 50]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_block(block)] == [lib.encode_ordinary(t) for t in block]


def test_long_pieces_are_replayed_in_proportion():
    own, lib, r = MergeReplay(RANKS, P.PATTERN), library(), random.Random(3)
    for n in (100_000, 1_000_000):
        for text in ("a" * n, "=" * n, "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n))):
            began = time.perf_counter()
            ids = own.encode_block([text])[0]
            assert time.perf_counter() - began < 30
            assert own.decode(ids) == text.encode()
            if n == 100_000:
                assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(text)


def test_replay_with_a_merge_that_makes_a_lower_one(tmp_path):
    """Ranks whose parts come later than the whole: the order of merges inside a word decides."""
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"bc", b"cab", b"ca", b"bcab"]
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    own = MergeReplay(str(path), r"\S+|\s+")
    lib = tiktoken.Encoding("x", pat_str=r"\S+|\s+", mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    r = random.Random(1)
    for _ in range(500):
        text = "".join(r.choices("abc", k=r.randint(1, 14)))
        assert np.frombuffer(own.encode_block([text])[0], "<u4").tolist() == lib.encode_ordinary(text)


def test_round_trip(spark):
    got, lib = by_id(round_trip(edge_documents(spark), RANKS, P.PATTERN)), library()
    for i, t in enumerate(EDGES):
        ids = lib.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t or ""))
    assert round_trip(no_documents(spark), RANKS, P.PATTERN).count() == 0


def test_encode_and_decode(spark):
    docs = documents(spark, ["hello world", None, "é😀 "])
    back = by_id(decode(encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN))
    assert [back[i].text for i in range(3)] == ["hello world", "", "é😀 "]


def test_a_worker_holds_one_block_and_one_corpus_besides_its_caches():
    """Peak memory over 1,024 texts of words that are all different: the pieces and arrays of all of them at once took a worker too much."""
    r = random.Random(5)
    texts = [" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(100)) for _ in range(1024)]
    own = MergeReplay(RANKS, P.PATTERN, entries=1000)
    tracemalloc.start()
    for start in range(0, len(texts), byte_bpe.BLOCK_ROWS):
        own.encode_block(texts[start : start + byte_bpe.BLOCK_ROWS])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6, peak
