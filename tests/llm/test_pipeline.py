import corpus_pipeline
import numpy as np
import public_tokenizers as P
import tiktoken

import __spark_entry__ as entry
from tests.llm.helpers import by_id, edge_documents, no_documents, sha
from tests.llm.test_filters import contains_window, naive_verdicts
from tests.llm.test_joins import naive_components
from tests.llm.test_scans import naive_pii
from termloom.llm.byte_bpe import load_ranks
from termloom.llm.queries import VOCABULARIES


def test_queries_are_registered():
    names = list(entry.queries())
    for n in range(1, 11):
        assert any(name.startswith(f"op{n}_") for name in names)
    assert "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "pii", "byte_bpe"]


def test_stages_on_edges(spark):
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (edge_documents(spark), no_documents(spark)):
            got = stage(spark, docs, sf)
            assert got.columns == list(corpus_pipeline.COLUMNS), name
            assert got.count() <= docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, no_documents(spark), sf).count() == 0


def naively_masked(text):
    """Each span of the fixed patterns, overlapping ones as one, replaced by the kind that starts first."""
    spans = sorted((a, b, kind) for kind, found in naive_pii(text).items() for a, b in found)
    out, at = "", 0
    for a, b, kind in spans:
        if a >= at:
            out += text[at:a] + f"[{kind.upper()}]"
        at = max(at, b)
    return out + text[at:]


def test_run_equals_its_stages_by_hand(spark):
    """Every stage by a plain version, on the tables and on near copies, benchmark passages and personal data among them."""
    sf = "/root/testdata/sf0.001"
    got = by_id(corpus_pipeline.run(spark, sf))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: (r.text, r.lang) for r in docs.collect()}
    verdicts = naive_verdicts(texts, [P.path(name) for name in VOCABULARIES])
    texts = {i: t for i, (t, _) in texts.items() if verdicts[i][0]}
    texts = {i: texts[i] for i, (_, c) in naive_components(texts, 5, 80).items() if c == i}
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(got) == {i for i, t in texts.items() if not contains_window(t, items)}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    masked = 0
    for i, row in got.items():
        text = naively_masked(texts[i])
        masked += text != texts[i]
        ids = lib.encode_ordinary(text)
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text))
    assert masked
