import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.functions.text import TokenizerConfig, normalized_text, stem, term_counts, tokenize, tokenize_documents, tokens

CONFIGS = [TokenizerConfig(), TokenizerConfig(lowercase=False), TokenizerConfig(True, True, True, True, "suffix"), TokenizerConfig(split_numeric_boundaries=True), TokenizerConfig(stemming="suffix")]
TEXTS = ["HP Laptop", "café", "café", "naïve ﬁ Foo™ ½ ８ＧＢ ＆ co", "A&B", "8GB RAM 16GB", "non-stick pan/lid (2) C++ it's", "", "İstanbul 한글 aͅb", "free ball 1000 100 2011", "running runs runners shoes class movies", "a_b|c"]


def column(spark, texts, make):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r[1] for r in rows.select("i", make(F.col("text")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize("config", CONFIGS)
def test_column_and_twin_agree(spark, config):
    assert column(spark, TEXTS, lambda c: tokens(c, config)) == [tokenize(t, config) for t in TEXTS]


def test_k1_capitals_are_dropped_without_lowercasing():
    assert tokenize("HP Laptop", TokenizerConfig(lowercase=False)) == ["aptop"]


def test_k2_letters_beyond_ascii_separate():
    assert tokenize("café naïve") == ["caf", "na", "ve"]
    assert tokenize("café", TokenizerConfig(strip_accents=True)) == ["cafe"]


def test_k3_compatibility_characters_are_composed():
    assert tokenize("Foo™ ½ café") == ["footm", "1", "2", "caf"]


def test_k4_ampersand_is_a_word():
    assert tokenize("A&B") == ["a", "and", "b"]
    assert tokenize("A&B", TokenizerConfig(drop_stopwords=True)) == ["b"]


def test_k5_k6_stemmer(spark):
    words = {"free": "fre", "ball": "bal", "1000": "100", "2011": "201", "100": "100", "being": "being", "using": "using", "sing": "sing", "ties": "tie", "movies": "movy", "tees": "tees", "running": "run", "runners": "run", "runs": "run", "shoes": "sho", "class": "clas", "companies": "company"}
    assert column(spark, list(words), stem) == list(words.values())
    assert [tokenize(w, TokenizerConfig(stemming="suffix"))[0] for w in words] == list(words.values())


def test_normalized_text(spark):
    got = column(spark, ["8GB  (A&B) café!", "  x-y_z  ", None], lambda c: normalized_text(c, TokenizerConfig(split_numeric_boundaries=True)))
    assert got == ["8 gb a and b café", "x y z", None]


def test_unknown_stemming_is_refused():
    with pytest.raises(ValueError):
        TokenizerConfig(stemming="porter")


def test_documents_and_counts(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None)], "doc_id int, text string")
    got = tokenize_documents(docs)
    assert [(r.doc_id, r.token_count) for r in got.orderBy("doc_id").collect()] == [("1", 3), ("2", 0)]
    assert {(r.doc_id, r.term, r.tf) for r in term_counts(got).collect()} == {("1", "a", 2), ("1", "b", 1)}


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_tokens_are_deterministic_and_plain(text):
    got = tokenize(text, TokenizerConfig(True, True, True, False, "suffix"))
    assert got == tokenize(text, TokenizerConfig(True, True, True, False, "suffix"))
    assert all(t and t.isascii() and t.isalnum() and t == t.lower() for t in got)
