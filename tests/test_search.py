import math
import random
import time

import pytest

from termloom.functions.text import TokenizerConfig
from termloom.operators.index import SearchIndex, build_index, hapax_ratio, index_summary, load_index, lookup, most_frequent, stored, vocabulary, vocabulary_summary
from termloom.operators.ranking import ScorerConfig, idf_of, parameter_grid, search, search_batch, term_scores
from termloom.operators.structured import retrieve, search_structured, search_structured_batch
from termloom.plans.query import AndNode, NearNode, NotNode, OrNode, PhraseNode, QueryParseError, TermNode, parse_query, terms_of
from termloom.sources.files import read_index_json, write_index_json

DOCS = [("d1", "Samsung wireless earbuds with case"), ("d2", "wireless headphones long cable earbuds"), ("d3", "wireless wireless charging pad earbuds"), ("d4", "phone case Samsung"), ("d5", "Samsung phone")]


@pytest.fixture(scope="module")
def index(spark):
    built = build_index(spark.createDataFrame(DOCS, "doc_id string, text string"))
    return SearchIndex(built.postings.cache(), built.doc_lengths.cache(), built.config)


@pytest.fixture(scope="module")
def small(spark):
    """Four documents of three terms each: N = 4, 12 terms."""
    postings = [("samsung", "d1", 2), ("phone", "d1", 1), ("case", "d2", 1), ("case", "d1", 0), ("phone", "d2", 2), ("phone", "d3", 3), ("case", "d4", 3)]
    rows = [p for p in postings if p[2]]
    lengths = [(f"d{i}", 3) for i in range(1, 5)]
    return SearchIndex(spark.createDataFrame([(*p, None) for p in rows], "term string, doc_id string, tf bigint, positions array<int>"), spark.createDataFrame(lengths, "doc_id string, dl bigint"))


def ids(found):
    return [r.doc_id for r in found.orderBy("rank").collect()]


def matches(index, text):
    return {r.doc_id for r in retrieve(parse_query(text), index).collect()}


def test_positions(spark):
    built = build_index(spark.createDataFrame([("x", "Wireless earbuds with wireless charging case")], "doc_id string, text string"))
    assert {r.term: (r.tf, r.positions) for r in built.postings.collect()}["wireless"] == (2, [0, 3])


def test_empty_documents_count(spark):
    """K8"""
    built = build_index(spark.createDataFrame([("a", "x y"), ("b", ""), ("c", None)], "doc_id string, text string"))
    row = built.stats().first()
    assert (row.document_count, row.total_terms, round(row.avgdl, 4)) == (3, 2, 0.6667)
    assert {r.doc_id for r in retrieve(parse_query("NOT x"), built).collect()} == {"b", "c"}


def test_empty_corpus(spark):
    built = build_index(spark.createDataFrame([], "doc_id string, text string"))
    assert built.stats().first().asDict() == {"document_count": 0, "total_terms": 0, "avgdl": 0.0}
    assert search(["x"], built).count() == 0
    assert hapax_ratio(built).first()[0] == 0.0


def test_duplicate_ids_are_refused(spark):
    """K9"""
    with pytest.raises(ValueError, match="more than once"):
        build_index(spark.createDataFrame([("a", "x"), ("a", "y")], "doc_id string, text string"))


def test_vocabulary(index):
    rows = vocabulary(index).orderBy("token_id").collect()
    assert [r.token for r in rows] == sorted(r.token for r in rows)
    assert [r.token_id for r in rows] == list(range(1, len(rows) + 1))
    assert {r.token: (r.df, r.cf) for r in rows}["wireless"] == (3, 4)
    assert vocabulary_summary(index).first().vocab_size == len(rows)
    assert index_summary(index).first().documents == 5
    assert most_frequent(index, 1).first().term == "wireless"


def test_lookup(index):
    assert [(r.doc_id, r.tf) for r in lookup(index, "wireless").collect()] == [("d1", 1), ("d2", 1), ("d3", 2)]
    assert lookup(index, "nothing").count() == 0


def test_save_and_load(index, spark, tmp_path):
    """K20"""
    path = str(tmp_path / "index")
    index.save(path)
    loaded = load_index(spark, path, TokenizerConfig())
    assert ids(search(["samsung"], loaded)) == ids(search(["samsung"], index))
    with pytest.raises(ValueError, match="built with"):
        load_index(spark, path, TokenizerConfig(stemming="suffix"))


def test_json_round_trip(index, spark, tmp_path):
    path = str(tmp_path / "index.json")
    write_index_json(index, path)
    loaded = read_index_json(spark, path)
    assert loaded.stats().first() == index.stats().first()
    assert {tuple(r) for r in loaded.postings.select("term", "doc_id", "tf").collect()} == {tuple(r) for r in index.postings.select("term", "doc_id", "tf").collect()}


def test_idf_values(small):
    got = {r.term: r.idf for r in idf_of(small, ["samsung", "case", "phone", "none"]).collect()}
    assert got["samsung"] == pytest.approx(math.log(3.5 / 1.5))
    assert got["case"] == pytest.approx(0.0)
    assert got["phone"] < 0  # K7
    assert got["none"] == 0.0


def test_bm25_value(small):
    got = {r.doc_id: r.score for r in term_scores(small, ["samsung"]).collect()}
    tf, k1 = 2, 1.2
    assert got == {"d1": pytest.approx(math.log(3.5 / 1.5) * tf * (k1 + 1) / (tf + k1))}


def test_negative_scores_stay(small):
    """K7"""
    rows = search(["phone"], small).collect()
    assert len(rows) == 3 and all(r.score < 0 for r in rows)


def test_repeated_terms_count_again(index):
    one = {r.doc_id: r.score for r in search(["phone"], index).collect()}
    two = {r.doc_id: r.score for r in search(["phone", "phone"], index).collect()}
    assert two == {d: pytest.approx(2 * s) for d, s in one.items()}


def test_ties_by_id_and_limits(spark):
    built = build_index(spark.createDataFrame([("b-doc", "x q"), ("a-doc", "x r"), ("c", "z z"), ("d", "z y")], "doc_id string, text string"))
    assert ids(search(["x"], built)) == ["a-doc", "b-doc"]
    assert search(["x"], built, top_k=0).count() == 0
    with pytest.raises(ValueError):
        search(["x"], built, top_k=-1)


def test_saturation_and_length(spark):
    docs = [("one", "x a b c"), ("two", "x x b c"), ("four", "x x x x"), *((f"n{i}", "q r s t") for i in range(9))]
    built = build_index(spark.createDataFrame(docs, "doc_id string, text string"))
    s = {r.doc_id: r.score for r in search(["x"], built).collect()}
    assert s["two"] - s["one"] > (s["four"] - s["two"]) / 2 > 0
    long = build_index(spark.createDataFrame([("short", "x a"), ("long", "x a b c d e f g"), *((f"n{i}", "q r s") for i in range(6))], "doc_id string, text string"))
    assert ids(search(["x"], long)) == ["short", "long"]
    flat = {r.score for r in search(["x"], long, ScorerConfig(b=0.0)).collect()}
    assert len(flat) == 1


def test_batch_equals_single(index, spark):
    queries = {"q1": "samsung case", "q2": "wireless earbuds earbuds", "q3": "absent"}
    batch = search_batch(spark.createDataFrame(list(queries.items()), "query_id string, query string"), index).collect()
    for q, text in queries.items():
        own = [(r["rank"], r.doc_id, round(r.score, 9)) for r in sorted(batch, key=lambda r: r["rank"]) if r.query_id == q]
        assert own == [(r["rank"], r.doc_id, round(r.score, 9)) for r in search(text.split(), index).orderBy("rank").collect()]


def test_parameter_grid(index, spark):
    queries = spark.createDataFrame([("q", "samsung case")], "query_id string, query string")
    rows = parameter_grid(queries, index, [1.2, 2.0], [0.75]).collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: r["rank"]) if r.k1 == 1.2] == ids(search(["samsung", "case"], index))


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("a", TermNode("a")),
        ("a b OR c", OrNode(AndNode(TermNode("a"), TermNode("b")), TermNode("c"))),
        ("a OR b AND c", OrNode(TermNode("a"), AndNode(TermNode("b"), TermNode("c")))),
        ("(a OR b) c", AndNode(OrNode(TermNode("a"), TermNode("b")), TermNode("c"))),
        ("phone NOT case", AndNode(TermNode("phone"), NotNode(TermNode("case")))),
        ('"Wireless Earbuds"', PhraseNode(("wireless", "earbuds"))),
        ("a NEAR/3 b", NearNode("a", "b", 3)),
        ("NOT NOT a", NotNode(NotNode(TermNode("a")))),
        ("a OR b OR c", OrNode(OrNode(TermNode("a"), TermNode("b")), TermNode("c"))),
        ("ANDROID", TermNode("android")),
    ],
)
def test_parser(text, tree):
    assert parse_query(text) == tree


@pytest.mark.parametrize("text", ["", "  ", '"a', '"', 'abc"def"', "(a", "a)", "AND a", "a AND", "NOT", "a NEAR/0 b", 'a NEAR/2 "b c"', "a NEAR/2 b NEAR/3 c", "a NEAR/3x b", "non-stick", '""', "NEAR/2 a"])
def test_parser_errors(text):
    """K17"""
    with pytest.raises(QueryParseError):
        parse_query(text)


def test_terms_of_keeps_order_and_negated_terms():
    assert terms_of(parse_query('b "a b" NOT c d NEAR/2 b')) == ["b", "a", "b", "c", "d", "b"]


def test_boolean(index):
    assert matches(index, "samsung AND phone") == {"d4", "d5"}
    assert matches(index, "cable OR pad") == {"d2", "d3"}
    assert matches(index, "NOT wireless") == {"d4", "d5"}
    assert matches(index, "samsung AND phone NOT case") == {"d5"}
    assert matches(index, "(cable OR pad) AND NOT (charging OR phone)") == {"d2"}


def test_phrases_and_proximity(index):
    assert matches(index, '"wireless earbuds"') == {"d1"}
    assert matches(index, '"wireless wireless charging"') == {"d3"}
    assert matches(index, '"earbuds wireless"') == set()
    assert matches(index, "wireless NEAR/2 earbuds") == {"d1"}
    assert matches(index, "earbuds NEAR/3 wireless") == {"d1", "d3"}
    assert matches(index, "phone NEAR/1 phone") == {"d4", "d5"}  # K16


def test_phrase_over_a_removed_stopword(spark):
    """K18"""
    config = TokenizerConfig(drop_stopwords=True)
    built = build_index(spark.createDataFrame([("a", "king of spain")], "doc_id string, text string"), config=config)
    assert retrieve(parse_query('"king spain"', config), built).count() == 1


def test_structured_search(index):
    assert ids(search_structured('"wireless earbuds"', index)) == ["d1"]
    assert ids(search_structured("samsung AND phone NOT case", index)) == ["d5"]
    assert search_structured("   ", index).count() == 0
    assert ids(search_structured("cable pad", index)) == ids(search(["cable", "pad"], index))  # K14
    # K10: d4 and d5 satisfy the tree without a term of the query; K11: terms below NOT count
    assert set(ids(search_structured("cable OR NOT wireless", index))) == {"d2"}


@pytest.mark.parametrize("text", ["NOT a", "(NOT a)", "NOT NOT a"])
def test_negative_queries_are_refused(index, text):
    """K15"""
    with pytest.raises(QueryParseError):
        search_structured(text, index)


def test_two_negations_find_nothing(index):
    assert search_structured("NOT wireless AND NOT cable", index).count() == 0


def test_structured_batch(index):
    pairs = [("q1", '"wireless earbuds"'), ("q2", "cable pad"), ("q3", "samsung NOT case"), ("q4", " ")]
    rows = search_structured_batch(pairs, index, chunk=1).collect()
    for q, text in pairs:
        assert [r.doc_id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == q] == ids(search_structured(text, index))
    with pytest.raises(QueryParseError):  # K27
        search_structured_batch([*pairs, ("bad", "(a")], index)


def test_operator_words_are_terms_of_a_plain_query(index, spark):
    """K13"""
    from termloom.operators.ranking import query_terms

    queries = spark.createDataFrame([("q", "crime AND family NEAR/3 x")], "query_id string, query string")
    assert {(r.term, r.qtf) for r in query_terms(queries, index).collect()} == {(t, 1) for t in ("crime", "and", "family", "near", "3", "x")}


def test_ranks_ignore_noise_beyond_nine_decimals(spark):
    """K26"""
    from termloom.operators.ranking import ranked

    scores = spark.createDataFrame([("q", "b", 0.1 + 0.2), ("q", "a", 0.3)], "query_id string, doc_id string, score double")
    assert [r.doc_id for r in ranked(scores, 2).orderBy("rank").collect()] == ["a", "b"]


def test_proximity_equals_brute_force(spark):
    r = random.Random(8)
    docs = [(f"d{i}", " ".join(r.choices("a b c d e".split(), k=r.randint(0, 30)))) for i in range(60)]
    index = build_index(spark.createDataFrame(docs, "doc_id string, text string"))
    for text, holds in (
        ("a NEAR/2 b", lambda w: any(x == "a" and y == "b" and abs(i - j) <= 2 for i, x in enumerate(w) for j, y in enumerate(w))),
        ("c NEAR/1 c", lambda w: "c" in w),
        ('"a b a"', lambda w: any(w[i : i + 3] == ["a", "b", "a"] for i in range(len(w)))),
        ('"e"', lambda w: "e" in w),
    ):
        assert {x.doc_id for x in retrieve(parse_query(text), index).collect()} == {i for i, t in docs if holds(t.split())}, text


def test_proximity_of_frequent_terms_is_linear(spark):
    text = " ".join(["a"] * 60_000 + ["x"] * 10 + ["b"] * 60_000)
    index = build_index(spark.createDataFrame([("d", text)], "doc_id string, text string"))
    began = time.perf_counter()
    assert retrieve(parse_query("a NEAR/11 b"), index).count() == 1
    assert retrieve(parse_query("a NEAR/10 b"), index).count() == 0
    assert retrieve(parse_query('"a b"'), index).count() == 0
    assert time.perf_counter() - began < 60


def test_a_stored_index_ranks_as_a_lazy_one(spark):
    docs = spark.createDataFrame([("1", "a b a"), ("2", "b c"), ("3", ""), ("4", "c a")], "doc_id string, text string")
    lazy = build_index(docs)
    queries = spark.createDataFrame([("q", "a c"), ("r", "b b")], "query_id string, query string")
    for positions in (True, False):
        kept = stored(lazy, positions)
        assert kept.stats().first() == lazy.stats().first()
        assert sorted(kept.terms().collect()) == sorted(lazy.terms().collect())
        assert sorted(kept.doc_lengths.collect()) == sorted(lazy.doc_lengths.collect())
        assert sorted(search_batch(queries, kept).collect()) == sorted(search_batch(queries, lazy).collect())
