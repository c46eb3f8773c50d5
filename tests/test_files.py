import pytest

from termloom.cli import main, parser, run
from termloom.operators.prep import numbered, prepare_amazon_esci, prepare_flipkart_titles
from termloom.operators.titles import CATEGORIES, make_titles
from termloom.sources.files import read_csv, read_documents, read_qrels, read_queries, text_source, write_qrels
from termloom.streaming.terms import running_frequencies


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def rows(frame):
    return [tuple(r) for r in frame.collect()]


def test_quotes_and_empty_cells(spark, tmp_path):
    path = put(tmp_path / "q.csv", 'query_id,query\nq1,"""human world"" NOT a"\nq2,\n')
    assert rows(read_queries(spark, path)) == [("q1", '"human world" NOT a'), ("q2", "")]


def test_documents(spark, tmp_path):
    path = put(tmp_path / "d.csv", "product_id,title\n1,a\n2,b\n")
    assert rows(read_documents(spark, path, limit=0)) == [("1", "a")]  # K19
    with pytest.raises(ValueError, match="no column"):
        read_documents(spark, path, "text")
    assert rows(text_source(spark, "x")) == [("text-1", "x")]


def test_qrels(spark, tmp_path):
    """K25"""
    esci = put(tmp_path / "e.csv", "﻿query_id, product_id ,esci_label\n# note,x,y\nq1, p1 ,e\nq1,p2,I\n")
    assert rows(read_qrels(spark, esci)) == [("q1", "p1", 3), ("q1", "p2", 0)]
    numeric = put(tmp_path / "n.csv", "query_id,doc_id,relevance\nq1,d1, 2\n")
    assert rows(read_qrels(spark, numeric)) == [("q1", "d1", 2)]
    out = str(tmp_path / "out")
    assert write_qrels(read_qrels(spark, esci), out).row_count == 2
    assert sorted(rows(read_qrels(spark, out))) == [("q1", "p1", 3), ("q1", "p2", 0)]
    bad = put(tmp_path / "b.csv", "query_id,product_id,esci_label\nq1,p1,Z\n")
    with pytest.raises(Exception, match="unknown ESCI label: Z"):
        read_qrels(spark, bad).collect()


def test_prepare_titles(spark, tmp_path):
    path = put(tmp_path / "in.csv", "sku,name\ns1, Phone \ns2,  \ns3,Case\n")
    out = str(tmp_path / "titles")
    assert prepare_flipkart_titles(spark, path, out, "name").row_count == 2
    assert rows(read_csv(spark, out)) == [("flipkart-000001", "Phone"), ("flipkart-000003", "Case")]
    prepare_flipkart_titles(spark, path, out, "name", "sku", limit=1)
    assert rows(read_csv(spark, out)) == [("s1", "Phone")]
    with pytest.raises(ValueError):
        prepare_flipkart_titles(spark, path, out, "title")


def test_prepare_esci(spark, tmp_path):
    products = put(tmp_path / "p.csv", "product_id,title,product_title\np1,,Phone\np2,Case,Other\np3,Cable,\n")
    queries = put(tmp_path / "q.csv", "query_id,query\nq1,phone\n,case\n")
    labels = put(tmp_path / "l.csv", "query_id,product_id,esci_label,label\nq1,p1,,E\nquery-000002,p2,S,\n")
    out = str(tmp_path / "esci")
    assert [p.row_count for p in prepare_amazon_esci(spark, products, queries, labels, out)] == [3, 2, 2]
    assert rows(read_csv(spark, f"{out}/queries.csv")) == [("q1", "phone"), ("query-000002", "case")]
    assert [p.row_count for p in prepare_amazon_esci(spark, products, queries, labels, out, 1)] == [1, 1, 1]
    assert rows(read_csv(spark, f"{out}/products.csv")) == [("p1", "Phone")]
    assert rows(read_csv(spark, f"{out}/relevance_labels.csv")) == [("q1", "p1", "E")]


def test_command_line(spark, tmp_path, capsys):
    table = put(tmp_path / "t.csv", "product_id,title\nd1,Samsung wireless earbuds\nd2,phone case\nd3,samsung phone\nd4,usb cable\nd5,lamp\n")
    queries = put(tmp_path / "q.csv", "query_id,query\nq1,samsung AND earbuds\n")
    qrels = put(tmp_path / "r.csv", "query_id,doc_id,relevance\nq1,d1,3\n")
    out = str(tmp_path / "index.json")

    def cli(*argv):
        run(spark, parser().parse_args(list(argv)))
        return capsys.readouterr().out

    assert "vocab_size = 8" in cli("vocab", "--csv", table)
    assert "unique_terms = 8" in cli("index", "--csv", table, "--output", out)
    assert "d1  tf=1" in cli("lookup", "--index", out, "--term", " Wireless ")
    assert "not found" in cli("lookup", "--index", out, "--term", "zzz")
    assert "1. d1" in cli("search", "--index", out, "--query", "earbuds")
    assert "No results" in cli("search", "--index", out, "--query", "non-stick")  # K12
    assert "1. d3" in cli("search-structured", "--csv", table, "--query", "samsung NOT earbuds")
    assert "queries=1" in cli("eval", "--index", out, "--qrels", qrels, "--queries", queries)
    assert "MRR: 1.0000" in cli("eval-structured", "--csv", table, "--qrels", qrels, "--queries", queries, "--per-query")
    assert main(["tokenize", "--text", "8GB RAM", "--split-numeric"]) == 0
    assert "['8', 'gb', 'ram']" in capsys.readouterr().out
    assert main([]) == 1


def test_stream(spark, tmp_path):
    spark.createDataFrame([("1", "a b a"), ("2", "b")], "doc_id string, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id string, text string").parquet(str(tmp_path / "in"))
    query = running_frequencies(stream).writeStream.outputMode("complete").format("memory").queryName("freqs").start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.table("freqs").collect()} == {("a", 1, 2), ("b", 2, 2)}


def test_command_line_with_a_parquet_index(spark, tmp_path, capsys):
    table = put(tmp_path / "t.csv", "product_id,title\nd1,Samsung wireless earbuds\nd2,phone case\nd3,samsung phone\nd4,usb cable\nd5,lamp\n")
    queries = put(tmp_path / "q.csv", "query_id,query\nq1,samsung earbuds\n")
    qrels = put(tmp_path / "r.csv", "query_id,doc_id,relevance\nq1,d1,3\nq1,d5,2\n")
    out = str(tmp_path / "index")

    def cli(*argv):
        run(spark, parser().parse_args(list(argv)))
        return capsys.readouterr().out

    assert "unique_terms = 8" in cli("index", "--csv", table, "--output", out)
    assert spark.read.parquet(f"{out}/postings").count() == 10
    assert "d1  tf=1" in cli("lookup", "--index", out, "--term", "wireless")
    assert "1. d1" in cli("search", "--index", out, "--query", "earbuds")
    assert "MRR: 1.0000" in cli("eval", "--index", out, "--qrels", qrels, "--queries", queries)
    with pytest.raises(ValueError, match="built with"):
        cli("eval", "--index", out, "--qrels", qrels, "--queries", queries, "--drop-stopwords")
    shown = cli("demo", "--csv", table, "--qrels", qrels, "--queries", queries)
    assert "q1  1. d1" in shown and "Samsung wireless earbuds" in shown and "k=5" in shown and "q1  d5  relevance=2  lamp" in shown
    assert "20 rows" in cli("make-titles", "--rows", "20", "--output", str(tmp_path / "titles"))


def test_numbers_follow_the_input(spark):
    made = numbered(spark.range(0, 1000, 1, 7).selectExpr("id * 3 AS v"))
    assert sorted((r.n, r.v) for r in made.collect()) == [(i + 1, 3 * i) for i in range(1000)]


def test_made_titles(spark):
    found = make_titles(spark, 1000).collect()
    assert len({r.product_id for r in found}) == 1000 and all(r.title.strip() for r in found)
    assert {c: sum(r.category == c for r in found) for c in CATEGORIES} == {c: 2 * share for c, (share, *_) in CATEGORIES.items()}
    assert sorted(found) == sorted(make_titles(spark, 1000).repartition(3).collect())
    assert {r.title for r in found} != {r.title for r in make_titles(spark, 1000, seed=7).collect()}
