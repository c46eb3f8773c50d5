"""The queries of the engine over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.text import STOPWORDS, SUFFIXES, TokenizerConfig, lookup_form, normalized_text, search_form, term_counts, tokenize_documents
from termloom.operators.evaluation import demo, evaluate
from termloom.operators.index import SearchIndex, build_index, hapax_ratio, index_summary, lookup, most_frequent, stored, vocabulary, vocabulary_summary
from termloom.operators.prep import prepare_esci, prepare_titles
from termloom.operators.ranking import ScorerConfig, idf_of, parameter_grid, search, search_batch, term_scores
from termloom.operators.structured import retrieve, search_structured, search_structured_batch, structured_tree
from termloom.operators.titles import CATEGORIES, make_titles
from termloom.plans.query import QueryParseError, parse_query
from termloom.runtime import work_path
from termloom.sources.files import esci_grade, read_csv, read_documents, read_index_json, read_qrels, read_queries, text_source, write_csv, write_index_json, write_qrels

Query = Callable[[SparkSession, str], DataFrame]

CONFIGS = {
    "default": TokenizerConfig(),
    "nolower": TokenizerConfig(lowercase=False),
    "stop": TokenizerConfig(drop_stopwords=True),
    "split": TokenizerConfig(split_numeric_boundaries=True),
    "stem": TokenizerConfig(stemming="suffix"),
    "accents": TokenizerConfig(strip_accents=True),
    "all": TokenizerConfig(True, True, True, True, "suffix"),
}
QUERIES = {"q1": "the thing of en", "q2": "trash worthless", "q3": "ononst ereden the", "q4": "zzzz"}
STRUCTURED = {"s1": "trash AND worthless", "s2": '"of the" NOT stupid', "s3": "trash NEAR/20 stupid OR ononst", "s4": "clown scum"}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("doc_id"), "text")


def index_of(spark: SparkSession, sf_dir: str, config: str = "default") -> SearchIndex:
    return build_index(documents(spark, sf_dir), config=CONFIGS[config], check_ids=False)


def stored_index_of(spark: SparkSession, sf_dir: str, config: str = "default", positions: bool = True) -> SearchIndex:
    """For tables of queries: built and saved, so that texts are tokenised once. For one query of few terms a lazy index is faster: only their postings are shuffled."""
    return stored(index_of(spark, sf_dir, config), positions)


def table_of(spark: SparkSession, queries: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(queries.items()), "query_id string, query string")


def rounded(found: DataFrame) -> DataFrame:
    return found.withColumn("score", F.round("score", 6))


# Text


def tokens_by(config: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokenize_documents(documents(spark, sf_dir), config=CONFIGS[config])
    return found.select("doc_id", F.array_join("tokens", " ").alias("tokens"), "token_count")


def normalized(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", normalized_text(F.col("text")).alias("normalized_text"))


def doc_term_counts(spark, sf_dir):
    return term_counts(tokenize_documents(documents(spark, sf_dir)))


def doc_lengths(spark, sf_dir):
    return index_of(spark, sf_dir).doc_lengths


# Vocabulary and index


def vocab_df_cf(spark, sf_dir):
    return index_of(spark, sf_dir).terms()


def vocab_ids(spark, sf_dir):
    return vocabulary(index_of(spark, sf_dir))


def vocab_summary(spark, sf_dir):
    return vocabulary_summary(index_of(spark, sf_dir))


def zipf_top50(spark, sf_dir):
    return most_frequent(index_of(spark, sf_dir), 50)


def hapax(spark, sf_dir):
    return hapax_ratio(index_of(spark, sf_dir)).select(F.round("hapax_ratio", 6).alias("hapax_ratio"))


def vocab_by_config(spark, sf_dir):
    parts = [vocabulary_summary(index_of(spark, sf_dir, c)).withColumn("config", F.lit(c)) for c in ("default", "stop", "stem")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def postings(spark, sf_dir):
    return index_of(spark, sf_dir).postings.select("term", "doc_id", "tf")


def positional_postings(spark, sf_dir):
    return index_of(spark, sf_dir).postings.select("term", "doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


def index_stats(spark, sf_dir):
    return index_summary(index_of(spark, sf_dir))


def lookup_of(term, spark, sf_dir):
    return lookup(index_of(spark, sf_dir), term)


# Ranking


def idf_terms(spark, sf_dir):
    return idf_of(index_of(spark, sf_dir), ["the", "en", "ononst", "zzzz"]).select("term", F.round("idf", 6).alias("idf"))


def bm25_term_doc(spark, sf_dir):
    return rounded(term_scores(index_of(spark, sf_dir), ["ononst", "inoran"]))


def ranked_by(terms, spark, sf_dir):
    return rounded(search(terms, index_of(spark, sf_dir)))


def bm25_k1b_grid(spark, sf_dir):
    return rounded(parameter_grid(table_of(spark, QUERIES), stored_index_of(spark, sf_dir, positions=False), [0.9, 1.2, 2.0], [0.0, 0.75, 1.0], 5))


def bm25_batch(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))
    return rounded(search_batch(items, stored_index_of(spark, sf_dir, positions=False)))


# Structured retrieval


def matched(text, spark, sf_dir):
    return retrieve(parse_query(text), index_of(spark, sf_dir))


def structured(text, spark, sf_dir):
    return rounded(search_structured(text, index_of(spark, sf_dir)))


def matched_bridge(spark, sf_dir):
    return retrieve(parse_query('"thing of the thing"', CONFIGS["stop"]), index_of(spark, sf_dir, "stop"))


# Evaluation


def judgments(spark: SparkSession, sf_dir: str, queries: dict[str, str]) -> DataFrame:
    """Each labelled document for each query, graded by its labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    graded = labels.select(F.col("doc_id").cast("string").alias("doc_id"), (2 * F.col("quality") + 1 - F.col("toxic")).cast("int").alias("relevance"))
    return graded.crossJoin(F.broadcast(table_of(spark, queries).select("query_id")))


def evaluated(queries, structured_run, means, spark, sf_dir):
    index = stored_index_of(spark, sf_dir, positions=structured_run)
    run = search_structured_batch(list(queries.items()), index, ScorerConfig(), 20) if structured_run else search_batch(table_of(spark, queries), index, ScorerConfig(), 20)
    rows, total = evaluate(table_of(spark, queries), run, judgments(spark, sf_dir, queries), 10, check=False)
    found = total if means else rows
    return found.select(*(F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in found.dtypes))


def esci_grades(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    label = F.element_at(F.array(*map(F.lit, ("i", "C", "s", "E"))), 2 * F.col("quality") + F.col("toxic") + 1)
    return labels.select("doc_id", esci_grade(label).alias("relevance"))


def eval_gaps(spark, sf_dir):
    """The demonstration's third part: judged documents that the first five results miss."""
    found = demo(documents(spark, sf_dir), table_of(spark, QUERIES), judgments(spark, sf_dir, QUERIES)).missed
    return found.select("query_id", "doc_id", "relevance", F.length("text").alias("n_chars"))


# Files


def csv_round_trip(spark, sf_dir):
    """documents as a CSV table, written and read."""
    path = work_path(spark)
    write_csv(documents(spark, sf_dir), path, ["doc_id", "text"])
    return read_documents(spark, path, "text", "doc_id")


def csv_rows(spark, sf_dir):
    path = work_path(spark)
    write_csv(spark.read.parquet(f"{sf_dir}/part.parquet"), path, ["p_partkey", "p_name"])
    return read_csv(spark, path)


def qrels_round_trip(spark, sf_dir):
    path = work_path(spark)
    write_qrels(judgments(spark, sf_dir, QUERIES), path)
    return read_qrels(spark, path)


def queries_round_trip(spark, sf_dir):
    path = work_path(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    write_csv(items, path, ["item_id", "text"])
    return read_queries(spark, path, "item_id", "text")


def titles_index(spark: SparkSession, sf_dir: str) -> SearchIndex:
    return build_index(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_name", "p_partkey", check_ids=False)


def index_json_round_trip(spark, sf_dir):
    """An index of titles as JSON, written and read."""
    path = work_path(spark)
    write_index_json(titles_index(spark, sf_dir), path)
    return read_index_json(spark, path).postings.select("term", "doc_id", "tf")


def index_parquet_round_trip(spark, sf_dir):
    kept = stored(index_of(spark, sf_dir))
    return kept.terms().crossJoin(F.broadcast(kept.stats().select("document_count", "total_terms")))


def literal_texts(spark, sf_dir):
    return text_source(spark, "Red Phone", "", "blue case")


# Queries as they are typed


def lookup_forms(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", lookup_form(F.concat(F.lit("  "), F.col("text"), F.lit(" "))).alias("form"))


def search_forms(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.array_join(search_form("text"), "|").alias("terms"))


def query_errors(spark, sf_dir):
    """Which queries are well formed, and which of these have something to rank."""

    def verdict(text: str, make) -> bool:
        try:
            make(text)
        except QueryParseError:
            return False
        return True

    return spark.createDataFrame([(t, verdict(t, parse_query), verdict(t, lambda x: structured_tree(x, CONFIGS["default"]))) for t in VERDICTS], "query string, parsed boolean, ranked boolean")


def title_categories(spark, sf_dir):
    return make_titles(spark, 2000).select("product_id", "category", (F.length("title") > 0).alias("has_title"))


def tokenized(spark, sf_dir):
    found = tokenize_documents(documents(spark, sf_dir))
    return found.select("doc_id", "normalized_text", F.array_join("tokens", " ").alias("tokens"), "token_count")


# Preparation


def prep_titles(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("n"), F.when(F.col("p_partkey") % 7 == 0, F.lit("  ")).otherwise(F.col("p_name")).alias("title"))
    return prepare_titles(part, "title").select("product_id", "title")


def prep_esci_limit(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    products = part.select(F.col("p_partkey").alias("n"), F.col("p_partkey").cast("string").alias("product_id"), F.lit("").alias("title"), F.col("p_name").alias("product_title"))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select((F.col("item_id") + 1).alias("n"), F.lit("").alias("query_id"), F.col("text").alias("query"))
    labels = part.select(F.col("p_partkey").alias("n"), F.format_string("query-%06d", F.col("p_partkey") % 40 + 1).alias("query_id"), F.col("p_partkey").cast("string").alias("product_id"), F.lit("E").alias("label"))
    kept, _, judged = prepare_esci(products, items, labels, limit=5)
    return judged.join(kept.select("product_id", "title"), "product_id").select("query_id", "product_id", "title", "esci_label")


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {f"tok_{c}": partial(tokens_by, c) for c in CONFIGS}
    found |= {"normalized_text": normalized, "doc_term_counts": doc_term_counts, "doc_lengths": doc_lengths}
    found |= {f.__name__: f for f in (vocab_df_cf, vocab_ids, vocab_summary, zipf_top50, vocab_by_config, postings, positional_postings, index_stats, idf_terms, bm25_term_doc, bm25_k1b_grid, bm25_batch, esci_grades, prep_titles, prep_esci_limit)}
    found |= {f.__name__: f for f in (eval_gaps, csv_round_trip, csv_rows, qrels_round_trip, queries_round_trip, index_json_round_trip, index_parquet_round_trip, literal_texts, lookup_forms, search_forms, query_errors, title_categories)}
    found |= {"tokenized_documents": tokenized}
    found |= {"hapax_ratio": hapax, "lookup_term": partial(lookup_of, "ononst"), "lookup_missing": partial(lookup_of, "zzzz")}
    found |= {name: partial(ranked_by, terms) for name, terms in RANKED.items()}
    found |= {name: partial(matched, text) for name, (text, _) in MATCHED.items()}
    found |= {name: partial(structured, text) for name, (text, _) in RANKED_STRUCTURED.items()}
    found |= {"phrase_stopword_bridge": matched_bridge}
    found |= {"eval_per_query": partial(evaluated, QUERIES, False, False), "eval_report": partial(evaluated, QUERIES, False, True), "eval_structured_per_query": partial(evaluated, STRUCTURED, True, False), "eval_structured_report": partial(evaluated, STRUCTURED, True, True)}
    return found


RANKED = {
    "bm25_single": ["ononst"],
    "bm25_multi": ["the", "thing", "ononst", "en"],
    "bm25_dup_terms": ["ononst", "ononst", "inoran"],
    "bm25_negative_idf": ["the", "and"],
}


#: Query texts, whether they are well formed, and whether there is something to rank.
VERDICTS = {'"a b': (False, False), "a NEAR/3 b": (True, True), "a NEAR/0 b": (False, False), "(a": (False, False), "a OR": (False, False), "NOT a": (True, False), "a NOT b": (True, True), "NEAR/3x": (False, False), "": (False, False), "a b": (True, True)}


# SQL of the same rows


def has(term: str) -> str:
    return f"SELECT doc_id FROM postings WHERE term = '{term}'"


def phrase(*terms: str) -> str:
    joins = " ".join(f"JOIN tp t{k} ON t{k}.doc_id = t0.doc_id AND t{k}.pos = t0.pos + {k} AND t{k}.term = '{t}'" for k, t in enumerate(terms) if k)
    return f"SELECT DISTINCT t0.doc_id FROM tp t0 {joins} WHERE t0.term = '{terms[0]}'"


def near(left: str, right: str, n: int) -> str:
    return f"SELECT DISTINCT a.doc_id FROM tp a JOIN tp b ON a.doc_id = b.doc_id AND abs(a.pos - b.pos) <= {n} WHERE a.term = '{left}' AND b.term = '{right}'"


EVERY = "SELECT doc_id FROM dl"
#: Query text and the SQL of its documents.
MATCHED = {
    "bool_and": ("trash AND the", f"{has('trash')} INTERSECT {has('the')}"),
    "bool_or": ("ononst OR inoran", f"{has('ononst')} UNION {has('inoran')}"),
    "bool_not": ("NOT the", f"{EVERY} EXCEPT {has('the')}"),
    "bool_implicit_and": ("the trash NOT stupid", f"({has('the')} INTERSECT {has('trash')}) EXCEPT {has('stupid')}"),
    "bool_nested": ("(trash OR scum) AND NOT (clown OR moron)", f"({has('trash')} UNION {has('scum')}) EXCEPT ({has('clown')} UNION {has('moron')})"),
    "bool_or_not": ("ononst OR NOT the", f"{has('ononst')} UNION ({EVERY} EXCEPT {has('the')})"),
    "phrase_2": ('"of the"', phrase("of", "the")),
    "phrase_3": ('"the of the"', phrase("the", "of", "the")),
    "phrase_repeat": ('"the the"', phrase("the", "the")),
    "near_1": ("of NEAR/1 the", near("of", "the", 1)),
    "near_5": ("of NEAR/5 thing", near("of", "thing", 5)),
    "near_same_term": ("trash NEAR/3 trash", has("trash")),
}
#: Query text and (SQL of its documents, its terms).
RANKED_STRUCTURED = {
    "structured_mixed": ('(trash OR "of the") AND NOT stupid', (f"({has('trash')} UNION {phrase('of', 'the')}) EXCEPT {has('stupid')}", ["trash", "of", "the", "stupid"])),
    "structured_or_not": ("ononst OR NOT the", (f"{has('ononst')} UNION ({EVERY} EXCEPT {has('the')})", ["ononst", "the"])),
    "structured_plain": ("trash ononst", (EVERY, ["trash", "ononst"])),
}


def tokens_sql(config: TokenizerConfig) -> str:
    text = "text"
    text = f"strip_accents({text})" if config.strip_accents else text
    text = f"lower({text})" if config.lowercase else text
    out = f"regexp_extract_all(replace({text}, '&', ' and '), '{config.pattern}')"
    if config.drop_stopwords:
        out = f"list_filter({out}, lambda t: t NOT IN ({', '.join(repr(s) for s in STOPWORDS)}))"
    if config.stemming == "suffix":
        cases = "WHEN suffix(t, 'ies') AND length(t) > 5 THEN left(t, length(t) - 3) || 'y' " + " ".join(f"WHEN suffix(t, '{s}') AND length(t) > {len(s) + 2} THEN left(t, length(t) - {len(s)})" for s in SUFFIXES)
        out = f"list_transform({out}, lambda t: [t, CASE {cases} ELSE t END])"
        out = f"list_transform({out}, lambda p: [p[1], CASE WHEN length(p[2]) >= 2 AND right(p[2], 1) = substr(p[2], length(p[2]) - 1, 1) THEN left(p[2], length(p[2]) - 1) ELSE p[2] END])"
        out = f"list_transform({out}, lambda p: CASE WHEN length(p[1]) <= 3 OR length(p[2]) < 3 THEN p[1] ELSE p[2] END)"
    return out


def base(config: str = "default") -> str:
    return f"""WITH toks AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, {tokens_sql(CONFIGS[config])} AS tokens FROM documents),
tp AS (SELECT doc_id, unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS pos FROM toks),
postings AS (SELECT term, doc_id, count(*) AS tf FROM tp GROUP BY term, doc_id),
dl AS (SELECT doc_id, CAST(len(tokens) AS BIGINT) AS dl FROM toks),
stats AS (SELECT count(*) AS n, CAST(sum(dl) AS BIGINT) AS total, sum(dl) / count(*) AS avgdl FROM dl),
terms AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM postings GROUP BY term)"""


def score_sql(k1: str = "1.2", b: str = "0.75") -> str:
    return f"ln((n - df + 0.5) / (df + 0.5)) * (tf * ({k1} + 1.0)) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))"


POSTED = "postings JOIN terms USING (term) JOIN dl USING (doc_id) CROSS JOIN stats"


def values(queries: dict[str, str]) -> str:
    rows = ", ".join(f"('{q}', '{t}')" for q, t in queries.items())
    return f"(SELECT * FROM (VALUES {rows}) AS v(query_id, query))"


def terms_table(pairs: list[tuple[str, str]]) -> str:
    rows = ", ".join(f"('{q}', '{t}')" for q, t in pairs)
    return f"(SELECT query_id, term, count(*) AS qtf FROM (VALUES {rows}) AS v(query_id, term) GROUP BY ALL)"


def split_sql(source: str) -> str:
    """query_id, term, qtf of a table query_id, query."""
    return f"(SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(replace(lower(query), '&', ' and '), '[a-z0-9]+')) AS term FROM {source}) GROUP BY ALL)"


def run_sql(terms: str, top_k: int, candidates: str = "", score: str = score_sql(), keys: str = "query_id", extra: str = "") -> str:
    inner = f"SELECT {keys}, doc_id, sum(qtf * {score}) AS score FROM {POSTED} JOIN {terms} q USING (term) {extra} {candidates} GROUP BY {keys}, doc_id"
    return f"SELECT {keys}, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ({inner})) WHERE rank <= {top_k}"


def metrics_sql(queries: dict[str, str], run: str, config: str = "default") -> str:
    return f"""{base(config)}, queries AS {values(dict.fromkeys(queries, ''))}, run AS ({run}),
qrels AS (SELECT query_id, CAST(doc_id AS VARCHAR) AS doc_id, 2 * quality + 1 - toxic AS relevance FROM labels CROSS JOIN queries),
hits AS (SELECT query_id, sum(CASE WHEN rank <= 10 AND relevance >= 2 THEN 1 ELSE 0 END) AS found, min(CASE WHEN relevance >= 2 THEN rank END) AS first, sum(CASE WHEN rank <= 10 THEN coalesce(relevance, 0) / log2(rank + 1.0) END) AS dcg FROM run LEFT JOIN qrels USING (query_id, doc_id) GROUP BY query_id),
ideal AS (SELECT query_id, sum(CASE WHEN relevance >= 2 THEN 1 ELSE 0 END) AS relevant, sum(CASE WHEN place <= 10 THEN relevance / log2(place + 1.0) END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS place FROM qrels) GROUP BY query_id),
metrics AS (SELECT query_id, coalesce(found, 0) / 10.0 AS precision_at_k, CASE WHEN coalesce(relevant, 0) = 0 THEN 1.0 ELSE coalesce(found, 0) / relevant END AS recall_at_k, coalesce(1.0 / first, 0.0) AS reciprocal_rank, CASE WHEN coalesce(idcg, 0) > 0 THEN coalesce(dcg, 0) / idcg ELSE 0.0 END AS ndcg_at_k FROM queries LEFT JOIN hits USING (query_id) LEFT JOIN ideal USING (query_id))"""


METRICS = ("precision_at_k", "recall_at_k", "reciprocal_rank", "ndcg_at_k")
PER_QUERY = "SELECT query_id, " + ", ".join(f"CAST(round({m}, 6) AS DOUBLE) AS {m}" for m in METRICS) + " FROM metrics"
MEANS = "SELECT " + ", ".join(f"CAST(round(avg({m}), 6) AS DOUBLE) AS mean_{m}" for m in METRICS) + ", 10 AS k, count(*) AS num_queries FROM metrics"


def structured_run_sql(top_k: int) -> str:
    """The run of STRUCTURED: its candidates by set operations, its terms by hand."""
    candidates = {"s1": f"{has('trash')} INTERSECT {has('worthless')}", "s2": f"({phrase('of', 'the')}) EXCEPT {has('stupid')}", "s3": f"({near('trash', 'stupid', 20)}) UNION {has('ononst')}", "s4": EVERY}
    terms = {"s1": ["trash", "worthless"], "s2": ["of", "the", "stupid"], "s3": ["trash", "stupid", "ononst"], "s4": ["clown", "scum"]}
    allowed = " UNION ALL ".join(f"SELECT '{q}' AS query_id, doc_id FROM ({sql})" for q, sql in candidates.items())
    return run_sql(terms_table([(q, t) for q, own in terms.items() for t in own]), top_k, f"JOIN ({allowed}) c USING (query_id, doc_id)")


def oracle_sql() -> dict[str, str]:
    plain = base()
    found = {f"tok_{c}": f"{base(c)} SELECT doc_id, array_to_string(tokens, ' ') AS tokens, CAST(len(tokens) AS BIGINT) AS token_count FROM toks" for c in CONFIGS}
    words = r"regexp_replace(regexp_replace(replace(lower(text), '&', ' and '), '[/|_+()-]+|[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')"
    found["normalized_text"] = f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, trim({words}) AS normalized_text FROM documents"
    found["doc_term_counts"] = f"{plain} SELECT doc_id, term, tf FROM postings"
    found["doc_lengths"] = f"{plain} SELECT doc_id, dl FROM dl"
    found["vocab_df_cf"] = f"{plain} SELECT term, df, cf FROM terms"
    found["vocab_ids"] = f"{plain} SELECT term AS token, row_number() OVER (ORDER BY term) AS token_id, df, cf FROM terms"
    summary = "SELECT (SELECT n FROM stats) AS documents, (SELECT total FROM stats) AS total_terms, (SELECT count(*) FROM terms) AS vocab_size"
    found["vocab_summary"] = f"{plain} {summary}"
    found["vocab_by_config"] = " UNION ALL ".join(f"SELECT *, '{c}' AS config FROM ({base(c)} {summary})" for c in ("default", "stop", "stem"))
    found["zipf_top50"] = f"{plain} SELECT CAST(row_number() OVER (ORDER BY cf DESC, term) AS INTEGER) AS rank, term, cf FROM terms ORDER BY cf DESC, term LIMIT 50"
    found["hapax_ratio"] = f"{plain} SELECT round(avg(CASE WHEN df = 1 THEN 1.0 ELSE 0.0 END), 6) AS hapax_ratio FROM terms"
    found["postings"] = f"{plain} SELECT term, doc_id, tf FROM postings"
    found["positional_postings"] = f"{plain} SELECT term, doc_id, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM tp GROUP BY term, doc_id"
    found["index_stats"] = f"{plain} SELECT n AS documents, (SELECT count(*) FROM terms) AS unique_terms, total AS total_terms, round(avgdl, 1) AS avg_doc_len FROM stats"
    for name, term in (("lookup_term", "ononst"), ("lookup_missing", "zzzz")):
        found[name] = f"{plain} SELECT doc_id, tf FROM postings WHERE term = '{term}'"
    found["idf_terms"] = f"{plain} SELECT v.term, coalesce(round(ln((n - df + 0.5) / (df + 0.5)), 6), 0.0) AS idf FROM (VALUES ('the'), ('en'), ('ononst'), ('zzzz')) AS v(term) LEFT JOIN terms ON terms.term = v.term CROSS JOIN stats"
    found["bm25_term_doc"] = f"{plain} SELECT term, doc_id, round({score_sql()}, 6) AS score FROM {POSTED} WHERE term IN ('ononst', 'inoran')"
    one = "SELECT CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM"
    for name, terms in RANKED.items():
        found[name] = f"{plain} {one} ({run_sql(terms_table([('q', t) for t in terms]), 10)})"
    grid = "CROSS JOIN (SELECT CAST(k1 AS DOUBLE) AS k1, CAST(b AS DOUBLE) AS b FROM (VALUES (0.9), (1.2), (2.0)) AS x(k1) CROSS JOIN (VALUES (0.0), (0.75), (1.0)) AS y(b)) g"
    found["bm25_k1b_grid"] = f"{plain} SELECT k1, b, query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM ({run_sql(split_sql(values(QUERIES)), 5, score=score_sql('k1', 'b'), keys='k1, b, query_id', extra=grid)})"
    items = "(SELECT CAST(item_id AS VARCHAR) AS query_id, text AS query FROM benchmark)"
    found["bm25_batch"] = f"{plain} SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM ({run_sql(split_sql(items), 10)})"
    for name, (_, sql) in MATCHED.items():
        found[name] = f"{plain} SELECT doc_id FROM ({sql})"
    for name, (_, (sql, terms)) in RANKED_STRUCTURED.items():
        found[name] = f"{plain} {one} ({run_sql(terms_table([('q', t) for t in terms]), 10, f'JOIN ({sql}) c USING (doc_id)')})"
    found["phrase_stopword_bridge"] = f"{base('stop')} {phrase('thing', 'thing')}"
    plain_run = run_sql(split_sql(values(QUERIES)), 20)
    found["eval_per_query"] = f"{metrics_sql(QUERIES, plain_run)} {PER_QUERY}"
    found["eval_report"] = f"{metrics_sql(QUERIES, plain_run)} {MEANS}"
    found["eval_structured_per_query"] = f"{metrics_sql(STRUCTURED, structured_run_sql(20))} {PER_QUERY}"
    found["eval_structured_report"] = f"{metrics_sql(STRUCTURED, structured_run_sql(20))} {MEANS}"
    found["esci_grades"] = "SELECT doc_id, CAST(2 * quality + toxic AS INTEGER) AS relevance FROM labels"
    found["eval_gaps"] = f"{metrics_sql(QUERIES, run_sql(split_sql(values(QUERIES)), 5), 'stop')} SELECT query_id, doc_id, CAST(relevance AS INTEGER) AS relevance, CAST(length(text) AS INTEGER) AS n_chars FROM qrels JOIN (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents) t USING (doc_id) ANTI JOIN run USING (query_id, doc_id) WHERE relevance >= 2"
    found["csv_round_trip"] = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') AS text FROM documents"
    found["csv_rows"] = "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name FROM part"
    found["qrels_round_trip"] = f"SELECT query_id, CAST(doc_id AS VARCHAR) AS doc_id, CAST(2 * quality + 1 - toxic AS INTEGER) AS relevance FROM labels CROSS JOIN {values(dict.fromkeys(QUERIES, ''))}"
    found["queries_round_trip"] = "SELECT CAST(item_id AS VARCHAR) AS query_id, trim(text) AS query FROM benchmark"
    titles = "SELECT CAST(p_partkey AS VARCHAR) AS doc_id, unnest(regexp_extract_all(replace(lower(p_name), '&', ' and '), '[a-z0-9]+')) AS term FROM part"
    found["index_json_round_trip"] = f"SELECT term, doc_id, count(*) AS tf FROM ({titles}) GROUP BY ALL"
    found["index_parquet_round_trip"] = f"{plain} SELECT term, df, cf, n AS document_count, total AS total_terms FROM terms CROSS JOIN stats"
    found["literal_texts"] = "SELECT * FROM (VALUES ('text-1', 'Red Phone'), ('text-2', ''), ('text-3', 'blue case')) AS v(doc_id, text)"
    found["lookup_forms"] = "SELECT item_id, lower(trim(text)) AS form FROM benchmark"
    found["search_forms"] = r"SELECT item_id, array_to_string(list_filter(string_split_regex(lower(trim(text)), '\s+'), lambda t: t <> ''), '|') AS terms FROM benchmark"
    found["query_errors"] = "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {a}, {b})" for t, (a, b) in VERDICTS.items()) + ") AS v(query, parsed, ranked)"
    cases, below = "", 0
    for name, (share, *_) in CATEGORIES.items():
        below += share
        cases += f" WHEN (n * 183 + 42) % 500 < {below} THEN '{name}'"
    found["title_categories"] = f"SELECT printf('fk-%03d', n + 1) AS product_id, CASE{cases} END AS category, true AS has_title FROM range(2000) t(n)"
    found["tokenized_documents"] = f"SELECT doc_id, normalized_text, tokens, token_count FROM ({found['normalized_text']}) JOIN ({found['tok_default']}) USING (doc_id)"
    found["prep_titles"] = "SELECT printf('flipkart-%06d', p_partkey) AS product_id, trim(p_name) AS title FROM part WHERE p_partkey % 7 <> 0"
    found["prep_esci_limit"] = "SELECT printf('query-%06d', p_partkey % 40 + 1) AS query_id, CAST(p_partkey AS VARCHAR) AS product_id, trim(p_name) AS title, 'E' AS esci_label FROM part WHERE p_partkey % 40 + 1 <= 5"
    return found
