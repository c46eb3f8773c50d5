"""Text to tokens, as Column expressions and as a plain twin for query strings."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from termloom.runtime import ship_package

# The stopwords and suffixes that decide which tokens match.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "or", "that", "the", "to", "was", "were", "will", "with")
SUFFIXES = ("ing", "ers", "er", "ed", "es", "s")
STEMMERS = ("none", "suffix")

WHOLE, SPLIT = "[a-z0-9]+", "[a-z]+|[0-9]+"


@dataclass(frozen=True)
class TokenizerConfig:
    lowercase: bool = True
    strip_accents: bool = False
    split_numeric_boundaries: bool = False
    drop_stopwords: bool = False
    stemming: str = "none"

    def __post_init__(self):
        if self.stemming not in STEMMERS:
            raise ValueError(f"unknown stemming mode {self.stemming!r}; known: {', '.join(STEMMERS)}")

    def as_dict(self) -> dict:
        return asdict(self)

    @property
    def pattern(self) -> str:
        """What is a token. Splitting at digit boundaries needs no inserted spaces: letters and digits match apart."""
        return SPLIT if self.split_numeric_boundaries else WHOLE


DEFAULT = TokenizerConfig()


def compose(text: str, strip_accents: bool) -> str:
    """NFKC, then without combining marks if asked for."""
    text = unicodedata.normalize("NFKC", text)
    return unicodedata.normalize("NFKD", text).translate(WITHOUT_MARKS) if strip_accents else text


class Marks(dict):
    """A translation that drops characters with a combining class; filled as characters are met."""

    def __missing__(self, code: int):
        self[code] = kept = None if unicodedata.combining(chr(code)) else code
        return kept


WITHOUT_MARKS = Marks()


# Text by text: Arrow's own NFKC leaves composed characters apart (12,334 of all code points differ).
@F.arrow_udf(StringType())
def composed(texts: pa.Array) -> pa.Array:
    return pa.array([t if t is None else compose(t, False) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def stripped(texts: pa.Array) -> pa.Array:
    return pa.array([t if t is None else compose(t, True) for t in texts.to_pylist()], pa.string())


def folded(text: Column, config: TokenizerConfig) -> Column:
    """Composed and lower-cased text. Only texts beyond ASCII travel to Python, the others as nulls."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship_package(spark)
    beyond = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    out = F.coalesce((stripped if config.strip_accents else composed)(beyond), text)
    return F.lower(out) if config.lowercase else out


def normalized_text(text: Column, config: TokenizerConfig = DEFAULT) -> Column:
    """Words apart by single spaces; letters, digits and underscores of any script survive until the tokens are taken."""
    out = folded(text, config)
    # The characters that are separators, and the word that the ampersand stands for.
    if config.split_numeric_boundaries:
        out = F.regexp_replace(out, r"(?<=[A-Za-z])(?=\p{Nd})|(?<=\p{Nd})(?=[A-Za-z])", " ")
    out = F.regexp_replace(F.replace(out, F.lit("&"), F.lit(" and ")), r"[/|_+()-]+|[^\p{L}\p{N}_\s\u001c-\u001f\u0085\p{Z}]", " ")
    return F.trim(F.regexp_replace(out, r"[\s\u001c-\u001f\u0085\p{Z}]+", " "))


def stem(token: Column) -> Column:
    """The suffix stemmer; tokens of three characters and results below three stay as they are."""
    n = F.length(token)
    cut = F.when(token.endswith("ies") & (n > 5), F.concat(F.substring(token, F.lit(1), n - 3), F.lit("y")))
    for suffix in SUFFIXES:
        cut = cut.when(token.endswith(suffix) & (n > len(suffix) + 2), F.substring(token, F.lit(1), n - len(suffix)))
    cut = cut.otherwise(token)
    single = F.regexp_replace(cut, r"(.)\1$", "$1")
    return F.when((n <= 3) | (F.length(single) < 3), token).otherwise(single)


def tokens(text: Column, config: TokenizerConfig = DEFAULT) -> Column:
    """array<string>. Every replacement of normalized_text makes separators but that of the ampersand, so only it is needed."""
    out = F.regexp_extract_all(F.replace(folded(F.coalesce(text, F.lit("")), config), F.lit("&"), F.lit(" and ")), F.lit(config.pattern), F.lit(0))
    if config.drop_stopwords:
        out = F.filter(out, lambda t: ~t.isin(*STOPWORDS))
    return F.transform(out, stem) if config.stemming == "suffix" else out


def lookup_form(term: Column) -> Column:
    """A term as look-ups take it: without white space around it, in lower case."""
    return F.lower(F.regexp_replace(term, r"^\s+|\s+$", ""))


def search_form(query: Column) -> Column:
    """array<string>: a plain query as searches take it, in lower case and split at white space; signs inside of words stay."""
    return F.filter(F.split(lookup_form(query), r"\s+"), lambda t: t != "")


def stem_token(token: str) -> str:
    if len(token) <= 3:
        return token
    if token.endswith("ies") and len(token) > 5:
        cut = f"{token[:-3]}y"
    else:
        cut = next((token.removesuffix(s) for s in SUFFIXES if token.endswith(s) and len(token) > len(s) + 2), token)
    single = re.sub(r"(.)\1$", r"\1", cut)
    return token if len(single) < 3 else single


def tokenize(text: str, config: TokenizerConfig = DEFAULT) -> list[str]:
    """The twin of tokens() for one string on the driver."""
    out = compose(text, config.strip_accents)
    out = re.findall(config.pattern, (out.lower() if config.lowercase else out).replace("&", " and "))
    if config.drop_stopwords:
        out = [t for t in out if t not in STOPWORDS]
    return [stem_token(t) for t in out] if config.stemming == "suffix" else out


def tokenize_documents(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id", config: TokenizerConfig = DEFAULT) -> DataFrame:
    """doc_id (string), tokens, token_count and normalized_text of every row. A null text has no tokens and an empty normalized text. What is not selected is not computed."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    found = docs.select(F.col(id_column).cast("string").alias("doc_id"), tokens(text, config).alias("tokens"), normalized_text(text, config).alias("normalized_text"))
    return found.select("doc_id", "tokens", F.size("tokens").cast("bigint").alias("token_count"), "normalized_text")


def term_counts(tokenized: DataFrame) -> DataFrame:
    """doc_id, term, tf."""
    return tokenized.select("doc_id", F.explode_outer("tokens").alias("term")).where("term IS NOT NULL").groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
