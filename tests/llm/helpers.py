"""Tables of edge cases and brute-force versions."""

import base64
import hashlib
import re

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EDGES = [
    None,
    "",
    "   \n\t ",
    "x",
    "one two",
    "One TWO",
    "é ü 😀 中文 naïve",
    "a" * 50_000,
    "lorem ipsum dolor sit amet " * 4_000,
    "same text again and again",
    "same text again and again",
    "<|endoftext|> don't  stop now  \x1c y",
]


def edge_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and further columns with the names of results."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "src", None, "s", 1) for i, t in enumerate(EDGES)]
    rows += [rows[4], (None, "a null id", None, None, None, None, None)]
    return spark.createDataFrame(rows, f"{DOCUMENTS}, spans string, kept int")


def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


def documents(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCUMENTS)


def by_id(frame, key="doc_id"):
    rows = frame.collect()
    found = {r[key]: r for r in rows}
    assert len(found) == len({r[key] for r in rows})
    return found


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def base32_sha1(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()
