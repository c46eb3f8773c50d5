"""Quality rules with tokeniser fertility.

Public vocabularies measure each text: characters per token, the share of tokens that are
byte fallbacks (byte pieces, or in a byte-level vocabulary tokens that hold only a part of a
character), and the entropy of the tokens (per token, as a share of the most that so many
tokens could have). All words of the text count. Bands come from the corpus itself: for each
language the quartiles over all texts that pass the base rules, widened by a multiple of
their distance. Languages outside the fixed list, and those with fewer than ``least``
passing texts, have the band of their script, which is that of most letters of the whole
text; where a script has as few, nothing is rejected. Characters per token and entropy vary
with length, so their bands are also per length class, where a class has enough texts.

A text goes if one of the three measures is outside of its band for every vocabulary. The
width is set from the labels of the tables (README); the upper band of characters per token
is wider, as no labelled junk is above it.

Null and empty texts have no words and fail the base rules; an empty table gives an empty
table. Texts of any length are read whole. Repeated rows are judged alike. Of scripts with
equally many letters the first in the order of code points counts; a value on a band's edge
is inside. Further columns, whatever their names, are not read. A null language is one
outside the fixed list.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.common import ARROW_TYPES, arrow_map, cut, discard, resident

SYMBOLS = "#*$%&|<>"
#: Languages with a band of their own (ISO 639-1).
LANGUAGES = ("en", "de", "fr", "es", "it", "pt", "nl", "pl", "sv", "cs", "ru", "uk", "el", "tr", "ar", "fa", "he", "hi", "th", "vi", "id", "zh", "ja", "ko")
#: First code points of the blocks that name a script, in ascending order.
SCRIPTS = ((0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "indic"), (0xE00, "thai"), (0x1100, "hangul"), (0x1E00, "latin"), (0x3040, "kana"), (0x3400, "han"), (0xAC00, "hangul"), (0xD800, "other"))
#: Words whose ids a worker keeps, and those of one block more.
CACHE_ENTRIES = 250_000
MOST_CLASS = 20
WORD_LINE = re.compile(r"[^\x20\x09-\x0D]").search
ASCII_LETTER = re.compile(r"[A-Za-z]").search
STARTS = [first for first, _ in SCRIPTS]


def base_measures(text: str | None, words: list[bytes], numbers: np.ndarray | None = None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text and its words; numbers: one for each word, equal where the words are."""
    n = len(words)
    if not n:
        return 0, 0, sum(map(text.count, SYMBOLS)) if text else 0, 0, 0
    joined = b"".join(words)
    chars = len(joined) if text.isascii() else len(joined.decode())
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if WORD_LINE(line)] if "\n" in text else []
    if numbers is None:
        known: dict[bytes, int] = {}
        numbers = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    return n, chars, symbols, len(lines) - len(set(lines)), repeated_words(numbers)


def repeated_words(numbers: np.ndarray) -> int:
    """Words covered by the 3-word windows that occur twice or more."""
    n = len(numbers)
    if n < 4:
        return 0
    v = int(numbers.max()) + 1
    if v < 1 << 21:
        windows = (numbers[:-2] * v + numbers[1:-1]) * v + numbers[2:]
    else:
        _, numbers = np.unique(numbers, return_inverse=True)
        _, pairs = np.unique(numbers[:-1] * len(numbers) + numbers[1:], return_inverse=True)
        windows = pairs[:-1] * len(numbers) + numbers[2:]
    order = np.argsort(windows, kind="stable")
    ordered = windows[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= twice
    return int(covered.sum())


def script_of(text: str) -> str:
    """The script of most letters of the text."""
    if text.isascii():
        return "latin" if ASCII_LETTER(text) else "none"
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    plain = codes | 32
    counts = {"latin": int(((plain >= 97) & (plain <= 122) & (codes < 128)).sum())}
    for code, n in zip(*(x.tolist() for x in np.unique(codes[codes >= 128], return_counts=True)), strict=True):
        if chr(code).isalpha():
            name = SCRIPTS[bisect_right(STARTS, code) - 1][1]
            counts[name] = counts.get(name, 0) + n
    order = [name for _, name in SCRIPTS]
    most = max(counts.values())
    return min((name for name, n in counts.items() if n == most), key=order.index) if most else "none"


Encoder = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def piece_model(path: str) -> tuple[Encoder, np.ndarray]:
    """A vocabulary of pieces: (the ids of words one after the other, the number of each word's), and which ids are byte fallbacks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = model.encode([w.decode(errors="replace") for w in words], num_threads=1)
        return np.fromiter(chain.from_iterable(found), np.int32), np.fromiter(map(len, found), np.int64, len(found))

    return encode, np.array([model.is_byte(i) for i in range(model.get_piece_size())])


def rank_model(path: str) -> tuple[Encoder, np.ndarray]:
    """The same of a byte-level vocabulary of ranks; each word is encoded as after a space, without being split further."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    model = tiktoken.Encoding(path, pat_str=r" [^ ]+", mergeable_ranks=ranks, special_tokens={})
    size, fallback = np.zeros(max(ranks.values()) + 1, np.int64), np.zeros(max(ranks.values()) + 1, bool)
    for token, rank in ranks.items():
        size[rank] = len(token)
        try:
            token.decode()
        except UnicodeDecodeError:
            fallback[rank] = True

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.decode(errors="replace").encode() for w in words]
        ids = np.array(model.encode_ordinary(b"".join([b" " + w for w in raw]).decode()), np.int32)
        # Tokens and words in bytes: a word ends where a token does.
        ends = np.searchsorted(np.cumsum(size[ids]), np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)) + 1
        return ids, np.diff(np.r_[0, ends])

    return encode, fallback


class Vocabularies:
    """Tokenises words one by one, each as after a space. Words have numbers; for each vocabulary their ids stand one after the other."""

    def __init__(self, paths: Sequence[str], entries: int = CACHE_ENTRIES):
        self.models = [(piece_model if path.endswith(".model") else rank_model)(path) for path in paths]
        self.entries = entries
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids = [np.empty(0, np.int32) for _ in self.models]
        self.counts = [np.empty(0, np.int64) for _ in self.models]
        self.starts = [np.empty(0, np.int64) for _ in self.models]

    def learn(self, texts: list[list[bytes]]) -> None:
        """Number the words of a block of texts; a full table is begun anew."""
        if len(self.number) >= self.entries:
            self.forget()
        words = list(set().union(*texts).difference(self.number))
        if not words:
            return
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))
        for k, (encode, _) in enumerate(self.models):
            ids, counts = encode(words)
            self.ids[k], self.counts[k] = np.concatenate([self.ids[k], ids]), np.concatenate([self.counts[k], counts])
            self.starts[k] = np.cumsum(self.counts[k]) - self.counts[k]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def fertility(self, numbers: np.ndarray, n_chars: int) -> list[float]:
        """For each vocabulary characters per token, byte-fallback share and relative token entropy; a text without tokens has 0, 0 and 0."""
        out: list[float] = []
        for k, (_, fallback) in enumerate(self.models):
            counts = self.counts[k][numbers]
            ends = np.cumsum(counts)
            n = int(ends[-1]) if len(ends) else 0
            if not n:
                out += [0.0, 0.0, 0.0]
                continue
            ids = np.sort(self.ids[k][np.repeat(self.starts[k][numbers] - ends + counts, counts) + np.arange(n)])
            shares = np.diff(np.r_[0, np.flatnonzero(ids[1:] != ids[:-1]) + 1, n]) / n
            entropy = float(-(shares * np.log2(shares)).sum())
            out += [n_chars / n, float(fallback[ids].mean()), entropy / float(np.log2(n)) if n > 1 else 0.0]
        return out


def vocabularies(paths: tuple[str, ...]) -> Vocabularies:
    return resident(__name__, paths, lambda: Vocabularies(paths))


KINDS = ("chars_per_token", "fallback_share", "token_entropy")


def measure_names(k: int) -> tuple[str, ...]:
    """The columns of a vocabulary: the first one's have no number."""
    return tuple(name if k == 0 else f"{name}_{k + 1}" for name in KINDS)


def measures(docs: DataFrame, paths: tuple[str, ...], id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """One row per document: the base measures, its language if that is a fixed one, its script and the three of each vocabulary. A narrow plan."""

    def make():
        models = vocabularies(paths)
        own = frozenset(LANGUAGES)

        def block(columns):
            ids, texts, langs = columns
            rows = []
            split = [t.encode().split() if t else [] for t in texts]
            models.learn(split)
            for text, words, lang in zip(texts, split, langs, strict=True):
                numbers = models.numbers(words)
                base = base_measures(text, words, numbers)
                rows.append((*base, lang if lang in own else None, script_of(text or ""), *models.fertility(numbers, base[1])))
            return [ids, *(map(list, zip(*rows, strict=True)) if rows else [[]] * (7 + 3 * len(paths)))]

        return block

    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang"))
    schema = [(id_column, "bigint"), ("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint"), ("language", "string"), ("script", "string")]
    schema += [(name, "double") for k in range(len(paths)) for name in measure_names(k)]
    found = arrow_map(source, make, schema)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.withColumn("base_failed", failed)


def length_class(n_words):
    """The power of two below the number of words: entropy falls with length and characters per token vary less, so their bands are for texts of like length."""
    return F.least(F.floor(F.log2(F.greatest(n_words, F.lit(1)).cast("double"))), F.lit(MOST_CLASS)).cast("int")


#: Parts of one in which measures count for the bands.
PARTS = 10_000
GROUP = ("language", "script", "length_class")
#: The sets of texts that a band is taken from, the first that has enough texts: what they have in common, and the measures that they serve (all, or those that vary with length too).
SETS = (("language", "length_class"), ("language",), ("script", "length_class"), ("script",))


def quartiles(measured: DataFrame, names: list[str]) -> list[dict]:
    """For each of SETS, by the set's values, the number of texts ("of") and the quartiles of each measure.

    Measures count in whole ten-thousandths, so the counts are exact, merge in any order and
    are the same in every run. Partial counts leave each task; the fixed lists of
    languages, scripts and length classes and the ten-thousandths bound how many there are.
    """
    each = F.array(*(F.struct(F.lit(k).alias("m"), F.floor(F.col(n) * PARTS).cast("bigint").alias("v")) for k, n in enumerate(names)))
    counted = cut(measured.where(~F.col("base_failed")).select(*GROUP, F.inline(each)).groupBy(*GROUP, "m", "v").agg(F.count("*").alias("n")))
    found = []
    for own in SETS:
        whole = Window.partitionBy(*own, "m")
        so_far = F.sum("n").over(whole.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        spread = counted.groupBy(*own, "m", "v").agg(F.sum("n").alias("n")).select("*", so_far.alias("so_far"), F.sum("n").over(whole).alias("of"))
        points = [F.min(F.when(F.col("so_far") >= q * F.col("of"), F.col("v"))).alias(f"q{k}") for k, q in enumerate((0.25, 0.5, 0.75))]
        groups: dict[tuple, dict] = {}
        for r in spread.groupBy(*own, "m").agg(F.max("of").alias("of"), *points).collect():
            groups.setdefault(tuple(r[c] for c in own), {"of": r.of})[names[r.m]] = [r[f"q{k}"] / PARTS for k in range(3)]
        found.append(groups)
    discard(counted)
    return found


def limits(found: list[dict], group: dict, name: str, by_length: bool, least: int):
    """The quartiles of the first set with enough texts that a group belongs to, None if there is none."""
    for own, rows in zip(SETS, found, strict=True):
        if ("length_class" in own) > by_length or group[own[0]] is None:
            continue
        row = rows.get(tuple(group[c] for c in own))
        if row is not None and row["of"] >= least:
            return row[name]
    return None


def band(q, low: float, high: float, floor: float) -> tuple[float, float]:
    """The median less and plus multiples of the quartiles' distance, which is floor at least."""
    if q is None:
        return float("-inf"), float("inf")
    wide = max(q[2] - q[0], floor)
    return q[1] - low * wide, q[1] + high * wide


def quality_rules(docs: DataFrame, path: str | Sequence[str], width: float = 2.0, least: int = 30, upper_width: float = 4.0, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """One row per document with its measures, base_failed and kept; path names one vocabulary or several.

    The measures are written once to the checkpoint folder (numbers only, no texts) and
    read again for the bands and for the verdicts. No row is shuffled: bands are a table
    of one row for each language, script and length class that there is, which the fixed
    lists bound, so it is broadcast.
    """
    paths = (path,) if isinstance(path, str) else tuple(path)
    spark = docs.sparkSession
    measured = cut(measures(docs, paths, id_column, text_column, lang_column).withColumn("length_class", length_class(F.col("n_words"))))
    names = [name for k in range(len(paths)) for name in measure_names(k)]
    found = quartiles(measured, names)
    infinite = float("inf")
    rows = []
    for r in measured.select(*GROUP).distinct().collect():
        group = {c: r[c] for c in GROUP}
        row = [r[c] for c in GROUP]
        for name in names:
            kind = KINDS[names.index(name) % 3]
            q = limits(found, group, name, kind != "fallback_share", least)
            low, high = band(q, width, width if kind == "fallback_share" else upper_width, 0.01 if kind == "fallback_share" else 0.02)
            row += [-infinite if kind == "fallback_share" else low, infinite if kind == "token_entropy" else high]
        rows.append(tuple(row))
    # From Arrow: a list would go through Python workers of their own, which stay on the executors beside those of arrow_map.
    schema = [("of_language", "string"), ("of_script", "string"), ("of_class", "int"), *((f"{n}_{end}", "double") for n in names for end in ("low", "high"))]
    columns = [pa.array([row[k] for row in rows], ARROW_TYPES[kind]) for k, (_, kind) in enumerate(schema)]
    table = spark.createDataFrame(pa.table(columns, [name for name, _ in schema]))
    same = F.col("language").eqNullSafe(F.col("of_language")) & (F.col("script") == F.col("of_script")) & (F.col("length_class") == F.col("of_class"))
    outside = F.lit(False)
    for kind in range(3):
        by_all = F.lit(True)
        for k in range(len(paths)):
            name = measure_names(k)[kind]
            by_all &= (F.col(name) < F.col(f"{name}_low")) | (F.col(name) > F.col(f"{name}_high"))
        outside |= by_all
    joined = measured.join(F.broadcast(table), same, "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(outside, F.lit(False))).select(*(c for c in measured.columns if c != "length_class"), "kept")
