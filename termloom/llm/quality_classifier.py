"""Quality and toxicity classifier by co-training.

Two views of a document are kept apart: its text (hashed words, beginnings of words, and
measures of the writing) and its metadata (source, language, length). A logistic regression on each view
learns from labelled documents. Then, over rounds, each view scores all documents of the
corpus; those without a label that it is surest of get its label, and the other view
learns from them too. After each round both views are calibrated on held-out labels,
which also decide how much each counts in the combined score, and at the end the round
counts whose held-out loss is least (the first of equals). All documents are scored.

Features are computed once, from whole texts, and written to the shared folder; rounds
read them. On the driver are bounded numbers of rows only: ``max_labelled`` labelled ones,
chosen by a hash of their ids, and ``max_pseudo`` pseudo-labelled ones for each target,
view and round, the surest of the whole corpus.

Null labels are unknown; of repeated labels of one id the worst counts. Of rows that share
an id one is learned from. Equal scores are ordered by a hash of the id. Null and empty
texts are scored by their metadata and the bias, texts of any length by all their words.
Repeated rows get equal scores. Without any labels every score is 0.5 and every document
is kept; an empty table of documents gives an empty table. Further columns of either
table, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.common import Recent, arrow_map, cut, resident

WORDS, MEASURES, META = 1 << 16, 64, 1 << 12
DIMENSIONS = WORDS + MEASURES
#: Labelled rows, and pseudo-labelled rows for each target, view and round, that are learned from at most.
MAX_LABELLED, MAX_PSEUDO = 6_000, 400
ROUNDS = 2
#: Bytes of the beginnings of words that are features beside the words.
BEGINNINGS = (4, 6)
#: A view is sure of a document whose probability is this far from one half.
SURE = 0.4
TARGETS = ("quality", "toxic")
UPPER, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"


def share(raw: bytes, of: bytes) -> float:
    """The share of a text's bytes that are among others."""
    return (len(raw) - len(raw.translate(None, of))) / len(raw)


def feature_of(word: bytes) -> tuple[int, ...]:
    """The hashed features of a word: itself, and its beginnings, which inflected and compound forms share."""
    word = word.strip(b".,;:!?\"'()[]{}<>|*#$%&")
    return zlib.crc32(word) % WORDS, *(zlib.crc32(word[:n] + b"-") % WORDS for n in BEGINNINGS if len(word) > n)


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of the text view, indices distinct."""
    raw = (text or "").encode()
    words = raw.lower().split()
    n = len(words)
    if not n:
        return np.array([WORDS], np.int32), np.array([1.0], np.float32)
    ids = np.fromiter(chain.from_iterable(map(resident(__name__, "words", lambda: Recent(feature_of, 200_000)).__getitem__, words)), np.int32)
    index, counts = np.unique(ids, return_counts=True)
    values = np.log1p(counts).astype(np.float32) / 2
    chars = max(1, len(text))
    distinct = len(set(words)) / n
    symbols = sum(map(text.count, "#*$%&|<>")) / n
    lines = text.split("\n")
    repeated = 1 - len(set(lines)) / len(lines)
    measures = (np.log1p(n) / 10, (chars - n) / n / 10, distinct, min(symbols, 4) / 2, repeated, share(raw, UPPER), share(raw, DIGITS), len(lines) / n)
    marks = [WORDS]
    for k, (value, edges) in enumerate(zip(measures, ((0.2, 0.3, 0.4, 0.5, 0.7), (0.2, 0.4, 0.6, 0.8), (0.2, 0.4, 0.6, 0.8), (0.01, 0.1, 0.25, 0.5), (0.05, 0.2, 0.5), (0.05, 0.2, 0.5), (0.01, 0.05, 0.2), (0.05, 0.2)), strict=True)):
        marks.append(WORDS + 1 + 6 * k + sum(value > e for e in edges))
    return np.concatenate([index, np.array(marks, np.int32)]), np.concatenate([values, np.ones(len(marks), np.float32)])


def meta_features(source: str | None, lang: str | None, text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of the metadata view."""
    size = int(np.log2(len(text or "") + 1))
    names = ("bias", f"s {source}", f"l {lang}", f"n {size}", f"sl {source} {lang}")
    index = sorted({zlib.crc32(name.encode()) % META for name in names})
    return np.array(index, np.int32), np.ones(len(index), np.float32)


class Rows:
    """Sparse rows."""

    def __init__(self, index: np.ndarray, values: np.ndarray, sizes: np.ndarray):
        self.index, self.values, self.n = index, values, len(sizes)
        self.owner = np.repeat(np.arange(len(sizes)), sizes)


def packed(text: str | None, source: str | None, lang: str | None) -> tuple[bytes, bytes, bytes, bytes]:
    """words and their values, marks, and metadata features of a document, as bytes."""
    index, values = text_features(text)
    is_word = index < WORDS
    meta, _ = meta_features(source, lang, text)
    return index[is_word].astype("<u2").tobytes(), values[is_word].astype("<f2").tobytes(), (index[~is_word] - WORDS).astype("u1").tobytes(), meta.astype("<u2").tobytes()


def unpacked(words: list[bytes], values: list[bytes], marks: list[bytes], meta: list[bytes]) -> tuple[Rows, Rows]:
    """The rows of both views."""
    n_words, n_marks = (np.array([len(x) for x in part], np.int64) for part in (words, marks))
    n_words //= 2
    index = np.concatenate([np.frombuffer(b"".join(words), "<u2").astype(np.int64), np.frombuffer(b"".join(marks), "u1").astype(np.int64) + WORDS])
    weight = np.concatenate([np.frombuffer(b"".join(values), "<f2").astype(float), np.ones(int(n_marks.sum()))])
    text = Rows(index, weight, np.zeros(len(words), np.int64))
    text.owner = np.concatenate([np.repeat(np.arange(len(words)), n) for n in (n_words, n_marks)])
    flat = np.frombuffer(b"".join(meta), "<u2").astype(np.int64)
    return text, Rows(flat, np.ones(len(flat)), np.array([len(x) // 2 for x in meta], np.int64))


@dataclass
class View:
    """A linear model: features are scaled, rows scaled down to length 1 at most, then weighted."""

    scale: np.ndarray
    weights: np.ndarray

    def scores(self, rows: Rows) -> np.ndarray:
        x = self.scale[rows.index] * rows.values
        norm = np.maximum(1.0, np.sqrt(np.bincount(rows.owner, weights=x * x, minlength=rows.n)))
        return np.bincount(rows.owner, weights=self.weights[rows.index] * x, minlength=rows.n) / norm


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def log_ratios(rows: Rows, labels: np.ndarray, importance: np.ndarray, size: int) -> np.ndarray:
    """Log-count ratios of the features between the classes; 0 where the evidence is weak."""
    counts = [np.bincount(rows.index, weights=(importance * own)[rows.owner], minlength=size) + 1 for own in (labels, 1 - labels)]
    totals = [float((importance * own).sum()) + 2 for own in (labels, 1 - labels)]
    ratio = np.log(counts[0] / totals[0]) - np.log(counts[1] / totals[1])
    error = np.sqrt(1 / counts[0] + 1 / counts[1])
    return np.where(np.abs(ratio) > 3 * error, ratio, 0.0)


def fit(rows: Rows, labels: np.ndarray, importance: np.ndarray, size: int, kept: slice, steps: int = 250, rate: float = 1.0, ridge: float = 1e-4) -> View:
    """Logistic regression on features scaled by their log-count ratios (those of kept by 1), by accelerated gradient steps."""
    scale = log_ratios(rows, labels, importance, size)
    scale[kept] = 1.0
    x = scale[rows.index] * rows.values
    norm = np.maximum(1.0, np.sqrt(np.bincount(rows.owner, weights=x * x, minlength=rows.n)))
    used = (x != 0) & (importance[rows.owner] > 0)
    index, owner = rows.index[used], rows.owner[used]
    x = x[used] / norm[owner]
    total = max(importance.sum(), 1e-9)
    weights, before = np.zeros(size), np.zeros(size)
    for step in range(steps):
        ahead = weights + step / (step + 3) * (weights - before)
        errors = (sigmoid(np.bincount(owner, weights=ahead[index] * x, minlength=rows.n)) - labels) * importance / total
        before, weights = weights, ahead - rate * (np.bincount(index, weights=errors[owner] * x, minlength=size) + ridge * ahead)
    return View(scale, weights)


def calibrate(scores: np.ndarray, labels: np.ndarray, steps: int = 400) -> np.ndarray:
    """Weights of columns of scores and a bias (last) that fit the labels best; the columns' weights are not negative."""
    x = np.column_stack([scores, np.ones(len(scores))])
    w = np.r_[np.full(scores.shape[1], 1.0 / scores.shape[1]), 0.0]
    squares = np.full(len(w), 1e-8)
    for _ in range(steps):
        g = x.T @ (sigmoid(x @ w) - labels) / len(x) + 1e-3 * np.r_[w[:-1], 0]
        squares += g**2
        w -= 0.2 * g / np.sqrt(squares)
        w[:-1] = np.maximum(w[:-1], 0)
    return w


@dataclass
class Model:
    text: View
    meta: View
    mix: np.ndarray

    def scores(self, text: Rows, meta: Rows) -> np.ndarray:
        return np.column_stack([self.text.scores(text), self.meta.scores(meta)])

    def probabilities(self, text: Rows, meta: Rows) -> np.ndarray:
        return sigmoid(self.scores(text, meta) @ self.mix[:2] + self.mix[2])


FEATURES = (("doc_id", "bigint"), ("words", "binary"), ("values", "binary"), ("marks", "binary"), ("meta", "binary"))
PARTS = [name for name, _ in FEATURES[1:]]


def features_of(docs: DataFrame) -> DataFrame:
    """doc_id and the packed features of every row; a narrow plan."""

    def make():
        def block(columns):
            ids, texts, langs, sources = columns
            rows = [packed(t, s, g) for t, g, s in zip(texts, langs, sources, strict=True)]
            return [ids, *(map(list, zip(*rows, strict=True)) if rows else [[]] * 4)]

        return block

    return arrow_map(docs.select("doc_id", "text", "lang", "source"), make, FEATURES)


def fetched(features: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each of the ids, a bounded number of them, that has one."""
    return features.join(F.broadcast(ids), "doc_id").groupBy("doc_id", *[c for c in ids.columns if c != "doc_id"]).agg(F.min(F.struct(*PARTS)).alias("x")).select("doc_id", *[c for c in ids.columns if c != "doc_id"], "x.*")


def scored_by(features: DataFrame, score, names: list[str]) -> DataFrame:
    """doc_id and the columns that score(text rows, metadata rows) gives for every row; a narrow plan."""

    def make():
        def block(columns):
            ids, *parts = columns
            return [ids, *(score(*unpacked(*parts)) if ids else [[]] * len(names))]

        return block

    return arrow_map(features, make, [("doc_id", "bigint"), *((name, "double") for name in names)], rows=2048)


class Learner:
    """One target's two views, what each learns from, and the best model so far."""

    def __init__(self, name: str, parts: list[tuple[bytes, ...]], labels: np.ndarray, held: np.ndarray):
        self.name, self.parts, self.held = name, [p for p, k in zip(parts, labels >= 0, strict=True) if k], held[labels >= 0]
        self.labels = labels[labels >= 0].astype(float)
        self.more: tuple[list[tuple[tuple[bytes, ...], float]], ...] = ([], [])  # pseudo-labelled rows by the view that learns from them
        self.best: tuple[float, Model | None] = (float("inf"), None)
        self.base = float(self.labels[~self.held].mean()) if (~self.held).any() else 0.5

    def fit(self) -> Model:
        views = []
        for k, (size, kept) in enumerate(((DIMENSIONS, slice(WORDS, None)), (META, slice(0, None)))):
            rows = unpacked(*map(list, zip(*self.parts, *(p for p, _ in self.more[k]), strict=True)))[k]
            labels = np.r_[self.labels, [y for _, y in self.more[k]]]
            weights = np.r_[(~self.held).astype(float), np.full(len(self.more[k]), 0.5)]
            views.append(fit(rows, labels, weights, size, kept))
        model = Model(*views, np.array([0.5, 0.5, 0.0]))
        if self.held.sum() >= 10:
            scores = model.scores(*unpacked(*map(list, zip(*[p for p, h in zip(self.parts, self.held, strict=True) if h], strict=True))))
            labels = self.labels[self.held]
            model.mix = calibrate(scores, labels)
            p = sigmoid(scores @ model.mix[:2] + model.mix[2]).clip(1e-9, 1 - 1e-9)
            loss = -float(np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p)))
        else:
            loss = -float(len(self.more[0]) + len(self.more[1]))
        if loss < self.best[0] - 1e-6:
            self.best = loss, model
        return model


def surest(features: DataFrame, labelled: DataFrame, chosen: DataFrame, models: dict[str, Model], bases: dict[str, float], most: int) -> DataFrame:
    """doc_id, target, view and label of the documents without a label that a view is surest of: for each target and view at most as many as most, by class as the labels are.

    The corpus is scored by a narrow stage. Approximate percentiles, with room for their
    error, leave few rows in question; only these are ordered.
    """
    names = [f"{target}_{view}" for target in models for view in (0, 1)]
    shared = features.sparkSession.sparkContext.broadcast(models)

    def score(text: Rows, meta: Rows) -> list[list[float]]:
        return [sigmoid(x).tolist() for model in shared.value.values() for x in model.scores(text, meta).T]

    scores = scored_by(features, score, names).join(labelled.select("doc_id"), "doc_id", "left_anti")
    # Whole millionths of the probability, and a fraction by the id for an order among equals.
    order = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    keyed = cut(scores.select("doc_id", *((F.floor(F.col(n) * 1e6) + order).alias(n) for n in names)))
    n_rows = keyed.count()
    wanted = {}
    for target in models:
        high = min(most - 1, max(1, round(most * bases[target])))
        wanted[target] = most - high, high
    accuracy = 10_000
    limits = keyed.agg(*(F.percentile_approx(n, [min(1.0, 2 * w[0] / max(n_rows, 1) + 2 / accuracy), max(0.0, 1 - 2 * w[1] / max(n_rows, 1) - 2 / accuracy)], accuracy).alias(n) for n in names for w in [wanted[n.rsplit("_", 1)[0]]])).first()
    parts = []
    for name in names:
        target, view = name.rsplit("_", 1)
        if limits[name] is None:
            continue
        for label, count in enumerate(wanted[target]):
            key = F.col(name) if label == 0 else -F.col(name)
            near = F.col(name) <= min(limits[name][0], (0.5 - SURE) * 1e6) if label == 0 else F.col(name) >= max(limits[name][1], (0.5 + SURE) * 1e6)
            parts.append(keyed.where(near).select("doc_id", F.lit(target).alias("target"), F.lit(int(view)).alias("view"), F.lit(label).alias("label"), key.alias("key"), F.lit(count).alias("most")))
    if not parts:
        return chosen.limit(0)
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = rows.join(F.broadcast(chosen.select("doc_id", "target", "view")), ["doc_id", "target", "view"], "left_anti").distinct()
    place = F.row_number().over(Window.partitionBy("target", "view", "label").orderBy("key", "doc_id"))
    return rows.withColumn("place", place).where("place <= most").select("doc_id", "target", "view", "label")


def train(features: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_pseudo: int = MAX_PSEUDO, rounds: int = ROUNDS) -> dict[str, Model]:
    spark = features.sparkSession
    agreed = labels.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    sample = agreed.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(max_labelled)
    rows = fetched(features, sample).orderBy("doc_id").collect()
    parts = [tuple(bytes(r[p]) for p in PARTS) for r in rows]
    held = np.array([zlib.crc32(str(r.doc_id).encode()) % 4 == 0 for r in rows], bool)
    learners = {}
    for target in TARGETS:
        known = np.array([-1 if r[target] is None else int(r[target] > 0) for r in rows], int)
        if (known >= 0).any():
            learners[target] = Learner(target, parts, known, held)
    models = {t: learner.fit() for t, learner in learners.items()}
    chosen = spark.createDataFrame([], "doc_id bigint, target string, view int, label int")
    for _ in range(rounds if learners else 0):
        ids = surest(features, agreed, chosen, models, {t: learner.base for t, learner in learners.items()}, max_pseudo).collect()
        if not ids:
            break
        found = spark.createDataFrame([tuple(r) for r in ids], chosen.schema)
        chosen = chosen.unionByName(found)
        for r in fetched(features, found).orderBy("doc_id", "target", "view").collect():
            learners[r.target].more[1 - r.view].append((tuple(bytes(r[p]) for p in PARTS), float(r.label)))
        models = {t: learner.fit() for t, learner in learners.items()}
    return {t: learner.best[1] for t, learner in learners.items()}


def classify(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_pseudo: int = MAX_PSEUDO, rounds: int = ROUNDS, least_quality: float = 0.5, most_toxic: float = 0.5) -> DataFrame:
    """doc_id, quality_score, toxic_score (probabilities) and kept of every row. No text is shuffled."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    own = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL")
    features = cut(features_of(source))
    trained = source.sparkSession.sparkContext.broadcast(train(features, own, max_labelled, max_pseudo, rounds))

    def score(text: Rows, meta: Rows) -> list[list[float]]:
        models = trained.value
        return [models[t].probabilities(text, meta).round(6).tolist() if t in models else [0.5] * text.n for t in TARGETS]

    scored = scored_by(features, score, ["quality_score", "toxic_score"])
    return scored.withColumn("kept", (F.col("quality_score") >= least_quality) & (F.col("toxic_score") <= most_toxic))
