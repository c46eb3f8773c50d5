"""Personal data: fixed patterns and a skip-chain conditional random field.

The patterns find e-mail addresses, IPv4 addresses, payment cards and phone numbers. The
field adds what they miss. Its nodes are the words with a digit, ``@`` or ``+`` (all
others cannot carry a label). What is observed of a node is a pattern's match or a match
that failed its check, the word's form, and the words beside it. Neighbouring nodes share a
chain potential. Distant nodes share skip potentials, of one kind if their words are equal
but for punctuation (and have six letters or digits or more), of another if they are similar: equal in their last seven digits, or
one the local part of the other's address. Loopy sum-product message passing over the
graphs of a whole block of documents at once gives the labels, so that a document labels a
repeated or similar word consistently: of a number that is given in full once, a later
mention without its prefix is found too.

The weights are fitted by pseudo-likelihood on a bounded sample of whole documents. Labels
are the patterns' spans; a node that no pattern matches, but a skip edge ties to one that
is matched, has no known label and is left out. For half of the nodes that a pattern matches the match is hidden,
and for some the form too, so that form, context and the potentials have to explain the
label; elsewhere a node without a match is in the same position. A match that failed its
check (Luhn, number of digits, parts above 255) is seen as such and learned as no personal
data: only other evidence can outweigh it. Skip potentials are drawn towards equal labels.

Null and empty texts have no spans, an empty table gives an empty table. Texts and words of
any length are read whole, in time proportional to their length. Repeated rows give repeated
results. Of equally probable labels the first in the order of kinds counts. Offsets are code
points, ends exclusive. Spans of one kind do not overlap. Further columns, whatever their
names, are not read, and are kept as they are by masking.
"""

from __future__ import annotations

import re
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.common import arrow_map, documents, leave_to, ready

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Documents that the weights are fitted on, and nodes of all these together, at most; documents are taken whole.
SAMPLE_DOCUMENTS, SAMPLE_NODES = 4_000, 100_000
FEATURES = 1 << 14
#: What skip potentials of equal labels are drawn to.
ALIKE = 9.0
#: Rounds of message passing, at most, and the change of messages at which it ends.
ROUNDS, SETTLED = 60, 1e-5
#: A node's probability of a label from which it becomes a span.
CERTAIN = 0.9

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+").match
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}").finditer
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
WORD = re.compile(r"[^\x20\x09-\x0D]+").finditer
HINT = re.compile(r"[0-9@+]").search
#: Last digits that similar numbers have in common, and letters and digits of words that skip edges tie at least.
TAIL, LEAST = 7, 6
EDGES = " \t\r\n.,;:!?\"'`*#$%&|<>[]{}="

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def digits_in(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def emails(text: str) -> list[Span]:
    """Leftmost matches, found from each @ outwards in linear time: a local part cannot hold one, so each @ has its own."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            found.append((start, done))
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> tuple[dict[str, list[Span]], list[Span]]:
    """The spans of each kind, and the matches that failed their check."""
    spans: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    failed: list[Span] = []
    spans["email"] = emails(text)
    for m in ADDRESS(text):
        good = all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m[0].split("."))
        (spans["ip"] if good else failed).append(m.span())
    for m in CARD(text):
        digits = digits_in(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans["card"].append(m.span())
        elif len(digits) >= 9:
            failed.append(m.span())
    for m in PHONE(text):
        (spans["phone"] if 9 <= len(digits_in(m[0])) <= 15 else failed).append(m.span())
    return spans, failed


def form(word: str) -> str:
    """The word with each run of letters and each run of digits as one character."""
    return re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", word))


def bare(word: str) -> str:
    """The letters and digits of a word, in lower case."""
    return re.sub(r"[\W_]+", "", word).lower()


def feature(name: str) -> int:
    return zlib.crc32(name.encode()) % FEATURES


class Nodes:
    """The candidate words of one document."""

    def __init__(self, text: str):
        self.spans: list[Span] = []
        self.words: list[str] = []
        self.beside: list[tuple[str, str]] = []  # the words before and after
        self.adjacent: list[bool] = []  # to the node before
        end, before, last_node = 0, "", False
        for m in WORD(text):
            word = m[0]
            is_node = HINT(word) is not None
            if last_node:
                self.beside[-1] = (self.beside[-1][0], word)
            if is_node:
                start, stop = m.span()
                core = word.strip(EDGES)
                start += len(word) - len(word.lstrip(EDGES))
                stop = start + len(core)
                self.adjacent.append(last_node and m.start() - end == 1)
                self.spans.append((start, stop))
                self.words.append(core)
                self.beside.append((before, ""))
            before, last_node, end = word, is_node, m.end()

    def features(self, evidence: list[tuple[int, bool]], hidden: list[int] | None = None) -> list[list[int]]:
        """Hashed features. evidence: (label that a pattern gives, a match failed its check); hidden: 1 hides evidence, 2 the form too."""
        forms = [form(w) for w in self.words]
        out = []
        for i, word in enumerate(self.words):
            hide = hidden[i] if hidden else 0
            label, failed = evidence[i]
            n = len(digits_in(word))
            before, after = (bare(w) if HINT(w) is None else "0" for w in self.beside[i])
            seen = f"m {label}" if label and not hide else "failed" if failed and not label else "open"
            shown = ("", "", "") if hide > 1 else (f"s {forms[i]}", f"n {min(n, 24)}", f"@ {word.count('@')} {n > 0}")
            out.append([feature(x) for x in ("bias", seen, *shown, f"b {before}", f"a {after}")])
        return out

    def edges(self) -> list[tuple[int, int, int]]:
        """(node, later node, 0 for neighbours, 1 for equal words, 2 for similar ones); each node is tied to the last one of its key, so there are at most four for each node."""
        found = [(i - 1, i, 0) for i in range(1, len(self.words)) if self.adjacent[i]]
        last: dict[tuple, int] = {}
        for i, word in enumerate(self.words):
            whole, digits = bare(word), digits_in(word)
            keys = [(1, whole), (2, bare(word.split("@")[0]))]
            if len(digits) >= TAIL:
                keys.append((2, digits[-TAIL:]))
            tied = set()
            for key in dict.fromkeys(keys):
                if len(key[1]) >= LEAST:
                    other = last.get(key)
                    if other is not None and other not in tied:
                        tied.add(other)
                        found.append((other, i, key[0]))
                    last[key] = i
        return found


def touched(spans: list[Span], others: list[Span]) -> list[bool]:
    """Whether each span, in order and apart, overlaps one of the others, in order of their starts and ends; both lists are walked once."""
    out, k = [], 0
    for start, stop in spans:
        while k < len(others) and others[k][1] <= start:
            k += 1
        out.append(k < len(others) and others[k][0] < stop and start < stop)
    return out


def evidence_of(nodes: Nodes, spans: dict[str, list[Span]], failed: list[Span]) -> list[tuple[int, bool]]:
    """(label of the first kind whose span a node overlaps, 0 for none; whether it overlaps a match that failed)."""
    by_kind = [touched(nodes.spans, spans[kind]) for kind in KINDS]
    bad = touched(nodes.spans, united(failed))
    return [(next((k for k, hit in enumerate(hits, 1) if hit), 0), no) for hits, no in zip(zip(*by_kind), bad)]


def targets(evidence: list[tuple[int, bool]], edges: list[tuple[int, int, int]]) -> list[int]:
    """The label of each node, -1 where it is unknown."""
    out = [label for label, _ in evidence]
    for u, v, kind in edges:
        for a, b in ((u, v), (v, u)):
            if kind and evidence[a][0] and not evidence[b][0] and not evidence[b][1]:
                out[b] = -1
    return out


def united(spans: list[Span]) -> list[Span]:
    """The spans in order, overlapping ones as one."""
    out: list[Span] = []
    for start, stop in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


class Field:
    """Weights of the nodes' features and of the three types of edges."""

    def __init__(self, unary: np.ndarray, pair: np.ndarray):
        self.unary, self.pair = unary, pair

    @staticmethod
    def fit(features: np.ndarray, labels: np.ndarray, edges: np.ndarray, steps: int = 200, rate: float = 0.3, ridge: float = 1e-3) -> Field:
        """Pseudo-likelihood: each node given its neighbours' labels, by gradient steps with a running scale."""
        k = len(LABELS)
        unary, prior = np.zeros((FEATURES, k)), np.zeros((3, k, k))
        prior[1:] = ALIKE * np.eye(k)
        pair = prior.copy()
        known = labels >= 0
        n = int(known.sum())
        if not n:
            unary[:, 0] = 1.0
            return Field(unary, pair)
        # Nodes without a label are left out with their edges.
        new = np.cumsum(known) - 1
        edges = edges[known[edges[:, 0]] & known[edges[:, 1]]]
        features, labels = features[known], labels[known]
        one = np.zeros((n, k))
        one[np.arange(n), labels] = 1
        u, v, t = new[edges[:, 0]], new[edges[:, 1]], edges[:, 2]
        # Rows of pair[t] by label of the earlier node; the skip potentials are the same both ways.
        into = np.r_[v, u]
        cell = np.r_[t * k + labels[u], (3 + t) * k + labels[v]]
        flat = features.ravel()
        width = features.shape[1]
        g2u, g2p = np.full_like(unary, 1e-8), np.full_like(pair, 1e-8)
        for _ in range(steps):
            both = np.concatenate([pair.reshape(3 * k, k), pair.transpose(0, 2, 1).reshape(3 * k, k)])
            score = unary[features].sum(axis=1)
            for label in range(k):
                score[:, label] += np.bincount(into, weights=both[cell, label], minlength=n)
            score -= score.max(axis=1, keepdims=True)
            p = np.exp(score)
            p /= p.sum(axis=1, keepdims=True)
            error = (p - one) / n
            gu, gb = np.empty_like(unary), np.empty((6 * k, k))
            for label in range(k):
                gu[:, label] = np.bincount(flat, weights=np.repeat(error[:, label], width), minlength=FEATURES)
                gb[:, label] = np.bincount(cell, weights=error[into, label], minlength=6 * k)
            gu += ridge / n * unary
            gp = gb[: 3 * k].reshape(3, k, k) + gb[3 * k :].reshape(3, k, k).transpose(0, 2, 1) + ridge * (pair - prior)
            gp[1:] = (gp[1:] + gp[1:].transpose(0, 2, 1)) / 2
            g2u += gu**2
            g2p += gp**2
            unary -= rate * gu / np.sqrt(g2u)
            pair -= rate * gp / np.sqrt(g2p)
        return Field(unary, pair)

    def marginals(self, features: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Probabilities of the labels by loopy message passing, half damped, until the messages settle; exact where the graph has no loops."""
        unary = self.unary[features].sum(axis=1)
        belief = unary.copy()
        if len(edges):
            u, v, t = edges.T
            source, target = np.r_[u, v], np.r_[v, u]
            potential = np.concatenate([self.pair[t], self.pair[t].transpose(0, 2, 1)])
            m = len(u)
            reverse = np.r_[np.arange(m, 2 * m), np.arange(m)]
            messages = np.zeros((2 * m, len(LABELS)))
            for _ in range(ROUNDS):
                out = (belief[source] - messages[reverse])[:, :, None] + potential
                top = out.max(axis=1, keepdims=True)
                new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
                new -= new.max(axis=1, keepdims=True)
                change = np.abs(new - messages).max()
                messages = 0.5 * messages + 0.5 * new
                for label in range(len(LABELS)):
                    belief[:, label] = unary[:, label] + np.bincount(target, weights=messages[:, label], minlength=len(unary))
                if change < SETTLED:
                    break
        belief -= belief.max(axis=1, keepdims=True)
        p = np.exp(belief)
        return p / p.sum(axis=1, keepdims=True)


def fit_field(docs: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS, sample_nodes: int = SAMPLE_NODES) -> Field:
    """Fit on at most sample_documents texts with a digit, @ or +, in the order of a hash of their ids among a share of all rows; of these, on whole documents as long as their nodes are no more than sample_nodes together."""
    rows = docs.count()
    share = max(1, rows // (10 * sample_documents))
    hashed = F.xxhash64("id", F.length("text"))
    source = docs.where((F.pmod(hashed, F.lit(share)) == 0) & F.col("text").rlike("[0-9@+]"))

    def make():
        def block(columns):
            rows = []
            for text in columns[1]:
                nodes = Nodes(text)
                evidence, edges = evidence_of(nodes, *base_spans(text)), nodes.edges()
                # One in two with the evidence, one in four without it, one in four without the form too.
                hidden = [(0, 0, 1, 2)[zlib.crc32(f"{i} {w}".encode()) % 4] for i, w in enumerate(nodes.words)]
                fits = len(nodes.words) <= sample_nodes  # a longer one can't be taken whole
                rows.append(([x for f in nodes.features(evidence, hidden) for x in f], targets(evidence, edges), [x for e in edges for x in e]) if fits else ([], [], []))
            return [columns[0], [len(r[1]) for r in rows], *(map(list, zip(*rows, strict=True)) if rows else [[]] * 3)]

        return block

    found = arrow_map(source, make, [("id", "bigint"), ("n", "bigint"), ("features", "array<int>"), ("labels", "array<int>"), ("edges", "array<int>")])
    order = (F.xxhash64("id"), F.col("id"), F.col("labels"), F.col("features"), F.col("edges"))
    sample = found.where("n > 0").orderBy(*order).limit(sample_documents)
    together = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    features, labels, edges, at = [], [], [], 0
    for row in sample.withColumn("together", F.sum("n").over(together)).where(F.col("together") <= sample_nodes).collect():
        own = np.array(row.edges, int).reshape(-1, 3)
        own[:, :2] += at
        at += len(row.labels)
        features.append(np.array(row.features, int).reshape(len(row.labels), -1))
        labels.append(np.array(row.labels, int))
        edges.append(own)
    if not at:
        return Field.fit(np.zeros((0, 7), int), np.zeros(0, int), np.zeros((0, 3), int))
    return Field.fit(np.concatenate(features), np.concatenate(labels), np.concatenate(edges))


def added_spans(nodes: Nodes, p: np.ndarray, spans: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans of nodes that are certain of a label and overlap no span of the patterns; neighbours of one label are one span."""
    taken = touched(nodes.spans, united([s for own in spans.values() for s in own]))
    found: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    last = None
    for i, (span, row) in enumerate(zip(nodes.spans, p, strict=True)):
        k = int(row.argmax())
        if not k or row[k] < CERTAIN or span[0] >= span[1] or taken[i]:
            last = None
            continue
        own = found[LABELS[k]]
        if last == k and nodes.adjacent[i] and k != 1:
            own[-1] = (own[-1][0], span[1])
        else:
            own.append(span)
        last = k
    return found


def find_block(field: Field, texts: list[str | None]) -> list[tuple[dict[str, list[Span]], dict[str, list[Span]]]]:
    """(the patterns' spans, the field's spans) of each text; one graph for the block."""
    found, graphs, features, edges, at = [], [], [], [], 0
    for i, text in enumerate(texts):
        if not text or not HINT(text):
            found.append(({k: [] for k in KINDS}, {k: [] for k in KINDS}))
            continue
        nodes = Nodes(text)
        spans, failed = base_spans(text)
        found.append((spans, {k: [] for k in KINDS}))
        graphs.append((i, nodes, at))
        features += nodes.features(evidence_of(nodes, spans, failed))
        edges += [(u + at, v + at, t) for u, v, t in nodes.edges()]
        at += len(nodes.words)
    if features:
        p = field.marginals(np.array(features), np.array(edges, int).reshape(-1, 3))
        for i, nodes, start in graphs:
            spans = found[i][0]
            found[i] = (spans, added_spans(nodes, p[start : start + len(nodes.words)], spans))
    return found


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join([f"{kind}:{a}:{b}" for kind in KINDS for a, b in sorted(spans[kind])])


def find_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample_documents: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone and base_sha256 of the patterns' spans, and spans, all of them; one narrow stage."""
    source = documents(docs, id_column, text_column)
    field = fit_field(source, sample_documents)

    def make():
        def block(columns):
            rows = []
            for base, more in find_block(field, columns[1]):
                both = {k: base[k] + more[k] for k in KINDS}
                rows.append((*(len(base[k]) for k in KINDS), sha256(joined(base).encode()).hexdigest(), joined(both)))
            return [columns[0], *(map(list, zip(*rows, strict=True)) if rows else [[]] * 6)]

        return block

    schema = [(id_column, "bigint"), *((f"n_{k}", "bigint") for k in KINDS), ("base_sha256", "string"), ("spans", "string")]
    return arrow_map(source, make, schema)


def masked(text: str, spans: dict[str, list[Span]]) -> str:
    """The text with each span (overlapping ones as one) replaced by the name of its kind in brackets."""
    flat = sorted((a, b, kind) for kind in KINDS for a, b in spans[kind])
    out, at, end = [], 0, -1
    for a, b, kind in flat:
        if a < end:
            end = max(end, b)
            continue
        if end >= 0:
            at = end
        out += [text[at:a], f"[{kind.upper()}]"]
        end = b
    out.append(text[max(end, 0) :])
    return "".join(out)


def mask_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample_documents: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """The same rows and columns, personal data in the text replaced by the name of its kind."""
    field = fit_field(documents(docs, id_column, text_column), sample_documents)
    at = docs.columns.index(text_column)

    def run(batches):
        leave_to(__name__)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = part.column(at).to_pylist()
                found = find_block(field, texts)
                new = pa.array([masked(t, {k: b[k] + m[k] for k in KINDS}) if t else t for t, (b, m) in zip(texts, found, strict=True)], part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(part.columns)], schema=part.schema)

    ready(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
