import itertools
import random
import re
import time

import numpy as np
import pytest

from tests.llm.helpers import EDGES, by_id, documents, edge_documents, no_documents, sha
from termloom.llm.common import documents as as_documents
from termloom.llm.pii import FEATURES, KINDS, LABELS, Field, base_spans, find_block, find_pii, fit_field, form, luhn, mask_pii, masked
from termloom.llm.secret_scans import ANYTHING, BASE_RULES, MORE_RULES, Rule, any_of, scan_secrets, trigram_query

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def naive_secrets(t):
    t = t or ""
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [sum(k == kind for _, k, _ in found) for kind in range(3)], sha(",".join(x for *_, x in sorted(found)))


def test_secrets_equal_brute_force(spark):
    r = random.Random(5)
    parts = ["token", "secret", " ", "=", ":", '"', "AKIA", "password", "a1b2c3d4e5f6", "abcdef", "ABCDEFGH1234", "é", "😀", "\n", "Api_Key", "x", "Z9"]
    texts = ["secret: token = abcdef", "password=password=abcdefg", "AKIA" * 9, "token=abc", *("".join(r.choices(parts, k=r.randint(1, 40))) for _ in range(600)), None, ""]
    got = by_id(scan_secrets(documents(spark, texts)))
    for i, t in enumerate(texts):
        assert ([got[i].n_assign, got[i].n_access, got[i].n_hex], got[i].base_sha256) == naive_secrets(t), t


def test_secret_formats_and_edges(spark):
    texts = ["ghp_" + "a" * 40, "-----BEGIN RSA PRIVATE KEY-----", "see https://user:pw@host.example/x", "clean prose"]
    got = by_id(scan_secrets(documents(spark, texts)))
    assert [got[i].spans for i in range(4)] == ["github:0:44,hex:4:44", "private_key:0:31", "url_login:4:32", ""]
    assert scan_secrets(edge_documents(spark)).count() == len(EDGES) + 2
    assert scan_secrets(no_documents(spark)).count() == 0
    only = scan_secrets(documents(spark, texts), more=())
    assert only.count() == 4


def test_trigram_queries():
    assert trigram_query("abcd") == frozenset([frozenset(["abc", "bcd"])])
    assert trigram_query("(abc|xyz)+") == frozenset([frozenset(["abc"]), frozenset(["xyz"])])
    assert trigram_query("ab?c?d") == ANYTHING
    assert trigram_query("a[bc]d") == frozenset([frozenset(["abd"]), frozenset(["acd"])])
    assert trigram_query("[0-9a-f]{24,}") == ANYTHING
    assert trigram_query("(abc)?def") == frozenset([frozenset(["def"])])


@pytest.mark.parametrize("rule", [*BASE_RULES, *MORE_RULES, Rule("x", "(foo|ba[rz]+q?u)[0-9]+end"), Rule("y", "(?i:AbC)x*(de|fg)h{2}")])
def test_a_match_satisfies_its_query(rule):
    """Random texts near the pattern: whatever matches has all trigrams of some clause."""
    r = random.Random(rule.kind)
    pieces = ["foo", "bar", "baz", "u", "end", "12", "abc", "ABC", "x", "de", "fg", "hh", "token", "=", "abcdef", "AKIA", "A" * 16, "ghp_", "a" * 36, "eyJ", "a" * 8, ".", "xoxb-", "sk_live_", "AIza", "://", "h", "u:p@h"]
    for _ in range(1500):
        text = "".join(r.choices(pieces, k=r.randint(1, 12)))
        if re.search(rule.pattern, text):
            low = text.lower()
            assert any(all(t in low for t in clause) for clause in trigram_query(rule.pattern)), text


def naive_pii(t):
    out = {}
    for kind, pattern in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out[kind].append(m.span())
    return out


def test_luhn():
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def test_base_spans_equal_brute_force():
    r = random.Random(3)
    for _ in range(20_000):
        text = "".join(r.choices("ab1290.@+- ()%_", k=r.randint(1, 60)))
        assert base_spans(text)[0] == naive_pii(text), text
    assert base_spans("a" * 200_000 + " b@c.d")[0]["email"] == [(200_001, 200_006)]


def test_pii_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = by_id(find_pii(docs))
    for row in docs.collect():
        spans = naive_pii(row.text)
        joined = ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])
        assert [got[row.doc_id][f"n_{k}"] for k in KINDS] == [len(spans[k]) for k in KINDS]
        assert got[row.doc_id].base_sha256 == sha(joined)
        assert set(filter(None, joined.split(","))) <= set(got[row.doc_id].spans.split(","))


def test_a_failed_check_stands_without_other_evidence(spark):
    r = random.Random(1)
    texts = []
    for _ in range(200):
        number = "".join(r.choices("0123456789", k=15))
        full = next(number + c for c in "0123456789" if luhn(number + c))
        texts.append(f"some words {full} and more text, then 12 apples")
    texts.append("another 4111111111111112 here and 15 pears")
    got = by_id(find_pii(documents(spark, texts)))
    assert got[200].n_card == 0 and got[200].spans == ""
    assert got[0].spans == "card:11:27"


def repeated_mentions():
    """Texts and the span that a repeated mention has: of a phone without its prefix, of an address' local part, or none where nothing is given in full."""
    r = random.Random(4)
    vocabulary = ["".join(r.choices("abcdefghij", k=5)) for _ in range(400)]

    def prose(n):
        return " ".join(r.choices(vocabulary, k=n))

    out = []
    for i in range(400):
        number, user = f"{r.randint(200, 999)}-{r.randint(1000, 9999)}", f"{r.choice(vocabulary)}{r.randint(10, 99)}"
        if i % 4 == 0:
            before, tail = f"{prose(8)} +1 ({r.randint(200, 999)}) {number} {prose(12)} ", number
        elif i % 4 == 1:
            before, tail = f"{prose(6)} {user}@mail.example.com {prose(9)} ", user
        else:
            before, tail = f"{prose(8)} {number if i % 4 == 2 else user} {prose(9)} {r.randint(1, 300)} {prose(4)} ", ""
        out.append((f"{before}{tail} {prose(5)}", (len(before), len(before) + len(tail)) if tail else None))
    return out


def test_skip_edges_find_repeated_mentions(spark):
    cases = repeated_mentions()
    field = fit_field(as_documents(documents(spark, [t for t, _ in cases]), "doc_id", "text"))

    def score(own):
        found = [{s for kind in KINDS for s in more[kind]} for _, more in find_block(own, [t for t, _ in cases])]
        return sum(s in f for f, (_, s) in zip(found, cases, strict=True) if s), sum(len(f - {s}) for f, (_, s) in zip(found, cases, strict=True))

    right, wrong = score(field)
    assert right >= 100 and wrong <= 4
    alone = Field(field.unary, field.pair.copy())
    alone.pair[1:] = 0
    assert score(alone)[0] <= 20


def test_marginals_equal_enumeration():
    r = np.random.default_rng(0)
    field = Field(np.zeros((FEATURES, len(LABELS))), r.normal(size=(3, len(LABELS), len(LABELS))))
    field.pair[1:] = (field.pair[1:] + field.pair[1:].transpose(0, 2, 1)) / 2
    for edges, error in (([(0, 1, 0), (1, 2, 1), (1, 3, 2), (3, 4, 0)], 1e-4), ([(0, 1, 0), (1, 2, 0), (0, 2, 1)], 0.02)):  # a tree, a loop
        n = 1 + max(v for _, v, _ in edges)
        features = r.integers(0, FEATURES, (n, 3))
        field.unary[features.ravel()] = r.normal(size=(3 * n, len(LABELS)))
        unary, exact = field.unary[features].sum(axis=1), np.zeros((n, len(LABELS)))
        for labels in itertools.product(range(len(LABELS)), repeat=n):
            weight = np.exp(sum(unary[i, k] for i, k in enumerate(labels)) + sum(field.pair[t, labels[a], labels[b]] for a, b, t in edges))
            for i, k in enumerate(labels):
                exact[i, k] += weight
        exact /= exact.sum(axis=1, keepdims=True)
        assert np.abs(field.marginals(features, np.array(edges)) - exact).max() < error


def test_pii_of_long_texts_is_linear():
    field = Field.fit(np.zeros((0, 7), int), np.zeros(0, int), np.zeros((0, 3), int))
    text = " ".join(f"+1 (555) {i % 900 + 100}-{i % 9000 + 1000}" for i in range(30_000)) + " " + "1-" * 200_000
    began = time.perf_counter()
    found = find_block(field, [text])[0][0]
    assert len(found["phone"]) >= 29_999 and not found["card"]
    assert time.perf_counter() - began < 60


def test_middles_of_long_words_count():
    assert form("a" * 60 + "1" * 60 + "@" + "b" * 60) == "a9@a"
    assert form("a" * 60 + "1" * 60 + "b" * 60) == "a9a"


def test_many_secrets_in_one_text(spark):
    text = " ".join(f"token=abc{i:06d}" for i in range(100_000))
    began = time.perf_counter()
    row = scan_secrets(documents(spark, [text])).collect()[0]
    assert ([row.n_assign, row.n_access, row.n_hex], row.base_sha256) == naive_secrets(text)
    assert time.perf_counter() - began < 60


def test_named_trigrams_are_found_in_one_pass():
    r = random.Random(6)
    named = ["abc", "abd", "bca", "a_b", "--x", "x y"]
    for _ in range(500):
        text = "".join(r.choices("abcdx_- y", k=r.randint(0, 30)))
        assert set(re.findall(f"(?=({any_of(named).replace(chr(92) + 'x{', chr(92) + 'x').replace('}', '')}))", text)) == {t for t in named if t in text}


def test_pii_edges_and_masking(spark):
    assert find_pii(edge_documents(spark)).count() == len(EDGES) + 2
    assert find_pii(no_documents(spark)).count() == 0
    assert masked("to a@b.c now", {"email": [(3, 8)], "ip": [], "card": [], "phone": [(5, 8)]}) == "to [EMAIL] now"
    docs = edge_documents(spark)
    out = mask_pii(docs)
    assert out.schema == docs.schema
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted((tuple(r) for r in docs.collect()), key=repr)
    assert mask_pii(documents(spark, ["mail x@y.zz or +1 (555) 555-7713."])).first().text == "mail [EMAIL] or [PHONE]."
