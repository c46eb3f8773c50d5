import base64
import math
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from tests.llm.helpers import DOCUMENTS, EDGES, by_id, documents, edge_documents, no_documents, sha, words
from termloom.llm.decontamination import decontaminate, words_of
from termloom.llm.quality_classifier import UPPER, WORDS, classify, feature_of, packed, share, text_features, unpacked
from termloom.llm.quality_rules import KINDS, LANGUAGES, SCRIPTS, base_measures, quality_rules, script_of
from termloom.llm.queries import VOCABULARIES

PIECES = P.path("piece_bpe_32k.model")
ITEMS = "item_id bigint, text string"


def prose(r, n, vocabulary):
    return " ".join(r.choices(vocabulary, k=n))


def naive_measures(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def naive_verdicts(texts, paths, width=2.0, upper=4.0, least=30):
    """{id: (who stays, the measures that reject)} of texts {id: (text, language)}: medians and quartiles by sorting, tokens by the libraries word by word."""
    models = []
    for path in paths:
        if path.endswith(".model"):
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            models.append((lambda w, m=model: m.encode(w), model.is_byte))
        else:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
            model = tiktoken.Encoding("x", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
            parts = {r for t, r in ranks.items() if t.decode(errors="replace").encode() != t}
            models.append((lambda w, m=model: m.encode_ordinary(" " + w), parts.__contains__))
    rows = {}
    for i, (text, lang) in texts.items():
        n, chars, _, _, repeat = naive_measures(text)
        failed = n < 50 or 100 * repeat > 50 * n
        values = []
        for encode, is_byte in models:
            ids = [x for w in words(text) for x in encode(w)]
            counts = Counter(ids)
            entropy = -sum(c / len(ids) * math.log2(c / len(ids)) for c in counts.values()) if ids else 0
            values.append((chars / len(ids), sum(map(is_byte, ids)) / len(ids), entropy / math.log2(len(ids)) if len(ids) > 1 else 0) if ids else (0, 0, 0))
        letters = Counter(next(name for first, name in reversed(SCRIPTS) if ord(c) >= first) for c in text or "" if c.isalpha())
        script = max(letters, key=letters.get) if letters else "none"
        rows[i] = (failed, lang if lang in LANGUAGES else None, script, int(math.log2(max(n, 1))), values)
    passing = [r for r in rows.values() if not r[0]]

    def quartiles(k, j, row, by_length):
        _, lang, script, size, _ = row
        for same in ([lambda r: r[1] == lang and r[3] == size, lambda r: r[1] == lang] if lang else []) + [lambda r: r[2] == script and r[3] == size, lambda r: r[2] == script]:
            if not by_length and same(("", lang, script, -1, ())) is False:
                continue
            own = sorted(math.floor(r[4][k][j] * 10_000) / 10_000 for r in passing if same(r))
            if len(own) >= least:
                return [own[math.ceil(q * len(own)) - 1] for q in (0.25, 0.5, 0.75)]
        return None

    kept = {}
    for i, row in rows.items():
        out = []
        for j in range(3):
            beyond = []
            for k in range(len(models)):
                q = quartiles(k, j, row, j != 1)
                wide = max(q[2] - q[0], 0.01 if j == 1 else 0.02) if q else 0
                value = row[4][k][j]
                beyond.append(bool(q) and (j != 1 and value < q[1] - width * wide - 1e-12 or j == 0 and value > q[1] + upper * wide + 1e-12 or j == 1 and value > q[1] + width * wide + 1e-12))
            out += [KINDS[j]] * all(beyond)
        kept[i] = not row[0] and not out, out
    return kept


def test_verdicts_equal_a_plain_version(spark):
    """On the tables, and with texts that each band alone rejects, by language and by script."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    r = random.Random(11)
    cyrillic = ["".join(r.choices(["ени", "ова", "ство", "при", "про", "ста", "ного"], k=r.randint(1, 3))) for _ in range(3000)]
    latin = ["".join(r.choices("tion the and er ing st com pro ment able over under ship ness ful man out".split(), k=r.randint(1, 3))) for _ in range(3000)]
    rows = [(x.doc_id, x.text, x.lang) for x in docs.collect()]
    n = 100_000
    for script, vocabulary in (("xx", latin), ("yy", cyrillic)):  # languages outside the fixed list: the band of the script
        for _ in range(70):
            rows.append((n, prose(r, r.randint(70, 120), vocabulary), script))
            n += 1
    odd = {}
    for script, vocabulary in (("xx", latin), ("yy", cyrillic)):
        letters = "bcdfghjklmnpqrstvwxz" if script == "xx" else "бвгджзйклмнпрстфхцчшщъ"
        odd[f"{script} chars_per_token"] = " ".join("".join(r.choices(letters, k=6)) for _ in range(90))
        odd[f"{script} fallback_share"] = " ".join(w if k % 25 else chr(0x1F300 + k) for k, w in enumerate(prose(r, 100, vocabulary).split()))
        windows = set()  # five words in an order in which no window occurs twice
        few = [vocabulary[0], vocabulary[1]]
        while len(few) < 90:
            step = [w for w in vocabulary[:5] if (*few[-2:], w) not in windows]
            few.append(r.choice(step or vocabulary[:5]))
            windows.add(tuple(few[-3:]))
        odd[f"{script} token_entropy"] = " ".join(few)
    ids = {}
    for name, text in odd.items():
        ids[name] = n
        rows.append((n, text, name[:2]))
        n += 1
    rows.append((n, prose(r, 90, ["שלום", "עולם", "טוב", "יום", *(f"{c}{d}ל" for c in "אבגדהוז" for d in "חטיכלמנ")]), "zz"))  # a script with few texts: no band
    paths = [P.path(name) for name in VOCABULARIES]
    frame = spark.createDataFrame([(i, t, g, None, None) for i, t, g in rows], DOCUMENTS)
    got = by_id(quality_rules(frame, paths))
    want = naive_verdicts({i: (t, g) for i, t, g in rows}, paths)
    assert {i: x.kept for i, x in got.items()} == {i: kept for i, (kept, _) in want.items()}
    assert {name: want[i] for name, i in ids.items()} == {name: (False, [name[3:]]) for name in odd}
    assert got[n].kept and got[n].script == "hebrew"


def test_base_measures_equal_brute_force():
    r = random.Random(3)
    texts = [t for t in EDGES if t and len(t) < 1000] + ["".join(r.choices(["a", "b", " ", "\n", "é", "#", "ab "], k=r.randint(0, 80))) for _ in range(2000)]
    for t in texts:
        assert base_measures(t, t.encode().split()) == naive_measures(t), t


def test_quality_rules(spark):
    got = by_id(quality_rules(edge_documents(spark), PIECES))
    for i, t in enumerate(EDGES):
        n, chars, symbols, dup, repeat = naive_measures(t)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert got[i].base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert not (got[i].base_failed and got[i].kept)
    assert quality_rules(no_documents(spark), PIECES).count() == 0


def test_bands_reject_junk_and_keep_prose(spark):
    r = random.Random(5)
    vocabulary = ["".join(r.choices(["tion", "the", "and", "er", "ing", "st"], k=r.randint(1, 3))) for _ in range(3000)]
    texts = [prose(r, r.randint(60, 400), vocabulary) for _ in range(150)]
    junk = ["".join(chr(r.randint(0x1200, 0x1300)) if r.random() < 0.8 else " " for _ in range(600)) for _ in range(5)]
    got = by_id(quality_rules(documents(spark, texts + junk), PIECES))
    assert sum(got[i].kept for i in range(150)) >= 148
    assert not any(got[i].kept for i in range(150, 155))


def test_bands_reject_the_labelled_junk_of_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = quality_rules(docs, PIECES).where(~F.col("base_failed")).join(labels, "doc_id").collect()
    junk = [r.kept for r in found if r.quality == 0]
    clean = [r.kept for r in found if r.quality == 1]
    assert len(junk) >= 20 and sum(junk) <= 0.15 * len(junk)
    assert len(clean) >= 300 and sum(clean) >= 0.98 * len(clean)


def test_scripts_are_counted_over_whole_texts():
    assert script_of("abc " * 2000 + "где " * 3000) == "cyrillic"
    assert script_of("где " * 2000 + "abc " * 3000) == "latin"
    assert (script_of(""), script_of("123 ..."), script_of("٣٤ 12"), script_of("aב")) == ("none", "none", "none", "latin")


def test_too_many_characters_per_token_are_rejected(spark):
    r = random.Random(6)
    vocabulary = ["".join(r.choices(["tion", "the", "and", "er", "ing", "st"], k=r.randint(1, 3))) for _ in range(3000)]
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    pieces = [model.id_to_piece(i)[1:] for i in range(model.get_piece_size()) if model.id_to_piece(i)[0] == "\u2581" and len(model.id_to_piece(i)) > 9]
    texts = [prose(r, r.randint(60, 120), vocabulary) for _ in range(150)]
    docs = documents(spark, [*texts, " ".join(r.sample([p for p in pieces if p.isalpha()], 90))])
    assert by_id(quality_rules(docs, PIECES, upper_width=1e9))[150].kept
    assert not by_id(quality_rules(docs, PIECES))[150].kept


def test_words_with_digits_are_measured(spark):
    r = random.Random(7)
    vocabulary = ["".join(r.choices(["tion", "the", "and", "er", "ing", "st"], k=r.randint(1, 3))) for _ in range(3000)]
    prosaic = [prose(r, r.randint(60, 700), vocabulary) for _ in range(150)]
    keys = [f"{r.getrandbits(64):016x}" for _ in range(600)]
    log = [" ".join(f"{r.randint(10, 23)}:{r.randint(10, 59)} host{r.randint(1, 9)} {r.randint(100, 999)}ms" for _ in range(r.randint(30, 60))) for _ in range(60)]
    rows = [(i, t, "en", None, None) for i, t in enumerate([*prosaic, prose(r, 60, vocabulary) + " " + " ".join(keys)])]
    rows += [(1000 + i, t, "de", None, None) for i, t in enumerate(log)]
    got = by_id(quality_rules(spark.createDataFrame(rows, DOCUMENTS), PIECES))
    assert not got[150].kept
    assert sum(got[1000 + i].kept for i in range(60)) >= 50
    assert all(got[1000 + i].chars_per_token > 0 for i in range(60))


def contains_window(text, items, window=10):
    own = words_of(text)
    seen = {m: {tuple(own[i : i + m]) for i in range(len(own) - m + 1)} for m in range(1, window + 1)}
    return any(tuple(w[i : i + m]) in seen[m] for _, item in items if (w := words_of(item)) for m in [min(window, len(w))] for i in range(len(w) - m + 1))


def naive_hits(text, items, window=10):
    w = words_of(text)
    hit, found = [False] * len(w), set()
    for name, item in items:
        own = words_of(item)
        m = min(window, len(own))
        for i in range(len(own) - m + 1 if m else 0):
            for j in range(len(w) - m + 1):
                if w[j : j + m] == own[i : i + m]:
                    hit[j : j + m] = [True] * m
                    found.add(str(name))
    return len(w), sum(hit), len(found), sha(",".join(sorted(found))), any(hit)


def test_decontamination_equals_brute_force(spark):
    r = random.Random(9)
    vocabulary = ["a", "b", "c", "dé", "E", "f1"]
    items = [(i, prose(r, r.choice([1, 2, 3, 9, 10, 11, 14, 25]), vocabulary)) for i in range(12)] + [(50, None), (51, ""), (52, "!!!"), (10, prose(r, 12, vocabulary))]
    texts = [prose(r, r.randint(0, 120), [*vocabulary, "zz"]) + "-" + items[k % 12][1].upper() for k in range(80)] + [None, "", "?!"]
    bench = spark.createDataFrame(items, ITEMS)
    expected = {i: naive_hits(t, items) for i, t in enumerate(texts)}
    for slice_bytes in (8_000_000, 60):  # one slice of the benchmark, and many
        got = by_id(decontaminate(documents(spark, texts), bench, slice_bytes=slice_bytes))
        assert {i: (g.n_words, g.n_hit, g.n_items, g.items_sha256, g.contaminated) for i, g in got.items()} == expected


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, "same text again")], ITEMS)
    got = by_id(decontaminate(edge_documents(spark), bench))
    assert [i for i in range(len(EDGES)) if got[i].contaminated] == [9, 10]
    assert not any(r.contaminated for r in decontaminate(edge_documents(spark), spark.createDataFrame([], ITEMS)).collect())
    assert decontaminate(no_documents(spark), bench).count() == 0


def test_decontamination_ignores_further_columns(spark):
    bench = spark.createDataFrame([(1, "same text again", "x", 1, "y")], f"{ITEMS}, item string, size int, words string")
    for slice_bytes in (8_000_000, 0):
        got = by_id(decontaminate(edge_documents(spark), bench, slice_bytes=slice_bytes))
        assert [i for i in range(len(EDGES)) if got[i].contaminated] == [9, 10]


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = classify(docs, labels.where("doc_id % 4 <> 0")).join(labels.where("doc_id % 4 = 0"), "doc_id").collect()
    good = [(r.quality_score >= 0.5) == (r.quality == 1) for r in found]
    assert sum(good) >= 0.9 * len(good)
    clean = [r.kept for r in found if r.quality == 1 and r.toxic == 0]
    assert sum(clean) >= 0.95 * len(clean)


def naive_features(text):
    w = (text or "").encode().lower().split()
    counts = Counter(i for x in w for i in feature_of(x))
    n, raw, lines = len(w), (text or "").encode(), (text or "").split("\n")
    if not n:
        return {WORDS: 1.0}
    upper, digits = (sum(b in of for b in raw) / len(raw) for of in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"))
    measures = [math.log1p(n) / 10, (len(text) - n) / n / 10, len(set(w)) / n, min(sum(c in "#*$%&|<>" for c in text) / n, 4) / 2, 1 - len(set(lines)) / len(lines), upper, digits, len(lines) / n]
    edges = [(0.2, 0.3, 0.4, 0.5, 0.7), (0.2, 0.4, 0.6, 0.8), (0.2, 0.4, 0.6, 0.8), (0.01, 0.1, 0.25, 0.5), (0.05, 0.2, 0.5), (0.05, 0.2, 0.5), (0.01, 0.05, 0.2), (0.05, 0.2)]
    found = {i: math.log1p(c) / 2 for i, c in counts.items()} | {WORDS: 1.0}
    return found | {WORDS + 1 + 6 * k + sum(m > e for e in own): 1.0 for k, (m, own) in enumerate(zip(measures, edges, strict=True))}


def test_features_equal_brute_force():
    r = random.Random(12)
    texts = EDGES + ["".join(r.choices(["a ", "B", "c1 ", "\n", "É", "#", "word "], k=r.randint(1, 3000))) for _ in range(300)]
    for text in texts:
        index, values = text_features(text)
        want = naive_features(text)
        assert dict(zip(index.tolist(), values.tolist())) == pytest.approx(want), text
        words, weights, marks, _ = packed(text, None, None)
        text_rows, _ = unpacked([words], [weights], [marks], [b""])
        assert dict(zip(text_rows.index.tolist(), text_rows.values.tolist())) == pytest.approx(want, rel=2e-3)


@pytest.mark.parametrize("n", [4095, 4096, 5000, 6100, 100_001])
def test_capitals_are_counted_over_whole_texts(n):
    raw = ("aB" * n)[:n].encode()
    assert share(raw, UPPER) == pytest.approx((n // 2) / n)
    assert share(raw[: n // 2] + b"x" * (n - n // 2), UPPER) == pytest.approx((n // 4) / n)


def test_rounds_do_no_harm(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    for split in range(2):
        chosen = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(split)), F.lit(2)) == 0)
        held = labels.join(chosen, "doc_id", "left_anti")
        right = []
        for rounds in (0, 2):
            found = classify(docs, chosen, rounds=rounds).join(held, "doc_id").collect()
            right.append(sum((r.quality_score >= 0.5) == (r.quality == 1) for r in found) + sum((r.toxic_score > 0.5) == (r.toxic == 1) for r in found))
        assert right[1] >= right[0] - 0.01 * len(found)


def test_classifier_ignores_further_columns(spark):
    docs, labels = edge_documents(spark), spark.createDataFrame([(i, i % 2, 0, "x", 2) for i in range(12)], "doc_id bigint, quality int, toxic int, text string, words int")
    plain = sorted(map(tuple, classify(docs, labels.select("doc_id", "quality", "toxic")).collect()), key=repr)
    assert sorted(map(tuple, classify(docs, labels).collect()), key=repr) == plain


def test_classifier_edges(spark):
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 0), (3, None, 1), (None, 1, 1), (4, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert classify(edge_documents(spark), labels).count() == len(EDGES) + 2
    none = classify(edge_documents(spark), labels.limit(0)).collect()
    assert all(r.kept and r.quality_score == 0.5 for r in none)
    assert classify(no_documents(spark), labels).count() == 0


def test_quality_bands_start_no_workers_of_their_own(spark, capsys):
    """A table of bands made from a list would be read by further Python workers on the executors."""
    quality_rules(documents(spark, ["some words"]).localCheckpoint(), P.path(VOCABULARIES[0])).explain("formatted")
    plan = capsys.readouterr().out
    assert "LocalTableScan" in plan and "ExistingRDD" not in plan
