import random

import pytest

from tests.llm.helpers import EDGES, by_id, documents, edge_documents, no_documents
from termloom.llm.jaccard_join import components, jaccard_components, parity_bits, shingle_set


def naive_components(texts, width=3, percent=90):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(25):
        base = r.choices(vocabulary, k=r.choice([1, 2, 3, 9, 11, 12, 13, 20, 40, 80, 300]))
        for _ in range(r.randint(1, 14)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                if w:
                    k = r.randrange(len(w))
                    kind = r.random()
                    if kind < 0.4:
                        w[k] = r.choice(vocabulary)
                    elif kind < 0.7:
                        del w[k]
                    else:
                        w.insert(k, r.choice(vocabulary))
            texts.append(" ".join(w))
    passage = r.choices(vocabulary, k=60)
    texts += [" ".join(r.choices(vocabulary, k=r.randint(5, 150)) + passage) for _ in range(30)]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(spark, seed):
    texts = near_copies(seed)
    got = by_id(jaccard_components(documents(spark, texts)))
    assert {i: (g.n_shingles, g.component_id) for i, g in got.items()} == naive_components(dict(enumerate(texts)))


def naive_links(texts, width, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in texts.items()}
    return {a: sum(a != b and bool(s) and bool(sets[b]) and 100 * len(s & sets[b]) >= percent * len(s | sets[b]) for b in sets) for a, s in sets.items()}


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
def test_numbers_of_links_equal_brute_force(spark, width, percent):
    """Groups of near and equal copies, among them halves of a group that share a change."""
    r = random.Random(width)
    base = r.choices([f"v{i}" for i in range(500)], k=120)
    halves = []
    for half in range(2):
        shared = list(base)
        if half:
            shared[40:43] = ["p", "q", "r"]
        for _ in range(20):
            w = list(shared)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = f"x{r.randint(0, 9)}"
            halves.append(" ".join(w))
    texts = [*near_copies(5), *halves, halves[0], halves[0], None, ""]
    got = by_id(jaccard_components(documents(spark, texts), width, percent))
    assert {i: g.n_links for i, g in got.items()} == naive_links(dict(enumerate(texts)), width, percent)


def test_join_edges(spark):
    found = jaccard_components(edge_documents(spark)).collect()
    assert len(found) == len(EDGES) + 2
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None}
    assert got == naive_components(dict(enumerate(EDGES)))
    assert got[5][1] == 4 and got[10][1] == 9 and got[0] == (0, 0)
    assert jaccard_components(no_documents(spark)).count() == 0


def test_parity_bits_bound_the_difference():
    r = random.Random(2)
    for _ in range(300):
        a = shingle_set(" ".join(r.choices("abcdefgh", k=r.randint(3, 200))), 3)
        b = shingle_set(" ".join(r.choices("abcdefgh", k=r.randint(3, 200))), 3)
        x, y = parity_bits(a), parity_bits(b)
        while len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        while len(y) > len(x):
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        assert sum(int(v).bit_count() if v >= 0 else (int(v) + (1 << 64)).bit_count() for v in x ^ y) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
