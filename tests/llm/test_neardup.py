import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tidelight.llm import components as C
from tidelight.llm import neardup as N
from tidelight.llm import queries
from tidelight.llm.common import table


def brute(rows, words, percent=80):
    """(doc_id, n, component) by comparing all pairs that share a shingle."""
    sets, holders = [], defaultdict(list)
    for i, (_, t) in enumerate(rows):
        w = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = {tuple(w[k : k + words]) for k in range(max(len(w) - words + 1, 1))} if w else set()
        sets.append(s)
        for x in s:
            holders[x].append(i)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in holders[x]:
                if j < i:
                    shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    key = lambda x: tuple(-1 if v is None else v for v in x)
    return sorted([(k, len(s), least.get(find(i))) for i, ((k, _), s) in enumerate(zip(rows, sets))], key=key), key


def run(df, rows, words):
    want, key = brute(rows, words)
    got = df.collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=key) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_brute_force(spark, small, sf):
    sf_dir = small.replace("sf0.001", sf)
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    run(queries.op10_near_duplicates(spark, sf_dir), rows, 2)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.random()}"
    return words


@pytest.mark.parametrize("words", [2, 5])
def test_chains_and_short_texts(make_docs, words):
    """Groups at the threshold, chains of edits whose ends are far apart, and small sets."""
    rng = random.Random(5)
    texts = [None, "", " \n", "one", "One", "two words", "a b c d e", "a b c d e f", "a b c d e f g", "b c d e f g", "é É"]
    for size in (6, 9, 12, 30, 60, 200, 1500):
        for g in range(6):
            base = [f"g{g}s{size}w{i}" for i in range(size)]
            for k in range(8):
                base = edited(rng, base, rng.randrange(0, max(2, size // 22)))
                texts.append(" ".join(base))
    texts.append("long " * 30_000)
    rng.shuffle(texts)
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(3, "one"), (None, "two words"), (None, "alone null"), (7, texts[1]), (7, texts[1])]
    df = N.near_duplicates(make_docs(rows, ["c", "n", "kept"]), words)
    run(df, rows, words)


def test_hub_that_is_not_linked(make_docs):
    """Many texts share most of one passage and fall apart into components."""
    rng = random.Random(1)
    passage = [f"p{i}" for i in range(120)]
    rows = []
    for g in range(30):
        own = [f"o{g}x{i}" for i in range(22)]
        for k in range(4):
            rows.append((len(rows), " ".join(passage + edited(rng, own, k))))
    run(N.near_duplicates(make_docs(rows), 2), rows, 2)


def test_empty(make_docs):
    assert N.near_duplicates(make_docs([])).collect() == []


def test_estimate():
    rng = np.random.default_rng(0)
    for n, j in ((4000, 0.9), (4000, 0.5), (400, 0.8)):
        shared = int(2 * n * j / (1 + j))
        pool = rng.integers(0, 2**64, 2 * n, dtype=np.uint64)
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:shared], pool[n : 2 * n - shared]]))
        assert abs(N.estimate(N.sketch(a), N.sketch(b)) - j) < 0.2


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (200, 200), (61, 60)]
    got = dict(map(tuple, C.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**dict.fromkeys(range(62), 0), **dict.fromkeys((100, 101, 103), 100)}
