import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest

from tidelight.llm import queries, substrings
from tidelight.llm import suffixarray as SA
from tidelight.llm.common import table


def brute(rows, length):
    """Count every window of every text."""
    seen = Counter()
    for _, t in rows:
        raw = (t or "").encode()
        seen.update(hash(raw[i : i + length]) for i in range(len(raw) - length + 1))
    out = []
    for k, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            if seen[hash(raw[i : i + length])] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((k, len(raw), int(gone.sum()), int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(raw) else 0,
                    hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def as_rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_brute_force(spark, small, sf):
    sf_dir = small.replace("sf0.001", sf)
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    want = brute(rows, 200)
    assert any(r[2] for r in want) and as_rows(queries.op1_substring_dedup(spark, sf_dir)) == want


def prose(rng, n):
    return "".join(rng.choice("abcdefgh éñ\n") for _ in range(n))


@pytest.mark.parametrize("limit", [3, 2000])
def test_borders_and_cases(make_docs, limit):
    rng = random.Random(limit)
    shared = [prose(rng, n) for n in (99, 130, 180, 199, 200, 201, 263, 264, 400, 1200)]
    rows = [(0, None), (1, ""), (2, "x" * 199), (3, "x" * 200), (4, "x" * 201), (5, "ab" * 300), (6, prose(rng, 199)), (7, "y" * 150_000)]
    for i in range(60):
        text = prose(rng, rng.randrange(300))
        for _ in range(rng.randrange(4)):
            piece = rng.choice(shared)
            a = rng.randrange(len(piece) // 3)
            text += piece[a:] + prose(rng, rng.randrange(250))
        rows.append((10 + i, text))
    rows += [(500 + i, prose(rng, rng.randrange(60)) + shared[2] + prose(rng, rng.randrange(60))) for i in range(25)]
    rows += [rows[20], (21, "another text of id 21"), (None, rows[25][1]), (None, prose(rng, 500))]
    docs = make_docs(rows, ["key", "doc", "n_bytes"])
    assert as_rows(substrings.dedup_substrings(docs, limit=limit)) == brute(rows, 200)


def test_strip_and_empty(make_docs):
    same = prose(random.Random(1), 230)
    got = dict(map(tuple, substrings.strip_substrings(make_docs([(1, "one" + same), (2, same + "two"), (3, None)])).collect()))
    assert {k: bytes(v) for k, v in got.items()} == {1: b"one", 2: b"two", 3: b""}
    assert substrings.dedup_substrings(make_docs([])).collect() == []


def test_anchors_do_not_depend_on_chunks(monkeypatch):
    raw = prose(random.Random(2), 9000).encode() + b"z" * 900
    whole = substrings.anchors(raw, 200)
    monkeypatch.setattr(substrings, "CHUNK", 1000)
    for a, b in zip(whole, substrings.anchors(raw, 200)):
        assert (a == b).all()


@pytest.mark.parametrize("letters", [1, 2, 5, 200])
def test_suffix_array(letters):
    rng = np.random.default_rng(letters)
    for n in (1, 2, 3, 8, 50, 400):
        for _ in range(10):
            t = np.append(rng.integers(1, letters + 1, n), 0)
            raw = bytes(t.tolist())
            sa = SA.suffix_array(t, 10**6)
            assert sa.tolist() == sorted(range(n + 1), key=lambda i: raw[i:])
            lcp = SA.permuted_lcp(t, sa, 30)
            for a, b in zip(sa, sa[1:]):
                k = 0
                while k < min(30, n + 1 - max(a, b)) and t[a + k] == t[b + k]:
                    k += 1
                assert lcp[b] == k


@pytest.mark.parametrize("shared", [None, 7])
def test_many_texts_under_one_id(spark, make_docs, shared):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(260))
    rows = [(shared, "".join(rng.choice("abcdefgh ") for _ in range(150)) + (passage if i % 4 == 0 else "") + str(i)) for i in range(2_000)]
    own = [(i, t) for i, (_, t) in enumerate(rows)]
    took, got = [], []
    for part in (own, rows, own):
        start = time.time()
        got.append(sorted((tuple(r)[1:] for r in substrings.dedup_substrings(make_docs(part)).drop("spans").collect()), key=repr))
        took.append(time.time() - start)
    assert got[0] == got[1] == sorted((r[1:] for r in brute(own, 200)), key=repr)
    assert took[1] < 3 * took[2] + 5, took


def common_passage(n, size):
    """Documents of their own words around one passage."""
    rng = random.Random(size)
    passage = prose(rng, size)
    return [(i, prose(rng, 210) + passage + prose(rng, 210)) for i in range(n)]


def test_rows_grow_with_documents(make_docs, monkeypatch):
    """A group that gets above the limit makes no more rows of each context."""
    written, stage = [], substrings.stage

    def counting(df):
        out = stage(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(substrings, "stage", counting)
    took = []
    for n in (80, 400):
        rows = common_passage(n, 150)
        written.clear()
        assert as_rows(substrings.dedup_substrings(make_docs(rows), limit=100)) == brute(rows, 200)
        took.append(sum(written))
    assert 0 < took[1] <= 5.5 * took[0], took


@pytest.mark.parametrize("size", [190, 260])
def test_crowded_parts(make_docs, size):
    rows = common_passage(60, size)
    rows += [(100 + i, rows[i][1][: 200 + i % 7] + "é" + rows[i + 1][1][190:]) for i in range(30)]
    assert as_rows(substrings.dedup_substrings(make_docs(rows), limit=5)) == brute(rows, 200)


def test_each_window_is_in_one_context():
    for raw in (prose(random.Random(3), 5000).encode(), b"ab" * 700, b"z" * 900, b"z" * 200, b"z" * 199):
        places, _, first, last = substrings.anchors(raw, 200)
        assert [w for a, b in zip(first, last) for w in range(a, b + 1)] == list(range(max(len(raw) - 199, 0)))
        assert ((first <= last) & (places >= last) & (places + substrings.ANCHOR <= first + 200)).all()
