import hashlib
import random
import time

import numpy as np
import pytest

from tidelight.llm import chunks, queries
from tidelight.llm.common import table


def brute_cuts(raw, reach):
    """Roll the gear hash byte by byte and look for strict minima."""
    mask, h, hashes = (1 << 64) - 1, 0, {}
    for i, b in enumerate(raw):
        h = 0
        for k in range(max(0, i - chunks.WIDTH + 1), i + 1):
            h = (h * 2 + int(chunks._GEAR[raw[k]])) & mask
        if i >= chunks.WIDTH - 1:
            hashes[i] = h
    return [i + 1 for i in hashes if i - reach in hashes and i + reach in hashes
            and all(hashes[i] < hashes[j] for j in range(i - reach, i + reach + 1) if j != i)]


def brute(rows, reach=chunks.REACH):
    seen, own = {}, []
    for k, t in rows:
        raw = (t or "").encode()
        ends = [0, *chunks.cuts(raw, reach).tolist(), len(raw)]
        own.append([(raw[a:b], a, b) for a, b in zip(ends, ends[1:]) if b - a > reach])
        for c, a, _ in own[-1]:
            seen.setdefault(c, []).append((k is not None, k or 0, a, chunks._key(raw)))
    out = []
    for (k, t), cs in zip(rows, own):
        raw, kept, gone, runs, last = (t or "").encode(), b"", 0, 0, None
        at = 0
        for c, a, b in cs:
            if len(seen[c]) > 1 and min(seen[c]) != (k is not None, k or 0, a, chunks._key(raw)):
                kept += raw[at:a]
                at = b
                gone += b - a
                runs += a != last
                last = b
        kept += raw[at:]
        out.append((k, len(raw), sum(b - a for c, a, b in cs if len(seen[c]) > 1), gone, runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def as_rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_bytes", "n_repeated", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


def test_query_against_brute_force(spark, small):
    rows = [tuple(r) for r in table(spark, small, "documents").select("doc_id", "text").collect()]
    want = brute(rows)
    assert any(r[3] for r in want) and as_rows(queries.op4_chunk_dedup(spark, small)) == want


@pytest.mark.parametrize("piece", [100, 1 << 20])
def test_cuts(monkeypatch, piece):
    monkeypatch.setattr(chunks, "PIECE", piece)
    rng = random.Random(3)
    for n in (0, 1, 15, 16, 47, 79, 80, 300, 1500):
        for letters in (1, 2, 20):
            raw = bytes(rng.randrange(letters) for _ in range(n))
            assert chunks.cuts(raw, 8).tolist() == brute_cuts(raw, 8)


def test_insertions_move_only_nearby_cuts():
    rng = np.random.default_rng(0)
    raw = rng.integers(97, 123, 4000, dtype=np.uint8).tobytes()
    moved = raw[:2000] + b"something new" + raw[2000:]
    a, b = ({r[x:y] for x, y in chunks.chunks_of(r)} for r in (raw, moved))
    assert len(a - b) <= 3 and len(b - a) <= 4


def test_cases(spark, make_docs):
    rng = random.Random(7)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = prose(55)
    rows = [(i, prose(rng.randrange(40)) + " " + passage + " " + prose(rng.randrange(40))) for i in range(12)]
    rows += [(50, None), (51, ""), (52, "short"), (53, "x" * 60_000), (None, passage), (3, "other " + passage), (60, prose(40_000)), (61, prose(60))]
    got = as_rows(chunks.dedup_chunks(make_docs(rows, ["key", "a", "kept"])))
    assert got == brute(rows)
    by = {r[0]: r for r in got if r[0] != 3}
    assert all(by[i][2] > 100 for i in range(12) if i != 3) and by[61][2] == 0 and by[60][2] == 0
    assert chunks.dedup_chunks(make_docs([])).collect() == []
    twice = chunks.dedup_chunks(make_docs([rows[0], rows[0]])).collect()
    assert len(twice) == 2 and twice[0] == twice[1]


@pytest.mark.parametrize("shared", [None, 7])
def test_many_texts_under_one_id(spark, make_docs, shared):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(900))
    rows = [(shared, "".join(rng.choice("abcdefgh ") for _ in range(150)) + (passage if i % 4 == 0 else "") + str(i)) for i in range(2_000)]
    own = [(i, t) for i, (_, t) in enumerate(rows)]
    took, got = [], []
    for part in (own, rows, own):
        start = time.time()
        got.append(chunks.dedup_chunks(make_docs(part)).selectExpr("n_bytes", "n_repeated", "n_removed", "n_spans", "kept_sha256").collect())
        took.append(time.time() - start)
    assert sum(r.n_repeated for r in got[0]) == sum(r.n_repeated for r in got[1]) > 0
    assert sum(r.n_removed for r in got[0]) == sum(r.n_removed for r in got[1]) > 0  # all but one, whichever comes first
    assert took[1] < 3 * took[2] + 5, took
