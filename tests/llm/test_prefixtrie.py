"""The trie of conversations against a dictionary of prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidelight.llm import prefixtrie, queries
from tidelight.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuild(rows, every=20, most=4):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in by.items()}
    h = {c: zlib.crc32(str(c).encode()) % most for c in own}
    return {c: own.get(c - c % every, [])[: h[c]] + own[c][h[c] :] for c in own}


def brute(convs):
    members, kids = defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    saved, leaves = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * words
            leaves[p[:d]] += p not in kids
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def built(spark, rows, parts=5):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = prefixtrie.trie(*prefixtrie.with_shared_heads(prefixtrie.ordered_turns(df)))
    assert got.columns == COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=str)


def conversations(rng, n, turns, kinds, same=0):
    rows = []
    for c in range(n):
        if c < same:
            rows += [(c, k, "user", f"say {k % 2}  it") for k in range(3)]
            continue
        for k in range(rng.randint(1, turns)):
            rows.append((c, k, rng.choice(["user", "system"]), f"w {rng.randrange(kinds)} " * (1 + k % 3)))
    return rows


@pytest.mark.parametrize("seed,n,turns,kinds,same", [(1, 150, 6, 2, 0), (2, 300, 4, 1, 150), (3, 60, 9, 40, 10), (4, 7, 3, 2, 0)])
def test_against_dictionary(spark, seed, n, turns, kinds, same):
    rows = conversations(random.Random(seed), n, turns, kinds, same)
    assert built(spark, rows) == brute(rebuild(rows))


def test_long_conversations_go_on_in_bands(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "FIRST", 2)
    monkeypatch.setattr(prefixtrie, "WIDEST", 4)
    rng = random.Random(5)
    rows = [(c, k, "user", f"t {k if c % 2 else rng.randrange(2)}") for c in range(40) for k in range(rng.choice([1, 2, 3, 5, 6, 7, 13, 20]))]
    assert prefixtrie.bands(20) == [(0, 2), (2, 4), (6, 4), (10, 4), (14, 4), (18, 4)]
    assert built(spark, rows) == brute(rebuild(rows))


def test_depth_400(spark):
    rows = [(c, k, "user", f"t {k}" if k < 100 * c else "x") for c in range(1, 4) for k in range(400 - c)]
    assert built(spark, rows) == brute(rebuild(rows))


def test_band_of_position(spark):
    want = {}
    for b, (start, width) in enumerate(prefixtrie.bands(6000)):
        want |= dict.fromkeys((start, start + 1, start + width - 1), b)
    got = spark.createDataFrame([(p,) for p in want], "pos long").select("pos", prefixtrie._band_of(F.col("pos"))).collect()
    assert {p: b for p, b in got} == want


def test_odd_rows(spark):
    rows = [(1, None, None, "a"), (1, 0, "user", None), (1, 0, "user", None), (21, 5, "", "a"), (None, 1, "user", "x"), (20, 1, "user", "b  c"),
            (20, 1, "user", "b  c"), (-5, 0, "user", "b  c"), (40, 0, "user", "y " * 50_000), (4, 0, "x", ""), (7, 3, "user", "z"), (7, 2, "user", "y")]
    assert built(spark, rows) == brute({c: t for c, t in rebuild([r for r in rows if r[0] != -5]).items()} | {-5: _negative(rows)})
    assert built(spark, []) == []
    assert built(spark, [(None, 1, "user", "x")]) == []


def _negative(rows):
    """The remainder of a negative id is Spark's: -5 - (-5) = 0, a conversation that is not there."""
    h = zlib.crc32(b"-5") % 4
    return [(r, t) for c, _, r, t in rows if c == -5][h:]


def test_query_on_a_given_table(spark, small):
    rows = [tuple(r) for r in table(spark, small, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in queries.op12_prefix_trie(spark, small).select(COLUMNS).collect()), key=str)
    assert got == brute(rebuild(rows))
