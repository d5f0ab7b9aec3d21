import re
from collections import Counter, defaultdict

import pytest

from tidelight.llm import mixing as M


def brute_targets(sizes):
    """Share by weight, cut at the cap, share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, full = dict.fromkeys(names, 0.0), set()
    total = 1.5 * sum(sizes.values())
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        for s in open_:
            target[s] = left * weight[s] / sum(weight[o] for o in open_)
        over = {s for s in open_ if target[s] >= 2 * sizes[s]}
        full |= over
        for s in over:
            target[s] = 2.0 * sizes[s]
        if not over:
            return target


def check(rows, got, seen=None):
    size = lambda t: len(re.findall("[^\x20\x09-\x0D]+", t or ""))
    sizes, most = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
        most[s] = max(most[s], size(t))
    want = brute_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s] + 1e-6
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((k, s, size(t)) for k, t, s in rows)


@pytest.mark.parametrize("bucket", [4, 200])
def test_mix(make_docs, bucket):
    rows = [(i, "w " * (1 + i * 37 % 50), f"s{i * i % 7}") for i in range(900)]
    rows += [(1000 + i, "a b c", "hot") for i in range(800)] + [(5, "same row", "s1")] * 30
    rows += [(2000, None, "s1"), (2001, "", None), (None, "null id", None), (2002, "x " * 40_000, "s2"), (2003, "a", "empty"), (2004, "", "zero")]
    docs = make_docs(rows, ["target", "size", "copies", "p"])
    got = M.copies(docs, bucket=bucket).collect()
    check(rows, got)
    again = M.copies(docs.repartition(13), bucket=bucket).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.copies)
    assert [(key(r)) for r in sorted(got, key=key)] == [key(r) for r in sorted(again, key=key)]
    if bucket == 200:
        mixed = Counter(map(tuple, M.mix(docs).select("doc_id", "text", "source").collect()))
        sums = Counter()
        for r in got:
            sums[r.doc_id] += r.copies
        by_id = Counter()
        for (k, _, _), n in mixed.items():
            by_id[k] += n
        assert by_id == +sums and M.mix(docs).columns == docs.columns


def test_empty(make_docs):
    assert M.copies(make_docs([])).count() == 0

