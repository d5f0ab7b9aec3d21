import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline as P
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).parent))

from test_decontaminate import brute as leaks  # noqa: E402
from test_linequality import brute as rules  # noqa: E402
from test_mixing import brute_targets  # noqa: E402
from test_neardup import brute as groups  # noqa: E402
from test_tokenfiles import expected  # noqa: E402

from tidelight.llm import linequality  # noqa: E402
from tidelight.llm.common import stage, table  # noqa: E402


def follow(spark, docs, sf_dir, items):
    """Run the stages one after another, each against brute force on its own input."""
    get = lambda df: [tuple(r) for r in df.select("doc_id", "text", "source").collect()]
    rows = get(docs)
    out = stage(P.quality(spark, docs, sf_dir))
    fine = Counter((r[0], r[1]) for r in rules(rows, linequality.Limits()) if r[-1])
    want = Counter({(k, len((t or "").split())): 0 for k, t, _ in rows})
    want.update(fine)
    assert out.columns == docs.columns
    assert Counter((k, len((t or "").encode().split())) for k, t, _ in get(out)) == +want

    docs, rows = out, get(out)
    out = stage(P.near_duplicates(spark, docs, sf_dir))
    comps, _ = groups([r[:2] for r in rows], 5)
    assert out.columns == docs.columns and {r[0] for r in get(out)} == {c for _, _, c in comps}
    assert len(get(out)) == len({c for _, _, c in comps})

    docs, rows = out, get(out)
    out = stage(P.decontamination(spark, docs, sf_dir))
    bad = {r[0] for r in leaks([r[:2] for r in rows], items)}
    assert out.columns == docs.columns and sorted(get(out)) == sorted(r for r in rows if r[0] not in bad)

    docs, rows = out, get(out)
    out = stage(P.mixture(spark, docs, sf_dir))
    size = lambda t: len((t or "").encode().split())
    sizes, taken, times = Counter(), Counter(), Counter(get(out))
    for r in rows:
        sizes[r[2]] += size(r[1])
        taken[r[2]] += times[r] * size(r[1])
    goal = brute_targets(sizes)
    assert out.columns == docs.columns and set(times) <= set(rows) and max(times.values()) <= 2
    assert all(abs(taken[s] - goal[s]) <= max(size(r[1]) for r in rows if r[2] == s) for s in sizes)

    got = P.token_files(spark, out, sf_dir).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected([r[:2] for r in get(out)])


def test_stages(spark, small):
    items = [tuple(r) for r in table(spark, small, "benchmark").select("item_id", "text").collect()]
    follow(spark, table(spark, small, "documents"), small, items)


def test_run(spark, small):
    a, b = (sorted(map(tuple, P.run(spark, small).collect())) for _ in range(2))
    assert a and a == b


def test_cases(spark, make_docs, small):
    own = lambda i, n=60: " ".join(f"w{i}x{j}" for j in range(n))
    rows = [(i, own(i), f"s{i % 3}") for i in range(12)] + [(3, own(3), "s0")] * 2 + [(20, own(3) + " more", None), (21, None, "s1"), (22, "", None)]
    docs = make_docs(rows, ["_key", "digest", "kept"])
    for _, step in P.STAGES[:-1]:
        docs = stage(step(spark, docs, small))
        assert docs.columns[-3:] == ["_key", "digest", "kept"]
    assert {r.doc_id for r in docs.select("doc_id").collect()} <= set(range(12))
    assert P.token_files(spark, docs, small).count() == docs.count()
    none = spark.createDataFrame([], T.StructType(make_docs([]).schema.fields))
    for _, step in P.STAGES:
        none = step(spark, none, small)
    assert none.count() == 0
