import math
import random

from pyspark.sql import types as T

from tidelight.llm import decontaminate as D
from tidelight.llm import queries
from tidelight.llm.common import table

ITEM = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType())])


def brute(rows, items, threshold=0.5, overlap=0.8):
    """Every passage against every item."""
    items = [(k, D.split_words(t), *D.parts(t)) for k, t in items if D.split_words(t)]
    n, mean = len(items), sum(len(w) for _, w, _, _ in items) / max(len(items), 1)
    df = {}
    for _, ws, _, _ in items:
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    weight = lambda w, ws: (math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * ws.count(w) * 2.2
                            / (ws.count(w) + 1.2 * (0.25 + 0.75 * len(ws) / mean)))
    weights = [{w: weight(w, ws) for w in set(ws)} for _, ws, _, _ in items]
    stretch = max([len(ws) for _, ws, _, _ in items], default=1)
    out = []
    for k, t in rows:
        words = D.split_words(t)
        for (key, _, q, a), ws in zip(items, weights):
            own, best = sum(ws.values()), None
            for p in range(0, max(len(words) - stretch, 1), stretch):
                passage = words[p : p + 2 * stretch]
                score = sum(w for x, w in ws.items() if x in set(passage)) / own
                if score < threshold - 1e-9:
                    continue
                shares = []
                for part in (q, a):
                    rs = D.runs(part)
                    have = {tuple(passage[i : i + len(rs[0])]) for i in range(len(passage))} if rs else set()
                    shares.append(sum(r in have for r in rs) / len(rs) if rs else 1.0)
                if min(shares) >= overlap:
                    best = max(best or (0,), (round(score, 9), *shares))
            if best:
                out.append((k, key, *best))
    return sorted(out, key=repr)


def as_rows(df):
    return sorted([(r.doc_id, r.item_id, round(r.score, 9), r.question_overlap, r.answer_overlap) for r in df.collect()], key=repr)


def test_query_against_brute_force(spark, small):
    get = lambda name, key: [tuple(r) for r in table(spark, small, name).select(key, "text").collect()]
    want = brute(get("documents", "doc_id"), get("benchmark", "item_id"))
    assert want and as_rows(queries.op3_decontamination(spark, small)) == want


def make(rng, n, pool):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def test_edits_and_cases(spark, make_docs):
    rng = random.Random(3)
    items = [(i, make(rng, rng.randrange(6, 60), 300)) for i in range(40)]
    items += [(40, "What is it? forty two"), (41, "one"), (42, "two words"), (43, None), (44, ""), (None, "a null id here now"), (3, items[3][1]), (45, "same same same same")]
    rows = [(900, None), (901, ""), (None, items[2][1]), (902, "one"), (903, "say: What IS it? Forty-two!"), (904, "same " * 50), (905, "a null id here now")]
    for i, (_, t) in enumerate(items[:40]):
        words = t.split()
        for k in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"edit{k}"
        rows.append((i, make(rng, rng.randrange(200), 300) + "\n" + ", ".join(words) + ". " + make(rng, rng.randrange(200), 300)))
    rows += [rows[-1], (7, "other"), (906, make(rng, 30_000, 2000) + " " + items[5][1])]
    item_df = spark.createDataFrame([(*i, "x") for i in items], ITEM)
    docs = make_docs(rows, ["item_id", "words"])
    want = brute(rows, items)
    assert as_rows(D.matches(docs, item_df)) == want
    assert as_rows(D.matches(docs, item_df, group_bytes=300)) == want
    bad = {(k, t) for k, t in rows if brute([(k, t)], items)}
    left = D.clean(docs, item_df, group_bytes=1000)
    assert left.columns == docs.columns
    assert sorted((tuple(r) for r in left.select("doc_id", "text").collect()), key=repr) == sorted((r for r in rows if r not in bad), key=repr)


def test_empty(spark, make_docs):
    none = spark.createDataFrame([], ITEM)
    assert D.matches(make_docs([(1, "a")]), none).collect() == [] and D.clean(make_docs([(1, "a")]), none).count() == 1
    some = spark.createDataFrame([(1, "a b", "x")], ITEM)
    assert D.matches(make_docs([]), some).collect() == [] and D.clean(make_docs([]), some).count() == 0


def test_one_word_changed(spark, make_docs):
    items = [(n, " ".join(f"i{n}x{j}" for j in range(n))) for n in (16, 35, 59)]

    def changed(n, at):
        words = items[[k for k, _ in items].index(n)][1].split()
        words[at] = "other"
        return " ".join(["before", *words, "after"])

    # in the last quarter of a long item; at either end and at the border of the last quarter of a short one
    rows = [(k, changed(59, 45 + k)) for k in range(14)] + [(20, changed(35, 30)), (21, changed(16, 15)), (22, changed(16, 11))]
    rows += [(30, changed(16, 7)), (31, "before " + " ".join(items[2][1].split()[:45]) + " after")]
    found = {r.doc_id for r in D.matches(make_docs(rows), spark.createDataFrame([(*i, "x") for i in items], ITEM)).collect()}
    assert found == set(range(14)) | {20, 21, 22}


def test_marked_answer_is_asked_for(spark, make_docs):
    item = "What " + " ".join(f"q{j}" for j in range(60)) + "? forty two"
    rows = [(1, item), (2, item.replace("forty two", "forty three"))]
    found = D.matches(make_docs(rows), spark.createDataFrame([(1, item, "x")], ITEM)).collect()
    assert [r.doc_id for r in found] == [1]
