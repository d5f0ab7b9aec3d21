"""Toxicity: the grammar on clauses, learned terms, held-out accuracy."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidelight.llm import queries, toxicity
from tidelight.llm.common import table

LABEL = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def scorer():
    return toxicity.Scorer({"idiot": 1.0, "clown": 0.5}, {"grum": 0.8})


def clause(scorer, text):
    return scorer.figures(text)[1]


def test_grammar(scorer):
    plain = clause(scorer, "What an idiot.")
    assert plain == pytest.approx(1.0)
    assert clause(scorer, "You idiot") == pytest.approx(1.5)  # target before
    assert clause(scorer, "idiot that you are") == pytest.approx(1.5)  # target behind
    assert clause(scorer, "not really an idiot") == pytest.approx(0.2)
    assert clause(scorer, "They said what an idiot") == pytest.approx(0.3)
    assert clause(scorer, "said never an idiot") == pytest.approx(0.06)
    assert clause(scorer, "not here. What an idiot") == pytest.approx(1.0)  # negation ends with its clause
    assert clause(scorer, "a clown") == pytest.approx(0.5) and clause(scorer, "grummeln") == pytest.approx(0.8)
    assert clause(scorer, "grum") == 0  # a stem has to be shorter than the word
    assert clause(scorer, "I will kill you") == pytest.approx(0.9) and clause(scorer, "to kill time") == pytest.approx(0.3)
    assert scorer.figures("IDIOT! idiot!")[0] == pytest.approx(__import__("math").log(3))
    assert scorer.figures(None) == scorer.figures("") == scorer.figures("nothing here") == [0.0, 0.0]


def test_composition_is_the_cascade(scorer):
    """The composed table gives what the transducers give one after another."""
    rng = random.Random(4)
    one, two, three = toxicity.negation(), toxicity.reported(), toxicity.target()
    for _ in range(300):
        symbols = [rng.choice(toxicity.SYMBOLS) for _ in range(rng.randint(1, 14))]
        p = q = r = 0
        total = last = 0.0
        for s in symbols:
            p, out, w = one[p, s]
            q, out, v = two[q, out]
            r, out, x = three[r, out]
            if out == "*":
                last = w * v * x * 0.7
                total += last
            elif out == "+":
                total += w * v * x * last
        assert toxicity.clause_score(toxicity.grammar(), [(s, 0.7) for s in symbols]) == pytest.approx(total)


def test_held_out_accuracy(spark, small):
    sf = small.replace("sf0.001", "sf0.1")
    got = queries.op13_toxicity(spark, sf)
    rows = got.join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    found = sum(r.predicted and r.toxic for r in rows) / sum(r.toxic for r in rows)
    wrong = sum(r.predicted and not r.toxic for r in rows) / sum(not r.toxic for r in rows)
    assert len(rows) > 900 and found > 0.9 and wrong < 0.02, (found, wrong)
    for r in got.sample(0.1, 1).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert r.predicted == (r.score >= 0.3)


def corpus(n=240):
    rng = random.Random(9)
    words = [a + b for a in ("ba", "ke", "mi", "so") for b in ("la", "no", "ri", "tu", "ve")]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(30)]
        if i % 4 == 0:
            for _ in range(3):
                text[rng.randrange(30)] = "zwark" + rng.choice(["", "en", "isch", "lo", "li"])
        if i % 8 == 1:
            text[3:9] = "quelle copied words stand here always".split()  # one passage in many toxic rows
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(i % 4 == 0 or i % 8 == 1)))
    return rows, labels


def test_learned_terms(spark, make_docs):
    rows, labels = corpus()
    known = toxicity.training_labels(spark.createDataFrame(labels, LABEL))
    lexicon = toxicity.learn_terms(make_docs(rows), known, "doc_id", "text")
    assert "zwark" in lexicon.stems and not {"copied", "stand", "always"} & lexicon.words.keys()
    train = {i: y for i, _, y in labels if zlib.crc32(str(i).encode()) % 4 != 2}
    counts = {r.word: (r.ones, r.zeros) for r in toxicity.word_counts(make_docs(rows), known, "doc_id", "text").collect()}
    for w in ("zwark", "bala", "copied"):
        have = [train[i] for i, t in rows if i in train and w in t.split()]
        assert counts[w] == (sum(have), len(have) - sum(have))


def test_held_out_labels_are_not_used(spark, make_docs):
    rows, labels = corpus(120)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    docs = make_docs(rows)
    a, b = (toxicity.score(docs, spark.createDataFrame(x, LABEL)).orderBy("doc_id").collect() for x in (labels, turned))
    assert a == b


def test_cases(spark, make_docs):
    rows = [(1, "You idiot."), (2, "A good day."), (3, None), (4, ""), (None, "you stupid idiot"), (1, "You idiot."), (6, "word " * 200_000 + "idiot"), (7, "é\n" * 9)]
    docs = make_docs(rows, ["f", "score", "y", "word"])
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (2, 0, 0), (3, 0, None), (7, 0, 0), (7, 1, 1), (None, 1, 1), (77, 0, 0)], LABEL)
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    none = {r.doc_id: r for r in toxicity.score(docs, labels.where(F.lit(False))).collect()}
    assert none[1].predicted == none[6].predicted == none[None].predicted == 1 and none[2].predicted == none[4].predicted == 0
    assert none[3].score == none[4].score == none[2].score and none[None].held_out is False
    assert toxicity.score(make_docs([]), labels).collect() == []


def test_common_words_are_no_threats(spark, make_docs):
    rows = [(i, "they beat the drum " + ("you idiot" if i % 5 == 0 else "well")) for i in range(100)]
    known = toxicity.training_labels(spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(100)], LABEL))
    lexicon = toxicity.learn_terms(make_docs(rows), known, "doc_id", "text")
    assert "beat" not in lexicon.threats and "kill" in lexicon.threats and "idiot" in lexicon.words
