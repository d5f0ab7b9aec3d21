"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, target, negation, report, clause end, other. Three transducers
read them one after another: negation marks insults and threats shortly behind a negation, reported
speech marks what a reporting verb introduces, the target transducer weighs insults and threats by
a person named shortly before or after. They are composed into one table; each clause with an
insult or threat runs through it, so clauses are scored, not words. Insults have strengths: words
and stems (first letters that several words share) learned from labels, and a short given list.

Learning: words of all labelled rows that are not held out are counted by label in documents; per
word a 64-bit mask of the words before it tells varied use from copies of one text. A term is kept
if it is significantly more frequent under label 1, in varied contexts. Figures of clauses go into
a logistic fit of at most ``max_rows`` labelled rows, those of the lowest hash; counts and
scores cover all rows. At most ``MOST_TERMS`` terms, those of most documents, are in the table
that goes to the tasks.

Hot keys: counts are added up in each task, then by word; labels are broadcast only up to a counted
number of rows, beyond it the join is shuffled and its hot keys split.

Defined cases: null and empty texts match nothing and have the score of a text without matches; rows
without a label, with a null one or conflicting ones do not train; without both labels in the fit
fixed coefficients are used; equal ids and repeated rows each get their row; a null id is not held
out; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from math import log1p
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, col, collector_off, join_counted, stage

TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")
WORD = re.compile(r"[^\W\d_]+")
ENDS = frozenset(".!?;:\n")
#: Letters of a stem; a word of so few letters is a term of its own.
STEMS = (3, 4, 5, 6)
LONGEST_WORD = 48
MOST_TERMS = 20_000
#: Least documents, significance and purity of a learned term; least words of a stem.
LEAST_DOCS, LEAST_Z, LEAST_PURITY, LEAST_WORDS = 5, 5.0, 0.95, 3
SEED_STRENGTH = 0.5

#: Given words of each class.
INSULTS = frozenset("""idiot idiots moron morons stupid dumb dumbass imbecile loser losers trash scum pathetic worthless
 disgusting clown fool jerk bastard bitch asshole idiota imbécil estúpido estúpida inútil basura crétin imbécile connard
 salaud ordure débile dummkopf abschaum blödmann arschloch vollidiot""".split())
THREATS = frozenset("""kill murder hurt destroy beat strangle shoot stab burn punish matar matarte destruir tuer
 détruire frapper töten umbringen schlagen zerstören""".split())
TARGETS = frozenset("""you your yours yourself u he she him her they them people folks guy guys tú usted ustedes ellos ellas
 tu te toi vous ils elles lui leur du dich dir sie ihr euch ihn ihm""".split())
NEGATIONS = frozenset("""not no never none neither nor isn aren wasn weren don doesn didn nunca jamás ne pas jamais aucun
 nicht kein keine keinen nie niemals""".split())
REPORTS = frozenset("""said says say wrote writes called calls quoted quote reported according claimed told dijo dice
 escribió llamó según dit disait écrit appelé selon sagte sagt schrieb nannte laut""".split())


# -- transducers ----------------------------------------------------------------------------------
# A transducer is {(state, symbol): (next state, symbol out, weight)} and starts in state 0.
# I insult, T threat, Y target, N negation, R report, . end of a clause, f other word;
# i, t after a negation; J, U, j, u the same in reported speech.

SYMBOLS = "ITYNR.f"


def _counting(symbols: str, opener: str, reach: int, marked: dict[str, str], factor: float) -> dict:
    """Symbols of ``marked`` change and weigh ``factor`` up to ``reach`` symbols behind an opener."""
    arcs = {}
    for left in range(reach + 1):
        for s in symbols:
            after = 0 if s == "." else reach if s == opener else max(left - 1, 0)
            arcs[left, s] = (after, marked[s], factor) if left and s in marked else (after, s, 1.0)
    return arcs


def negation(reach: int = 3, factor: float = 0.2) -> dict:
    return _counting(SYMBOLS, "N", reach, {"I": "i", "T": "t"}, factor)


def reported(reach: int = 8, factor: float = 0.3) -> dict:
    return _counting(SYMBOLS + "it", "R", reach, {"I": "J", "T": "U", "i": "j", "t": "u"}, factor)


def target(before: int = 4, after: int = 3) -> dict:
    """Weighs insults and threats; a target behind one adds a share of that one's weight (symbol +)."""
    arcs = {}
    for seen in range(before + 1):
        for kind in ("", "I", "T"):
            for left in range(after + 1) if kind else (0,):
                state = (seen, kind, left)
                for s in "ITYNR.fitJUju":
                    hit = "I" if s in "IiJj" else "T" if s in "TtUu" else ""
                    if s == ".":
                        arcs[state, s] = ((0, "", 0), s, 0.0)
                    elif hit:
                        weight = (1.5 if seen else 1.0) if hit == "I" else (0.6 if seen else 0.3)
                        arcs[state, s] = ((max(seen - 1, 0), hit, after), "*", weight)
                    else:
                        rest = (kind, left - 1) if left > 1 else ("", 0)
                        if s == "Y":
                            bonus = {"I": 0.5, "T": 2.0}.get(kind if left else "", 0.0)
                            arcs[state, s] = ((before, *(("", 0) if bonus else rest)), "+" if bonus else s, bonus)
                        else:
                            arcs[state, s] = ((0 if s == "R" else max(seen - 1, 0), *rest), s, 0.0)  # who reports is no target
    return {(0 if k == (0, "", 0) else k, s): (0 if n == (0, "", 0) else n, o, w) for (k, s), (n, o, w) in arcs.items()}


def compose(a: dict, b: dict, symbols: str = SYMBOLS) -> dict:
    """The transducer that feeds what ``a`` puts out to ``b``; weights multiply. Reachable states only."""
    arcs, todo, number = {}, [(0, 0)], {(0, 0): 0}
    while todo:
        pair = todo.pop()
        for s in symbols:
            p, out, w = a[pair[0], s]
            q, out, v = b[pair[1], out]
            if (p, q) not in number:
                number[p, q] = len(number)
                todo.append((p, q))
            arcs[number[pair], s] = (number[p, q], out, w * v)
    return arcs


def grammar() -> dict:
    return compose(compose(negation(), reported()), target())


def clause_score(arcs: dict, clause: list[tuple[str, float]]) -> float:
    """Summed weights of one clause, (symbol, strength) by word."""
    state, last, total = 0, 0.0, 0.0
    for symbol, strength in clause:
        state, out, weight = arcs[state, symbol]
        if out == "*":
            last = weight * strength
            total += last
        elif out == "+":
            total += weight * last
    return total


class Scorer:
    """Words to symbols, clauses to figures; made once in a task."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], threats: frozenset[str] = THREATS):
        self.words, self.stems, self.arcs, self.known = words, stems, grammar(), {}
        self.given = {w: (s, 1.0) for s, g in (("T", threats), ("Y", TARGETS), ("N", NEGATIONS), ("R", REPORTS)) for w in g}
        self.given |= {e: (".", 0.0) for e in ENDS}

    def symbol(self, word: str) -> tuple[str, float]:
        found = self.known.get(word)
        if found is None:
            strength = max([self.words.get(word, 0.0), *(self.stems.get(word[:k], 0.0) for k in STEMS if len(word) > k)])
            found = ("I", strength) if strength > 0 else self.given.get(word, ("f", 0.0))
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[word] = found
        return found

    def figures(self, text: str | None) -> list[float]:
        """log(1 + summed clauses), highest clause up to 2."""
        tokens = TOKEN.findall((text or "").lower())
        symbol = self.symbol
        if not any(symbol(w)[0] in "IT" for w in set(tokens)):
            return [0.0] * N_FIGURES
        total, top, clause = 0.0, 0.0, []
        for w in [*tokens, "."]:
            clause.append(symbol(w))
            if w in ENDS:
                if any(s in "IT" for s, _ in clause):
                    score = clause_score(self.arcs, clause)
                    total, top = total + score, max(top, score)
                clause = []
        return [log1p(total), min(top, 2.0)]


N_FIGURES = 2
#: Intercept and coefficients where labels cannot tell: a plain insult of half strength is above the cut.
FIXED = (-2.5, [0.0, 3.5])


# -- learning -------------------------------------------------------------------------------------


def held_out(key):
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    """k, y of the rows that may train: one label, not held out. Written."""
    known = labels.select(F.col("doc_id").alias("k"), F.col("toxic").alias("y")).where("k IS NOT NULL AND y IN (0, 1)")
    known = known.groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").select("k", "y")
    return stage(known.where(~held_out(F.col("k"))))


@collector_off
def _count_words(batches):
    """word, documents of label 1, of label 0, mask of the words before it (label 1 only)."""
    import pyarrow as pa

    ones, zeros, masks = Counter(), Counter(), {}

    def flush():
        words = list(ones.keys() | zeros.keys())
        out = pa.record_batch({
            "word": pa.array(words, pa.string()), "ones": pa.array([ones[w] for w in words], pa.int64()),
            "zeros": pa.array([zeros[w] for w in words], pa.int64()),
            "mask": pa.array([masks.get(w, 0) - (1 << 64) * (masks.get(w, 0) >> 63) for w in words], pa.int64())})
        ones.clear(), zeros.clear(), masks.clear()
        return out

    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = WORD.findall((text or "").lower())
            if y:
                ones.update(w for w in set(words) if len(w) <= LONGEST_WORD)
                for before, w in set(zip(["", *words], words)):
                    if len(w) <= LONGEST_WORD:
                        masks[w] = masks.get(w, 0) | 1 << (zlib.crc32(before.encode()) & 63)
            else:
                zeros.update(w for w in set(words) if len(w) <= LONGEST_WORD)
            if len(ones) + len(zeros) > 400_000:
                yield flush()
    if ones or zeros:
        yield flush()


def word_counts(docs: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """word, ones, zeros, mask over all training rows. Written."""
    rows = join_counted(docs.select(col(id_col).alias("k"), col(text_col).alias("text")), known, ["k"])
    found = rows.select("text", "y").mapInArrow(_count_words, "word string, ones long, zeros long, mask long")
    return stage(found.groupBy("word").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"), F.bit_or("mask").alias("mask")))


def terms(counts: DataFrame, n_ones: int, n_zeros: int) -> DataFrame:
    """term, stem (boolean), docs, strength: at most ``MOST_TERMS``."""
    whole = counts.where("ones > 0").selectExpr("word term", "false stem", "ones", "zeros", "mask", "1L words")
    parts = [F.when(F.length("word") > k, F.substring("word", 1, k)) for k in STEMS]
    stems = counts.select(F.explode(F.array(*parts)).alias("term"), "ones", "zeros", "mask").where("term IS NOT NULL")
    stems = stems.groupBy("term").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"), F.bit_or("mask").alias("mask"),
                                      F.count_if(F.col("ones") > 0).alias("words")).where(F.col("words") >= LEAST_WORDS)
    both = whole.unionByName(stems.withColumn("stem", F.lit(True)))
    even = (F.col("ones") + F.col("zeros")) * F.lit(n_ones / (n_ones + n_zeros))
    low = (F.col("ones") - F.sqrt("ones")) / n_ones
    pure = low / (low + (F.col("zeros") + 1) / n_zeros)
    bits = F.bit_count("mask")
    varied = (bits >= LEAST_DOCS) & (bits >= 0.3 * F.least("ones", F.lit(64)))
    good = (F.col("ones") >= LEAST_DOCS) & ((F.col("ones") - even) / F.sqrt(even + 1) >= LEAST_Z) & (pure >= LEAST_PURITY) & varied
    return both.where(good).select("term", "stem", F.col("ones").alias("docs"), (2 * pure - 1).alias("strength")).orderBy(
        F.desc("docs"), "term", "stem").limit(MOST_TERMS)


class Lexicon(NamedTuple):
    """Strengths of insulting words and stems, and the words of threats."""

    words: dict[str, float]
    stems: dict[str, float]
    threats: frozenset[str] = THREATS


def learn_terms(docs: DataFrame, known: DataFrame, id_col: str, text_col: str) -> Lexicon:
    """Learned terms, and the given ones unless enough labels speak for clean use of them."""
    sizes = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    words, stems = {w: SEED_STRENGTH for w in INSULTS}, {}
    if len(sizes) < 2:
        return Lexicon(words, stems)
    counts = word_counts(docs, known, id_col, text_col)
    given = counts.where(F.col("word").isin(list(INSULTS | THREATS)) & (F.col("ones") + F.col("zeros") >= 20)).collect()
    clean = {r.word for r in given if r.ones / sizes[1] < 2 * r.zeros / sizes[0]}
    words = {w: v for w, v in words.items() if w not in clean}
    for r in terms(counts, sizes[1], sizes[0]).collect():
        (stems if r.stem else words)[r.term] = r.strength
    return Lexicon(words, stems, THREATS - clean)


def figures(docs: DataFrame, lexicon: Lexicon, id_col: str, text_col: str) -> DataFrame:
    """doc_id, f of every document. Written."""

    def run(columns, made=[]):  # noqa: B006 - one scorer in a task
        if not made:
            made.append(Scorer(*lexicon))
        return {"doc_id": columns[0], "f": [made[0].figures(t) for t in columns[1]]}

    return stage(arrow_map(docs.select(col(id_col), col(text_col)), run, "doc_id long, f array<double>"))


def fit(feats: DataFrame, known: DataFrame, max_rows: int) -> tuple[float, list[float]]:
    """Intercept and coefficients."""
    rows = feats.where(~held_out(F.col("doc_id"))).join(known, F.col("doc_id") == F.col("k"))
    rows = stage(rows.select("f", "y", F.xxhash64("doc_id").alias("h")).orderBy("h", "f").limit(max_rows))
    if rows.select("y").distinct().count() < 2:
        return FIXED
    train = rows.select(array_to_vector(F.col("f")).alias("features"), F.col("y").cast("double").alias("label"))
    model = LogisticRegression(regParam=1e-3, maxIter=60).fit(train)
    return float(model.intercept), [float(w) for w in model.coefficients.toArray()]


def score(docs: DataFrame, labels: DataFrame, cut: float = 0.3, max_rows: int = 20_000, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    known = training_labels(labels)
    feats = figures(docs, learn_terms(docs, known, id_col, text_col), id_col, text_col)
    intercept, weights = fit(feats, known, max_rows)
    at = sum((F.col("f")[i] * F.lit(w) for i, w in enumerate(weights)), F.lit(intercept))
    return feats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), (1 / (1 + F.exp(-at))).alias("score")).withColumn(
        "predicted", (F.col("score") >= cut).cast("int"))
