"""Quality rules on whole texts and on lines that many documents of a host share.

Rules on one text: number of words, words inside repeated three-word windows, repeated lines.
Rules across documents: a line is normalised (A-Z lowered, white space folded) and hashed; for
each host the distinct texts that hold it are counted. A line is boilerplate where it stands in
at least ``min_texts`` distinct texts of a host and in more than ``share`` of them or more than
``most_texts``, whichever is less. So the limit is ``min_texts`` for hosts of few texts, where a
share of them is a handful and chance, and does not grow beyond ``most_texts``: what a host says
word for word in over a thousand texts is its template, however many more texts it has. The SQL
below states the first two limits only; both agree while no line stands in more than
``most_texts`` texts of a host. Exact copies count once: they are the business of deduplication.
Near copies are texts of their own, so their common lines count once for each. A document is depleted, and rejected, if
lines were taken out and fewer than ``min_words`` words or less than ``min_left`` of them remain.

Texts are read once, by a kernel that returns figures and line hashes; counting and joining work
on these. A line's count is pre-aggregated on the map side, so a line that stands everywhere
costs one row for each task. Boilerplate lines join back by a broadcast only below a row limit.

Defined cases: a null text has no words and fails the base rules; a null host is a host of its
own; equal ids and repeated rows each get their row (equal text and host, equal verdict); an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_small
from .common import SPACES, arrow_map, col, join_counted, stage

SYMBOLS = "#*$%&|<>"
FEATURES = ("doc_id long, host string, digest long, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
            " n_repeat_words long, lines array<long>, line_words array<int>")


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    max_repeat_percent: int = 50
    min_texts: int = 20
    share: float = 0.1
    most_texts: int = 1000
    min_left: float = 0.3


def repeated_words(words: list) -> int:
    """Words that stand in a three-word window which the text has at least twice."""
    if len(words) < 4:
        return 0
    seen: dict = {}
    a = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    n = len(seen)
    pairs = a[:-2] * n + a[1:-1]
    if n >= 1 << 21:  # pairs by rank, so that windows stay below 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs * n + a[2:]
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    often = counts[which] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(often) + k] |= often
    return int(covered.sum())


def line_hash(line: bytes) -> int:
    """Signed 64-bit hash of a normalised line."""
    h = xxhash.xxh3_64_intdigest(b" ".join(line.lower().split()))
    return h - (1 << 64) if h >> 63 else h


def _features(cols):
    texts = cols[3]
    out = {k.split()[0]: [] for k in FEATURES.split(", ")}
    out["doc_id"], out["host"], out["digest"] = cols[:3]
    symbol = re.compile("[" + re.escape(SYMBOLS) + "]")
    for text in texts:
        text = text or ""
        raw = text.encode()
        words = raw.split()
        counts: dict[int, int] = {}
        exact: set[bytes] = set()
        dup = 0
        for line in raw.split(b"\n"):
            n = len(line.split())
            if n:
                if line in exact:
                    dup += 1
                exact.add(line)
                h = line_hash(line)
                counts[h] = counts.get(h, 0) + n
        out["n_words"].append(len(words))
        out["word_chars"].append(len(text) - sum(map(text.count, SPACES)))
        out["n_symbols"].append(len(symbol.findall(text)))
        out["n_dup_lines"].append(dup)
        out["n_repeat_words"].append(repeated_words(words))
        out["lines"].append(list(counts))
        out["line_words"].append(list(counts.values()))
    return out


def host_key(host_col):
    return F.coalesce(F.concat(F.lit("="), col(host_col).cast("string")), F.lit(""))


def digest(text_col):
    return F.xxhash64(F.coalesce(col(text_col), F.lit("")))


def features(docs: DataFrame, id_col="doc_id", text_col="text", host_col="source") -> DataFrame:
    """Figures and line hashes of every document, written to the shared folder.

    ``host`` is the host with a mark before it, so that a null host is a value too."""
    rows = docs.select(col(id_col).cast("long"), host_key(host_col), digest(text_col), col(text_col))
    return stage(arrow_map(rows, _features, FEATURES))


def frequent_lines(feats: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(host, line) of boilerplate."""
    texts = feats.select("host", "digest").distinct().groupBy("host").agg(F.count("*").alias("n_texts"))
    lines = feats.select("host", "digest", F.explode("lines").alias("line")).distinct()
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= limits.min_texts)
    joined = join_small(counts, texts, ["host"])
    most = F.least(limits.share * F.col("n_texts"), F.lit(float(limits.most_texts)))
    return joined.where(F.col("n") > most).select("host", "line")


def judge(feats: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row for each row of ``feats``, with base_failed, words left and kept."""
    lines = feats.select("host", "digest", F.explode(F.arrays_zip("lines", "line_words")).alias("l"))
    lines = lines.select("host", "digest", F.col("l.lines").alias("line"), F.col("l.line_words").alias("w"))
    hit = join_small(lines, frequent_lines(feats, limits), ["host", "line"])
    taken = hit.groupBy("host", "digest", "line").agg(F.max("w").alias("w"))
    taken = taken.groupBy("host", "digest").agg(F.sum("w").alias("n_removed_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    failed = (F.col("n_words") < limits.min_words) | (
        100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))
    depleted = (F.col("n_removed_words") > 0) & (
        (left < limits.min_words) | (left < limits.min_left * F.col("n_words")))
    rows = feats.drop("lines", "line_words").join(taken, ["host", "digest"], "left").fillna(0, ["n_removed_words"])
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def quality_rules(docs: DataFrame, limits: Limits = Limits(), **columns) -> DataFrame:
    return judge(features(docs, **columns), limits)


def keep(docs: DataFrame, limits: Limits = Limits(), id_col="doc_id", text_col="text", host_col="source") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns. Rejected texts are joined to the documents, not kept ones."""
    rejected = stage(quality_rules(docs, limits, id_col=id_col, text_col=text_col, host_col=host_col).where("NOT kept").select(
        F.col("host").alias("_host"), F.col("digest").alias("_digest")).distinct())
    rows = docs.withColumns({"_host": host_key(host_col), "_digest": digest(text_col)})
    return join_counted(rows, rejected, ["_host", "_digest"], "left_anti").select(*map(col, docs.columns))


def strip_lines(docs: DataFrame, limits: Limits = Limits(), id_col="doc_id", text_col="text", host_col="source") -> DataFrame:
    """(doc_id, text) of all documents, the boilerplate lines taken out of the texts."""
    feats = features(docs, id_col, text_col, host_col)
    lines = feats.select("host", "digest", F.explode("lines").alias("line")).distinct()
    hit = join_small(lines, frequent_lines(feats, limits), ["host", "line"])
    drop = hit.groupBy("host", "digest").agg(F.collect_set("line").alias("drop"))  # lines of one text
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), host_key(host_col).alias("host"), digest(text_col).alias("digest"),
                       col(text_col).alias("text"))

    def cut(cols):
        out = []
        for text, drop in zip(cols[1], cols[2]):
            if drop:
                bad = set(drop)
                kept = [x for x in text.encode().split(b"\n") if not x.split() or line_hash(x) not in bad]
                text = b"\n".join(kept).decode()
            out.append(text)
        return {"doc_id": cols[0], "text": out}

    joined = rows.join(drop, ["host", "digest"], "left").select("doc_id", "text", "drop")
    return arrow_map(joined, cut, "doc_id long, text string")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce('=' || source, '') AS host FROM documents),
w AS (SELECT doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
          SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
          FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, tri) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
raw AS (SELECT doc_id, host, t, l, regexp_extract_all(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS lw
        FROM (SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS l FROM d)),
lines AS (SELECT doc_id, host, t, l, array_to_string(lw, ' ') AS norm, len(lw) AS n FROM raw WHERE len(lw) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY doc_id),
texts AS (SELECT host, count(DISTINCT t) AS n FROM d GROUP BY host),
often AS (SELECT f.host, f.norm FROM (SELECT host, norm, count(DISTINCT t) AS n FROM lines GROUP BY host, norm) f
          JOIN texts USING (host) WHERE f.n >= 20 AND f.n > least(0.1::DOUBLE * texts.n, 1000)),
gone AS (SELECT doc_id, sum(n) AS n FROM lines JOIN often USING (host, norm) GROUP BY doc_id),
f AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS gone
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (gone > 0 AND (n_words - gone < 50 OR n_words - gone < 0.3::DOUBLE * n_words)) AS kept
FROM b
"""
