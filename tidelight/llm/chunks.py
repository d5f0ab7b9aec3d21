"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes: each step doubles it and adds a fixed random number for the
new byte, so after 16 steps (the width used here) a byte has left it. A text is cut behind every
byte whose hash is strictly less than those of the ``reach`` bytes on either side. Cuts depend on
nearby bytes only: text put in or taken out moves the cuts around it and no others. Chunks
between two cuts are longer than ``reach``; only those at the ends of a text can be shorter, and
chunks of up to ``reach`` bytes are never compared.

There is no longest chunk. In a stretch that repeats with a period of at most ``reach`` bytes every
hash has an equal within reach, so nothing is cut there: the stretch and what stands around it up to
the next cuts is one chunk, whatever its length. Repeats inside it stay, and texts that hold such a
stretch at different lengths share no chunk there.

Chunks are known by 128-bit digests. Digests are counted first, with map-side sums, and only
chunks of repeated digests go on; of each the occurrence with the least (doc_id, place) is kept
and the others are removed. A chunk that stands in a third of all documents costs one row for
each task in the count, and its occurrences are spread by adaptive execution in the join.

Defined cases: a null or empty text has no chunks; equal ids with different texts are different
documents; rows that agree in id and text share their result; a null id comes first; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collector_off, col, stage
from .substrings import _key, merge

WIDTH = 16
REACH = 32
PIECE = 1 << 20
_GEAR = np.random.default_rng(16).integers(0, 2**64, 256, dtype=np.uint64)
NO_ID = -(1 << 63)


def gear_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the ``WIDTH`` bytes that end at each byte from number ``WIDTH - 1`` on."""
    h, width = _GEAR[b], 1
    while width < WIDTH:
        h = (h[:-width] << np.uint64(width)) + h[width:]
        width *= 2
    return h


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Least of the ``w`` values from each place on."""
    rows = -(-len(h) // w)
    grid = np.full(rows * w, np.uint64(2**64 - 1))
    grid[: len(h)] = h
    grid = grid.reshape(rows, w)
    upto = np.minimum.accumulate(grid, axis=1).ravel()
    onward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(onward[: len(h) - w + 1], upto[w - 1 : len(h)])


def cuts(raw: bytes, reach: int = REACH) -> np.ndarray:
    """Places behind which a text is cut, without its end."""
    n, out = len(raw), []
    margin = WIDTH - 1 + reach
    for start in range(margin, n - reach, PIECE):
        stop = min(start + PIECE, n - reach)  # places of this piece that may be cuts
        h = gear_hashes(np.frombuffer(raw, np.uint8, stop + reach - (start - margin), start - margin))
        least = _sliding_min(h, reach)  # h[0] belongs to place start - reach
        own = h[reach : reach + stop - start]
        good = (own < least[: stop - start]) & (own < least[reach + 1 : reach + 1 + stop - start])
        out.append(np.flatnonzero(good) + start + 1)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def chunks_of(raw: bytes, reach: int = REACH) -> list[tuple[int, int]]:
    """(start, stop) of the chunks that are long enough to compare."""
    ends = [0, *cuts(raw, reach).tolist(), len(raw)]
    return [(a, b) for a, b in zip(ends, ends[1:]) if b - a > reach]


def _occurrences(docs: DataFrame, reach: int, with_place: bool) -> DataFrame:
    names = ["d1", "d2", "doc", "row", "key", "a", "b"][: 7 if with_place else 2]

    @collector_off
    def run(batches):
        for batch in batches:
            out: list[list[int]] = [[] for _ in names]
            digests = []
            for doc, row, text in zip(*(c.to_pylist() for c in batch.columns)):
                raw = (text or "").encode()
                spans = chunks_of(raw, reach)
                digests += [xxhash.xxh3_128_digest(raw[a:b]) for a, b in spans]
                if with_place:
                    out[2] += [doc] * len(spans)
                    out[3] += [row] * len(spans)
                    out[4] += [_key(raw)] * len(spans)
                    out[5] += [a for a, _ in spans]
                    out[6] += [b for _, b in spans]
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            out[0], out[1] = both[:, 0], both[:, 1]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=names)

    return docs.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def repeated_chunks(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """row, key, a, b, first: occurrences of chunks that occur more than once. ``docs``: doc, row, text; a
    row is an id with a text, so that the chunks of many texts under one id stay apart."""
    twice = _occurrences(docs, reach, False).groupBy("d1", "d2").agg(F.count("*").alias("n")).where("n > 1").select("d1", "d2")
    found = stage(_occurrences(docs, reach, True).join(twice, ["d1", "d2"]))
    first = found.groupBy("d1", "d2").agg(F.min(F.struct("doc", "a", "key")).alias("f"))
    met = found.join(first, ["d1", "d2"])
    return met.select("row", "key", "a", "b", (F.struct("doc", "a", "key") == F.col("f")).alias("first"))


def dedup_chunks(docs: DataFrame, reach: int = REACH, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_bytes, n_repeated, n_removed, n_spans, kept_sha256, kept of each document: bytes in
    chunks that occur elsewhere too, those of them removed, in how many runs, and what is left."""
    rows = docs.select(F.coalesce(col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), col(text_col).alias("text"),
                       col(id_col).cast("long").alias("doc_id"), F.xxhash64(col(id_col).cast("long"), F.coalesce(col(text_col), F.lit(""))).alias("row"))
    spans = repeated_chunks(rows.select("doc", "row", "text"), reach)
    per = spans.groupBy("row").agg(F.collect_set(F.struct("key", "a", "b", "first")).alias("spans"))  # of one text
    joined = rows.join(per, "row", "left").select("doc_id", "text", "spans")
    names = ["doc_id", "n_bytes", "n_repeated", "n_removed", "n_spans", "kept_sha256", "kept"]
    kinds = [pa.int64()] * 5 + [pa.string(), pa.binary()]

    @collector_off
    def run(batches):
        for batch in batches:
            out = []
            for doc, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                raw = (text or "").encode()
                key = _key(raw) if spans else None
                own = [s for s in spans or () if s["key"] == key]
                gone = merge([(s["a"], s["b"]) for s in own if not s["first"]])
                left, at = [], 0
                for a, b in gone:
                    left.append(raw[at:a])
                    at = b
                kept = b"".join([*left, raw[at:]])
                out.append((doc, len(raw), sum(s["b"] - s["a"] for s in own), len(raw) - len(kept), len(gone),
                            hashlib.sha256(kept).hexdigest(), kept))
            cols = zip(*out) if out else [[]] * 7
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_repeated long, n_removed long, n_spans long, kept_sha256 string, kept binary")
