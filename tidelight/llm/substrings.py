"""Removal of every byte that a repeated string of ``length`` bytes covers.

A string counts as repeated if it also starts anywhere else, in another document or in the same
one, overlaps included. The work is done where strings can repeat at all:

1. Anchors. Of all 64-byte hashes inside a window of ``length`` bytes the least is its anchor, so
   equal windows have equal anchors, at the same place inside. An anchor stands for its context: the windows
   that choose it, which follow each other. Each window is in one context. Only anchors met twice go on.
2. Contexts that are equal as a whole are repeated as a whole and folded into one.
3. Contexts that share an anchor and differ are cut into pieces, by where the anchor lies in a window.
   All windows of a piece hold its core, a window less an eighth of ``length - 64`` bytes.
   Pieces that are equal as a whole are folded; only those that share a core with others and differ go on.
4. Pieces that share a core are compared by suffix arrays, built by induced
   sorting over the pieces of a shard (see ``suffixarray``): a window is repeated if
   its permuted common prefix with a neighbour has ``length`` bytes and its run of such
   neighbours holds two places of the corpus.

Each context gives about nine pieces at most, whatever else there is, so rows grow as the text does. A shard holds
whole groups of pieces with a common core. Of a group above ``group_limit`` pieces the windows, of which a piece has
an eighth of ``length - 64`` at most, are counted by a hash.

Requests and spans of a document are joined to its text, alike at every size. Documents are known by id and hash of the text, so rows that
agree in both are copies of each other, and both are repeated.

Defined cases: a null or empty text has 0 bytes and no spans; a text shorter than ``length`` keeps all its
bytes; equal ids with different texts are different documents; null ids are kept; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collector_off, col, partitions, stage
from .suffixarray import permuted_lcp, suffix_array

ANCHOR = 64
CHUNK = 1 << 20
GROUP_LIMIT = 2000
SHARD_BYTES = 2 << 20
_MULT = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(64).integers(1, 2**64, 256, dtype=np.uint64)
_LOW = np.uint64((1 << 24) - 1)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _key(raw: bytes) -> int:
    return _signed(xxhash.xxh3_64_intdigest(raw))


def _hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the 64 bytes from each place on, by doubling the length."""
    h, width, factor = _TABLE[b], 1, _MULT
    while width < ANCHOR:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor, width = factor * factor % (1 << 64), width * 2
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchors(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all windows, first and last window of each."""
    at, hashes, begins, ends = [], [], [], []
    w = length - ANCHOR + 1
    for start in range(0, len(raw) - length + 1, CHUNK):
        h = _hashes(np.frombuffer(raw, np.uint8, min(CHUNK + length - 1, len(raw) - start), start))
        # the place in the low bits: of equal hashes the first is the least
        keys = h & ~_LOW | np.arange(len(h), dtype=np.uint64)
        rows = -(-len(keys) // w)
        grid = np.full(rows * w, np.uint64(2**64 - 1))
        grid[: len(keys)] = keys
        grid = grid.reshape(rows, w)
        upto = np.minimum.accumulate(grid, axis=1).ravel()
        onward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(onward[: len(keys) - w + 1], upto[w - 1 : len(keys)])
        least = (least & _LOW).astype(np.int64)
        # of equal hashes the first is taken, so an anchor's windows follow each other
        begin = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        places = least[begin]
        at.append(places + start)
        hashes.append(h[places])
        begins.append(begin + start)
        ends.append(np.append(begin[1:], len(least)) - 1 + start)
    if not at:
        none = np.empty(0, np.int64)
        return none, np.empty(0, np.uint64), none, none
    # an anchor of two chunks is one
    at, ends = np.concatenate(at), np.concatenate(ends)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return at[first], np.concatenate(hashes)[first], np.concatenate(begins)[first], ends[np.append(first[1:], len(at)) - 1]


def _occurrences(docs: DataFrame, length: int, with_context: bool) -> DataFrame:
    """anchor, and with contexts also context, doc, key, loc (place, bytes to its left and right)."""
    @collector_off
    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                raw = (text or "").encode()
                places, hashes, lo, hi = anchors(raw, length)
                if not len(places):
                    continue
                out[0].append(hashes.view(np.int64))
                if with_context:
                    hi = hi + length
                    digest = xxhash.xxh3_64_intdigest
                    out[1].append(np.array([digest(raw[a:b]) for a, b in zip(lo.tolist(), hi.tolist())], np.uint64).view(np.int64))
                    out[2].append(np.full(len(places), doc, np.int64))
                    out[3].append(np.full(len(places), _key(raw), np.int64))
                    out[4].append(places << 32 | (places - lo) << 16 | hi - places)
            cols = [np.concatenate(x) if x else np.empty(0, np.int64) for x in out[: 5 if with_context else 1]]
            yield pa.record_batch([pa.array(x) for x in cols], names=["anchor", "context", "doc", "key", "loc"][: len(cols)])

    schema = "anchor long, context long, doc long, key long, loc long" if with_context else "anchor long"
    return docs.mapInArrow(run, schema)


def _low(c="loc"):
    return F.shiftright(c, 32) - F.shiftright(c, 16).bitwiseAND(F.lit(0xFFFF))


def _high(c="loc"):
    return F.shiftright(c, 32) + F.col(c).bitwiseAND(F.lit(0xFFFF))


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """anchor, n, doc, key, start, at, bytes of the wanted contexts (anchor, n, doc, key, loc), written."""
    asked = wanted.groupBy("doc").agg(F.collect_list(F.struct("key", "loc", "anchor", "n")).alias("asked"))
    met = docs.join(asked, "doc").select("doc", "text", "asked")
    names = ["anchor", "n", "doc", "key", "start", "at", "bytes"]

    @collector_off
    def run(batches):
        for batch in batches:
            for doc, text, asked in zip(*(c.to_pylist() for c in batch.columns)):
                raw = (text or "").encode()
                key = _key(raw)
                rows = []
                for a in asked:
                    if a["key"] == key:
                        place, left, right = a["loc"] >> 32, a["loc"] >> 16 & 0xFFFF, a["loc"] & 0xFFFF
                        rows.append((a["anchor"], a["n"], doc, key, place - left, left, raw[place - left : place + right]))
                if rows:
                    yield pa.record_batch([pa.array(c, pa.binary() if n == "bytes" else pa.int64()) for n, c in zip(names, zip(*rows))], names=names)

    return stage(met.mapInArrow(run, "anchor long, n long, doc long, key long, start long, at long, bytes binary"))


def _pieces(contexts: DataFrame, length: int) -> DataFrame:
    """part, piece, n, doc, key, start, at (in the context), size of the pieces of contexts, written.

    The anchor lies ``left`` bytes into a window, alike in equal windows. Windows with ``left`` in one range
    make a piece; what all of the range hold is its core, which names its part."""
    width = max((length - ANCHOR + 1) // 8, 1)

    @collector_off
    def run(batches):
        names = ["part", "piece", "n", "doc", "key", "start", "at", "size"]
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            hashes, rest = [], []
            for anchor, n, doc, key, start, at, raw in zip(*(c.to_pylist() for c in batch.columns)):
                seed = anchor & (2**64 - 1)
                for r in range((at - len(raw) + length) // width, at // width + 1):
                    a, b = max(at - r * width - width + 1, 0), min(at - r * width + length, len(raw))
                    core = at - r * width
                    hashes.append((digest(raw[core : core + length - width + 1], seed ^ r), digest(raw[a:b])))
                    rest.append((n, doc, key, start, a, b - a))
            if rest:
                cols = [*np.array(hashes, np.uint64).view(np.int64).T, *np.array(rest, np.int64).T]
                yield pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in cols], names=names)

    return stage(contexts.select("anchor", "n", "doc", "key", "start", "at", "bytes").mapInArrow(
        run, "part long, piece long, n long, doc long, key long, start long, at long, size long"))


def _with_bytes(pieces: DataFrame, contexts: DataFrame) -> DataFrame:
    """part, doc, key, start, bytes of pieces."""
    met = pieces.join(contexts.select("doc", "key", "start", "bytes"), ["doc", "key", "start"])
    return met.select("part", "doc", "key", (F.col("start") + F.col("at")).alias("start"),
                      F.expr("substring(bytes, int(at) + 1, int(size))").alias("bytes"))


def _crowded_spans(pieces: DataFrame, length: int) -> DataFrame:
    """doc, key, a, b of the windows of pieces that repeat inside their part, by hashes."""

    @collector_off
    def run(batches):
        names = ["part", "hash", "doc", "key", "a"]
        for batch in batches:
            part, doc, key, start, raws = (c.to_pylist() for c in batch.columns)
            if not raws:
                continue
            found = [_key(raw[i : i + length]) for raw in raws for i in range(len(raw) - length + 1)]
            counts = np.array([len(raw) - length + 1 for raw in raws])
            offset = np.arange(len(found)) - np.repeat(np.cumsum(counts) - counts, counts)
            rows = [np.repeat(np.array(c, np.int64), counts) for c in (part, doc, key, start)]
            cols = [rows[0], np.array(found, np.int64), rows[1], rows[2], rows[3] + offset]
            yield pa.record_batch([pa.array(c) for c in cols], names=names)

    windows = stage(pieces.select("part", "doc", "key", "start", "bytes").mapInArrow(run, "part long, hash long, doc long, key long, a long"))
    twice = windows.groupBy("part", "hash").agg(F.count("*").alias("n")).where("n > 1").select("part", "hash")
    return windows.join(twice, ["part", "hash"]).select("doc", "key", "a", (F.col("a") + length).alias("b"))


def _folded(rows: DataFrame, group: str, whole: str, *place: str) -> tuple[DataFrame, DataFrame]:
    """Of rows that stand for ``n`` places: those equal as a whole to another of their group, and what has to be compared,
    one row for each whole of the groups where wholes differ and one has one place, with the number of ``wholes``."""
    folded = stage(rows.groupBy(group, whole).agg(F.sum("n").alias("n"), F.min(F.struct(*place)).alias("r")))
    copied = rows.where("n = 1").join(folded.where("n > 1").select(group, whole), [group, whole])
    mixed = folded.groupBy(group).agg(F.count("*").alias("wholes"), F.min("n").alias("least")).where("wholes > 1 AND least = 1")
    return copied, folded.join(mixed.select(group, "wholes"), group).select(group, "wholes", "n", "r.*")


def _window_hashes(b: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes from each place on, put together from powers of two."""
    h, width, factor, out, done = _TABLE[b], 1, _MULT, None, 0
    while True:
        if length & width:
            part = h[done:] if done else h
            out = part.copy() if out is None else out[: len(part)] * np.uint64(factor) + part[: len(out)]
            done += width
        if done == length:
            return out[: len(b) - length + 1]
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor, width = factor * factor % (1 << 64), width * 2


def _several_places(group: np.ndarray, place: np.ndarray) -> np.ndarray:
    """True where a run of equal ``group`` has two places."""
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    several = np.minimum.reduceat(place, first) != np.maximum.reduceat(place, first)
    return np.repeat(several, np.diff(np.append(first, len(group))))


def _promising(rows: list[tuple], length: int) -> list[tuple]:
    """The parts of contexts (document number, start, bytes) where hashes of windows repeat."""
    sizes = np.array([len(r[2]) for r in rows])
    ends = np.cumsum(sizes)
    hashes = _window_hashes(np.frombuffer(b"".join(r[2] for r in rows), np.uint8), length)
    of = np.repeat(np.arange(len(rows)), sizes)[: len(hashes)]
    offset = np.arange(len(hashes)) - (ends - sizes)[of]
    whole = offset + length <= sizes[of]
    of, offset, hashes = of[whole], offset[whole], hashes[whole]
    starts, docs = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    place = docs[of] << 40 | starts[of] + offset
    order = np.argsort(hashes)
    hit = np.zeros(len(order), bool)
    hit[order] = _several_places(hashes[order], place[order])
    of, offset = of[hit], offset[hit]
    if not len(of):
        return []
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    last = np.append(first[1:], len(of)) - 1
    return [(rows[i][0], rows[i][1] + a, rows[i][2][a : b + length])
            for i, a, b in zip(of[first].tolist(), offset[first].tolist(), offset[last].tolist())]


def repeated_windows(rows: list[tuple], length: int) -> list[tuple]:
    """(doc, key, start, stop) of the repeated windows in contexts (doc, key, start, bytes).

    Contexts are cut to where hashes of windows repeat, then a suffix array of what is left decides."""
    number: dict[tuple, int] = {}
    whole = sorted({(number.setdefault(r[:2], len(number)), *r[2:]) for r in rows})
    names = list(number)
    whole = _promising(whole, length)
    if not whole:
        return []
    sizes = np.array([len(r[2]) for r in whole])
    ends = np.cumsum(sizes + 1)
    # separators are 1, bytes from 2 on, and the last symbol is 0
    t = np.ones(int(ends[-1]) + 1, np.int16)
    body = np.ones(len(t), bool)
    body[ends - 1] = False
    body[-1] = False
    t[body] = np.frombuffer(b"".join(r[2] for r in whole), np.uint8).astype(np.int16) + 2
    t[-1] = 0
    sa = suffix_array(t, len(t))  # the prefixes below are those of the exact order
    lcp = permuted_lcp(t, sa, length)[sa]
    of = np.append(np.repeat(np.arange(len(whole)), sizes + 1), 0)
    begins = ends - sizes - 1
    own = of[sa]
    offset = sa - begins[own]
    # suffixes with a whole window before the next separator, by runs that share one
    usable = (sa < len(t) - 1) & (offset + length <= sizes[own])
    run, own, offset = np.cumsum(lcp < length)[usable], own[usable], offset[usable]
    starts, docs = np.array([r[1] for r in whole]), np.array([r[0] for r in whole])
    hit = _several_places(run, docs[own] << 40 | starts[own] + offset)
    own, offset = own[hit], offset[hit]
    if not len(own):
        return []
    order = np.lexsort((offset, own))
    own, offset = own[order], offset[order]
    cut = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (offset[1:] > offset[:-1] + length)))
    last = np.append(cut[1:], len(own)) - 1
    return [(*names[whole[i][0]], whole[i][1] + a, whole[i][1] + b + length)
            for i, a, b in zip(own[cut].tolist(), offset[cut].tolist(), offset[last].tolist())]


def repeated_spans(docs: DataFrame, length: int, limit: int = GROUP_LIMIT) -> DataFrame:
    """doc, key, a, b: byte spans covered by repeated strings, overlapping ones among them. ``docs``: doc, text."""
    spark = docs.sparkSession
    twice = _occurrences(docs, length, False).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    found = stage(_occurrences(docs, length, True).join(twice, "anchor"))
    copied, wanted = _folded(found.withColumn("n", F.lit(1)), "anchor", "context", "doc", "key", "loc")
    spans = copied.select("doc", "key", _low().alias("a"), _high().alias("b"))
    contexts = _contexts(docs, wanted)
    copied, wanted = _folded(_pieces(contexts, length), "part", "piece", "doc", "key", "start", "at", "size")
    low = F.col("start") + F.col("at")
    spans = spans.unionByName(copied.select("doc", "key", low.alias("a"), (low + F.col("size")).alias("b")))
    wanted = stage(wanted)
    crowded = wanted.where(F.col("wholes") > limit)
    if not crowded.isEmpty():
        spans = spans.unionByName(_crowded_spans(_with_bytes(crowded, contexts), length))
    shards = _with_bytes(wanted.where(F.col("wholes") <= limit), contexts)
    dealt = shards.repartition(partitions(spark), "part").sortWithinPartitions("part")

    @collector_off
    def compare(batches):
        names = ["doc", "key", "a", "b"]

        def done(rows):
            found = repeated_windows(rows, length)
            return pa.record_batch([pa.array(list(c), pa.int64()) for c in (zip(*found) if found else [[]] * 4)], names=names)

        rows, size, last = [], 0, None
        for batch in batches:
            for part, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if part != last and size >= SHARD_BYTES:
                    yield done(rows)
                    rows, size = [], 0
                last = part
                rows.append(tuple(row))
                size += len(row[3])
        if rows:
            yield done(rows)

    compared = dealt.select("part", "doc", "key", "start", "bytes").mapInArrow(compare, "doc long, key long, a long, b long")
    return spans.unionByName(compared)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _with_spans(docs: DataFrame, length: int, id_col: str, text_col: str, limit: int) -> DataFrame:
    """doc_id, text and the spans asked for under its id."""
    # a document is an id with a text: many texts under one id, or under none, stay apart
    known = col(id_col).cast("long")
    rows = docs.select(F.xxhash64(known, F.coalesce(col(text_col), F.lit(""))).alias("doc"), col(text_col).alias("text"), known.alias("doc_id"))
    spans = repeated_spans(rows.select("doc", "text"), length, limit)
    per = spans.groupBy("doc").agg(F.collect_set(F.struct("key", "a", "b")).alias("spans"))  # of one document
    return rows.join(per, "doc", "left").select("doc_id", "text", "spans")


def _own_spans(raw: bytes, spans) -> list[tuple[int, int]]:
    key = _key(raw) if spans else None
    return merge([(s["a"], s["b"]) for s in spans or () if s["key"] == key])


def dedup_substrings(docs: DataFrame, length: int = 200, id_col="doc_id", text_col="text", limit: int = GROUP_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans of each document."""

    def run(batches):
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
        kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.list_(pa.int64()))]
        for batch in batches:
            out = []
            for doc, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                raw = (text or "").encode()
                cut = _own_spans(raw, spans)
                kept, at = hashlib.sha256(), 0
                for a, b in cut:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                out.append((doc, len(raw), sum(b - a for a, b in cut), len(cut), kept.hexdigest(), [list(x) for x in cut]))
            cols = zip(*out) if out else [[]] * 6
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return _with_spans(docs, length, id_col, text_col, limit).mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>")


def strip_substrings(docs: DataFrame, length: int = 200, id_col="doc_id", text_col="text", limit: int = GROUP_LIMIT) -> DataFrame:
    """doc_id and the bytes that are left of each text."""

    def run(batches):
        for batch in batches:
            left = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw, at, out = (text or "").encode(), 0, []
                for a, b in _own_spans(raw, spans):
                    out.append(raw[at:a])
                    at = b
                left.append(b"".join([*out, raw[at:]]))
            yield pa.record_batch([batch.column(0), pa.array(left, pa.binary())], names=["doc_id", "bytes"])

    return _with_spans(docs, length, id_col, text_col, limit).mapInArrow(run, "doc_id long, bytes binary")
