"""Near duplicates by HyperMinHash sketches, confirmed on full shingle sets.

Texts are lower-cased (A-Z) and cut at white space; a document's set are the 64-bit hashes of
its distinct shingles. Documents of equal sets form a class at once (``c``, a 128-bit digest).

Sketch: the hash picks one of 128 buckets, and the bucket keeps of its least value the number of
leading zeros and 10 mantissa bits, 16 bits in all. An empty bucket borrows from the first full
one in a fixed random order. Bands of four registers are the join keys: a pair at 0.8 misses all
32 bands with odds of about 5e-8.

Links: in each band bucket every class is paired with one class of the bucket, its hub: the one
whose buckets hold most classes in all, which is one in the middle of its group. Pairs whose
sizes or whose collision-corrected estimate rule out the threshold by far (see ``MARGIN``) are
dropped, the rest compared on full sets. Confirmed links make components. Only where a bucket
then still holds several components are links across them looked for, by edits against the hub:
the items that a member lacks or adds. Of two members with m and m' lacking and e and e' added
items and k edits in common, the sets share h - m - m' + k items of the hub's h and their own, so
a link needs a certain k, and one of the two is not linked with the hub (``far``). They are joined
on the rarest edits only, as many as k allows, and each pair that meets is held to its own k.
Edits of one member alone join nothing. Pairs inside a component are never made, so a group of n
copies costs n comparisons at a hub, and no link that joins two components is lost.

Sets of hubs meet in blocks of about 64, salted for blocks with many pairs; a task holds a
block's sets and reads the members' one after another, each sent once for a block and not once for a hub.

Defined cases: a text of one word is one shingle; a null text or one without words has an empty
set, is linked with nothing and its own component; rows of equal ids are separate rows, a
component's id is the least id of its rows (null if all are null); repeated rows share a class;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import arrow_map, col, collector_off, join_counted, partitions, stage
from .components import components

REGISTERS, MANTISSA, BAND = 128, 10, 4
#: A pair is compared on full sets if its estimate is at least the threshold less this. The
#: estimate of 128 registers at 0.8 has a deviation of 0.035.
MARGIN = 0.3
#: Odds that registers of different minima agree: leading zeros alike (1/3), then the mantissa.
COLLISION = 1 / 3 / (1 << MANTISSA)
HUBS_PER_BLOCK = 64
PAIRS_PER_TASK = 1 << 14

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_rng = np.random.default_rng(2024)
_PROBES = _rng.integers(0, REGISTERS, (REGISTERS, 96))
_STARTS = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(57)


def _mix(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``words`` words."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    known = {w: xxhash.xxh3_64_intdigest(w) for w in set(parts)}
    h = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64) * _C
    for k in range(n):
        out = _mix(out * _A + h[k : len(h) - n + 1 + k] * _B + np.uint64(k + 1))
    return np.unique(out)


def sketch(values: np.ndarray) -> bytes:
    """128 registers of the sorted set, empty ones filled."""
    at = np.searchsorted(values, _STARTS)
    ends = np.append(at[1:], len(values))
    full = at < ends
    rest = values[np.minimum(at, len(values) - 1)] << np.uint64(7)
    m, e = np.frexp((rest >> np.uint64(11)).astype(np.float64))
    reg = (np.clip(54 - e, 1, 54).astype(np.int64) << MANTISSA) | np.clip(((m * 2 - 1) * (1 << MANTISSA)).astype(np.int64), 0, None)
    empty = np.flatnonzero(~full)
    if len(empty):
        probes = _PROBES[empty]
        hit = full[probes]
        first = hit.argmax(axis=1)
        source = np.where(hit.any(axis=1), probes[np.arange(len(empty)), first], np.flatnonzero(full)[0])
        reg[empty] = reg[source]
    return reg.astype("<u2").tobytes()


def estimate(a: bytes, b: bytes) -> float:
    """Jaccard similarity from two sketches, corrected for chance collisions."""
    same = float((np.frombuffer(a, "<u2") == np.frombuffer(b, "<u2")).mean())
    return (same - COLLISION) / (1 - COLLISION)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(a) + len(b)
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    inter = int((b[at] == a).sum())
    return 100 * inter >= percent * (both - inter)


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, words: int, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, digest (hash of the text), c, n, sketch of every document, written; c and sketch are null for empty sets."""

    def make(cols):
        c, n, s = [], [], []
        for t in cols[2]:
            v = shingle_set(t, words)
            n.append(len(v))
            c.append(_digest(v) if len(v) else None)
            s.append(sketch(v) if len(v) else None)
        return {"doc_id": cols[0], "digest": cols[1], "c": c, "n": n, "sketch": s}

    rows = docs.select(col(id_col), F.xxhash64(col(text_col)), col(text_col))
    return stage(arrow_map(rows, make, "doc_id long, digest long, c binary, n long, sketch binary"))


def buckets(classes: DataFrame) -> DataFrame:
    """key, c, n, hub of the classes that share a band with another, written."""
    width = 2 * BAND
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("sketch", 1 + width * i, width)) for i in range(REGISTERS // BAND)])
    rows = classes.select("c", "n", F.explode(bands).alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
    shared = stage(rows.join(sizes, "key"))
    reach = shared.groupBy("c").agg(F.sum("rows").alias("reach"))
    best = F.max(F.struct("reach", F.xxhash64("key", "c").alias("order"), "c"))["c"]
    hubs = shared.join(reach, "c").groupBy("key").agg(best.alias("hub"))
    return stage(shared.drop("rows").join(hubs, "key"))


def _candidates(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """a, b of distinct pairs (a, na, b, nb) that sizes and sketches allow, written."""
    near = pairs.where((100 * F.least("na", "nb")) >= (percent * F.greatest("na", "nb"))).select("a", "b").distinct()
    sk = classes.select("c", "sketch")
    met = near.join(sk.withColumnsRenamed({"c": "a", "sketch": "sa"}), "a").join(
        sk.withColumnsRenamed({"c": "b", "sketch": "sb"}), "b")

    def keep(batches):
        for batch in batches:
            if batch.num_rows:
                cols = [c.to_pylist() for c in batch.columns]
                ok = [estimate(x, y) >= percent / 100 - MARGIN for x, y in zip(cols[2], cols[3])]
                yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return stage(met.select("a", "b", "sa", "sb").mapInArrow(keep, "a binary, b binary"))


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """c and items (the shingle set) of the wanted classes, and of rows that share their id."""
    needed = stage(classes.join(wanted, "c").select(F.col("rep").alias("_k")).distinct())
    rows = docs.select(F.col("doc_id").alias("_k"), "text").withColumn("_null", F.col("_k").isNull()).fillna(0, ["_k"])
    needed = needed.withColumn("_null", F.col("_k").isNull()).fillna(0, ["_k"])
    rows = join_counted(rows, needed, ["_k", "_null"]).select("text")

    def make(cols):
        values = [shingle_set(t, words) for t in cols[0]]
        return {"c": [_digest(v) for v in values], "items": [v.tobytes() for v in values]}

    return arrow_map(rows, make, "c binary, items binary")


def _meet(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, compare, schema: str) -> DataFrame:
    """Rows of ``compare(a, set of a, b, set of b)`` for the ``pairs`` (member a, hub b), not written."""
    blocks = max(1, -(-pairs.select("b").distinct().count() // HUBS_PER_BLOCK))
    blocked = pairs.withColumn("block", F.pmod(F.xxhash64("b"), F.lit(blocks)))
    per_block = blocked.groupBy("block").agg(F.ceil(F.count("*") / F.lit(PAIRS_PER_TASK)).alias("salts"))
    salted = blocked.join(per_block, "block").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")))
    members = salted.groupBy("block", "salt", F.col("a").alias("c")).agg(F.collect_set("b").alias("hubs"))  # hubs of one block
    members = members.select("c", "block", "salt", F.lit(1).alias("role"), "hubs")
    hubs = salted.select(F.col("b").alias("c"), "block", "salt").distinct().select(
        "c", "block", "salt", F.lit(0).alias("role"), F.array().cast("array<binary>").alias("hubs"))
    sends = stage(members.unionByName(hubs))
    sent = join_counted(_sets(docs, classes, sends.select("c").distinct(), words), sends, ["c"])
    dealt = sent.repartition(partitions(docs.sparkSession), "block", "salt").sortWithinPartitions("block", "salt", "role")
    want = to_arrow_schema(_parse_datatype_string(schema))

    @collector_off
    def run(batches):
        at, own = None, {}
        for batch in batches:
            found = []
            for c, items, block, salt, role, wanted in zip(*(x.to_pylist() for x in batch.columns)):
                values = np.frombuffer(items, np.uint64)
                if at != (block, salt):
                    at, own = (block, salt), {}
                if role == 0:
                    own[c] = values
                    continue
                found += filter(None, (compare(c, values, hub, own[hub]) for hub in wanted))
            yield pa.record_batch([pa.array([r[i] for r in found], f.type) for i, f in enumerate(want)], schema=want)

    return dealt.select("c", "items", "block", "salt", "role", "hubs").mapInArrow(run, schema)


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (member a, hub b) whose full sets are similar, written."""
    compare = lambda c, x, hub, y: (c, hub) if similar(x, y, percent) else None
    return stage(_meet(pairs, classes, docs, words, compare, "a binary, b binary").distinct())


def _edits(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """a, b, n (size of a's set), h (of b's), m (number of b's items that a lacks), e (of items only a has), items
    (both kinds) for the ``pairs`` (member a, hub b), written."""

    def compare(c, x, hub, y):
        lacks, adds = np.setdiff1d(y, x, True), np.setdiff1d(x, y, True)
        return c, hub, len(x), len(y), len(lacks), len(adds), np.concatenate([lacks, adds]).view(np.int64)

    schema = "a binary, b binary, n long, h long, m long, e long, items array<long>"
    return stage(_meet(pairs, classes, docs, words, compare, schema).dropDuplicates(["a", "b"]))


def _across(members: DataFrame, links: DataFrame, roots: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int):
    """Pairs (a, na, b, nb) of different components that meet at a hub and whose edits allow a link; and links with a hub
    (a, b) that are not in its component yet."""
    rows = members.join(roots.withColumnRenamed("node", "c"), "c", "left").select("key", "c", "hub", F.coalesce("root", "c").alias("root"))
    mixed = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
    # a hub gives way to the one with most links among those it is linked with, so that a group has few
    most = links.groupBy("b").agg(F.count("*").alias("links"))
    chosen = links.select(F.col("a").alias("hub"), "b").join(most, "b").unionByName(most.withColumn("hub", F.col("b")))
    chosen = stage(chosen.groupBy("hub").agg(F.max(F.struct("links", "b"))["b"].alias("b")))
    rows = join_counted(rows.join(mixed, "key", "left_semi"), chosen, ["hub"], "left")
    rows = stage(rows.select(F.col("c").alias("a"), F.coalesce("b", "hub").alias("b"), "root").distinct())
    tops = rows.select("b").distinct().join(roots.withColumnRenamed("node", "b"), "b", "left")
    tops = stage(tops.select("b", F.coalesce("root", "b").alias("top")))
    rows = rows.where("a != b")
    met = _edits(rows.select("a", "b"), classes, docs, words)
    cost = (100 * F.col("m") + percent * F.col("e") - (100 - percent) * F.col("h")).alias("cost")  # above 0: not linked with the hub
    about = join_counted(met.select("a", "b", "n", "h", (F.col("m") + F.col("e")).alias("d"), cost).join(rows, ["a", "b"]), tops, ["b"])
    about = stage(about)
    items = met.select("a", "b", F.explode("items").alias("item"))
    common = items.groupBy("b", "item").agg(F.count("*").alias("times")).where("times > 1")
    own = Window.partitionBy("a", "b")
    # rarest first; those that nobody else has come before all others and need no row
    ranked = items.join(common, ["b", "item"]).select(
        "a", "b", "item", F.row_number().over(own.orderBy("times", "item")).alias("at"), F.count("*").over(own).alias("of"))
    ranked = ranked.join(about, ["a", "b"]).withColumn("left", F.col("of") - F.col("at") + 1).drop("at", "of", "d")
    far = F.col("cost") > 0
    one, room = F.lit(100 + percent), (100 - percent) * F.col("h")
    # the least number of common edits with any far partner, and of a far one with any near partner
    with_far = one * F.col("left") >= F.col("cost") + room + 1
    with_near = far & (F.col("root") != F.col("top")) & (100 * F.col("left") >= F.col("cost"))
    kinds = F.array_compact(F.array(F.when(far & with_far, 1), F.when(F.when(far, with_near).otherwise(with_far), 0)))
    sides = stage(ranked.select("a", "b", "n", "item", "left", "cost", "root", room.alias("room"), far.alias("far"), F.explode(kinds).alias("kind")))
    one_side = sides.where("far").drop("far")
    other = sides.select("b", "item", "kind", F.col("a").alias("a2"), F.col("n").alias("n2"), F.col("left").alias("left2"),
                         F.col("cost").alias("cost2"), F.col("root").alias("root2"), F.col("far").alias("far2"))
    allowed = (F.col("root") != F.col("root2")) & F.when(F.col("kind") == 1, F.col("a") < F.col("a2")).otherwise(~F.col("far2")) & (
        one * F.least("left", "left2") >= F.col("cost") + F.col("cost2") + F.col("room")) & (
        100 * F.least("n", "n2") >= percent * F.greatest("n", "n2"))
    pairs = one_side.join(other, ["b", "item", "kind"]).where(allowed)
    missed = about.where("cost <= 0 AND root != top").select("a", "b")
    return pairs.select("a", F.col("n").alias("na"), F.col("a2").alias("b"), F.col("n2").alias("nb")), missed


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, digest, n_shingles, component_id, kept, links of every document.

    ``links`` counts the confirmed links of the document's class: those of the stars, not all
    that exist inside a component."""
    docs = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    made = sketches(docs, words)
    classes = stage(made.where("c IS NOT NULL").groupBy("c").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    members = buckets(classes)
    sizes = classes.select("c", F.col("n").alias("nb"))
    stars = members.where("c != hub").select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("hub").alias("b")).distinct()
    stars = stars.join(sizes.withColumnRenamed("c", "b"), "b")
    links = _links(_candidates(stars, classes, percent), classes, docs, words, percent)
    edge = lambda x: x.select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = stage(components(edge(links)))
    pairs, missed = _across(members, links, roots, docs, classes, words, percent)
    more = stage(_links(_candidates(pairs, classes, percent), classes, docs, words, percent).unionByName(missed).distinct())
    if not more.isEmpty():
        links = links.unionByName(more)
        roots = stage(components(edge(links)))
    by = classes.select("c", "rep").join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    ids = by.groupBy("root").agg(F.min("rep").alias("component_id"))
    ends = links.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count("*").alias("links"))
    by = by.join(ids, "root").join(ends, "c", "left").select("c", "component_id", "links")
    out = made.select("doc_id", "digest", F.col("n").alias("n_shingles"), "c").join(by, "c", "left")
    own = F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "digest", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"),
                      F.coalesce("links", F.lit(0)).alias("links"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of ``docs`` without those linked to one of a lower id, and without repeats of a row's id and text."""
    found = stage(near_duplicates(docs, words, percent, id_col, text_col).select("doc_id", "digest", "kept"))
    name = {"_key": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_digest": F.col("digest")}
    gone = stage(found.where("NOT kept").select(*[c.alias(n) for n, c in name.items()]).distinct())
    rows = docs.withColumns({"_key": F.coalesce(col(id_col).cast("string"), F.lit("")), "_digest": F.xxhash64(col(text_col))})
    rows = join_counted(rows, gone, ["_key", "_digest"], "left_anti")
    if not found.where("kept").groupBy("doc_id", "digest").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates(["_key", "_digest"])
    return rows.select(*map(col, docs.columns))
