"""Trie of the conversations that start alike.

A node is a distinct sequence of first turns. Turns (role and text) are named by 128 bits of SHA-256
and counted in words once; after that no text moves. Rows of a conversation's names are dealt by
range over (names, conversation), so that a group of equal conversations is split like any other
rows. Each shard sorts its padded matrix of names with ``lexsort``; columns that differ from the
row before, OR-accumulated from the left, mark where nodes start, and ``reduceat`` over these
starts aggregates every depth. A shard is told the last row before it and the first row after it,
so it knows which nodes are new and which go on; those at its two ends are partial and are added
up by a digest of their names. What a subtree sums is a sum over its member rows (words of the turns
at which a row starts no node, and whether its node is a leaf), so partial sums only need adding.

Matrices are at most ``band`` columns wide: deeper turns of long conversations form further rows, in
bands of 32, 64, ... up to 1024 turns, below the digest of all turns before. Bands are worked from
the deepest to the first, each hands the sums of its rows to the one above. No conversation is
one row or one task, whatever its length: turns are numbered by a sort over all turns.

Defined cases: a null role or text is empty; turns are ordered by turn (null first), then role,
then name, so equal turns keep no order of their own; rows with a null conversation are dropped;
repeated rows are turns of their own; turnless conversations end at the root; empty tables have no
nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, collector_off, join_counted, partitions, stage

#: Turns of the first band, and of the widest.
FIRST, WIDEST = 32, 1024
#: Bytes of a turn's name.
NAME = 16
WORD = r"[^\x20\x09-\x0D]+"
NO_ENDS = hashlib.sha256().hexdigest()
OUT = """key binary, parent_key binary, depth int, conv_id long, parent_conv_id long, n_convs long, n_children long,
 n_leaves long, saved_tokens long, ends string, shard int"""


def ordered_turns(rows: DataFrame, id_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """c, pos (from 0), name (hex), words of every turn. Written."""
    role, text = F.coalesce(col(role_col), F.lit("")), F.coalesce(col(text_col), F.lit(""))
    name = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * NAME)
    slim = rows.select(
        col(id_col).alias("c"), col(turn_col).alias("t"), role.alias("r"), name.alias("name"),
        F.regexp_count(text, F.lit(WORD)).cast("int").alias("words")).where("c IS NOT NULL")
    order = [F.asc("c"), F.asc_nulls_first("t"), F.asc("r"), F.asc("name")]
    placed = slim.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    # the upper bits of the id are the partition, the lower 33 the row in it
    placed = stage(placed.select("c", "name", "words", F.monotonically_increasing_id().alias("g")))
    part = F.shiftright("g", 33)
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(part.alias("p")).agg(F.count("*").alias("n"))
    sizes = stage(sizes.select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from")))
    row = F.col("from") + F.col("g").bitwiseAND((1 << 33) - 1)
    numbered = join_counted(placed.withColumn("p", part), sizes, ["p"]).select("c", "name", "words", row.alias("row"))
    first = numbered.groupBy("c").agg(F.min("row").alias("first"))
    return stage(numbered.join(first, "c").select("c", (F.col("row") - F.col("first")).alias("pos"), "name", "words"))


def with_shared_heads(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns of conversations whose first h turns are those of c - c % every, h = crc32(c) % most,
    and all conversations with their number of turns. Written."""
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % most).cast("int")
    convs = turns.groupBy("c").agg(F.count("*").alias("n")).withColumn("h", h)
    heads = turns.where((F.col("c") % every == 0) & (F.col("pos") < most - 1)).groupBy("c").agg(
        F.array_sort(F.collect_list(F.struct("pos", "name", "words"))).alias("head"))  # fewer than ``most`` entries
    convs = convs.join(heads.withColumnRenamed("c", "b"), F.col("c") - F.col("c") % every == F.col("b"), "left")
    taken = F.slice(F.coalesce("head", F.array()), 1, F.col("h"))
    convs = stage(convs.select("c", "n", "h", taken.alias("taken"), F.size(taken).alias("k")))
    own = turns.join(convs.select("c", "h", "k"), "c").where("pos >= h")
    own = own.select("c", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "name", "words")
    given = convs.select("c", F.inline("taken")).select("c", F.col("pos").cast("long").alias("pos"), "name", "words")
    sizes = convs.select("c", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))
    return stage(own.unionByName(given)), stage(sizes)


# -- one shard ------------------------------------------------------------------------------------


def _key(up: bytes, path: bytes) -> bytes:
    return hashlib.sha256(up + path).digest() if path else up


def _names(paths: list[bytes], width: int):
    """Padded matrix of names (two halves each) and the mask of what is no padding."""
    lengths = np.array([len(p) // NAME for p in paths])
    there = np.arange(width) < lengths[:, None]
    out = np.zeros((len(paths), width, 2), np.uint64)
    out[there] = np.frombuffer(b"".join(p[: NAME * width] for p in paths), ">u8").reshape(-1, 2)
    return out, there


def _shared(a: tuple[bytes, bytes] | None, up: bytes, path: bytes) -> int:
    """Depth to which a neighbour (up, path) shares the nodes of a row; -1 for none."""
    if a is None or a[0] != up:
        return -1
    n = 0
    while (n + 1) * NAME <= min(len(path), len(a[1])) and a[1][n * NAME : (n + 1) * NAME] == path[n * NAME : (n + 1) * NAME]:
        n += 1
    return n


def shard_nodes(rows: dict, before, after, shard: int, start: int, band: int) -> dict:
    """Nodes of one shard, complete or partial, and the sums of its rows (depth -1).

    ``rows``: lists c, up, path, words, cont (goes on below this band), saved and leaves (of what is
    below). ``start`` is the depth of ``up``."""
    width = max(len(p) for p in rows["path"]) // NAME
    names, there = _names(rows["path"], width)
    up_of = {u: i for i, u in enumerate(sorted(set(rows["up"])))}
    up_rank = np.array([up_of[u] for u in rows["up"]])
    c, cont = np.array(rows["c"], np.int64), np.array(rows["cont"], bool)
    keys = [c, cont]
    for k in range(width - 1, -1, -1):
        keys += [names[:, k, 1], names[:, k, 0]]
    order = np.lexsort([*keys, up_rank])
    words = np.zeros((len(c), width), np.int64)
    words[there] = np.concatenate([np.asarray(w, np.int64) for w in rows["words"]]) if width else 0
    names, there, words, up_rank, c, cont = (x[order] for x in (names, there, words, up_rank, c, cont))
    ups, paths = [rows["up"][i] for i in order], [rows["path"][i] for i in order]
    n, length = len(c), there.sum(1)
    below, leaves_below = (np.array(rows[x], np.int64)[order] for x in ("saved", "leaves"))

    exists = np.concatenate([np.ones((n, 1), bool), there], 1)
    change = np.ones((n, width + 1), bool)
    change[1:, 0] = up_rank[1:] != up_rank[:-1]
    change[1:, 1:] = (names[1:] != names[:-1]).any(2)
    begins = np.logical_or.accumulate(change, 1)
    begins[0] = True
    starts = begins & exists  # of a node within this shard
    fresh = starts.copy()  # of a node over all shards
    met = _shared(before, ups[0], paths[0])
    fresh[0, : met + 1] = False
    goes_on = _shared(after, ups[-1], paths[-1])

    last = np.append(begins[np.arange(1, n), length[:-1]], goes_on < length[-1])
    leaves = np.where(cont, leaves_below, last)
    value = np.zeros((n, width + 1), np.int64)
    value[:, 1:] = np.where(there & ~fresh[:, 1:], words, 0)
    value[:, -1] += below
    saved = np.cumsum(value[:, ::-1], 1)[:, ::-1]

    out = {f: [] for f in ("key", "parent_key", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")}

    def put(**columns):
        size = len(columns["depth"])
        for f, v in out.items():
            v.extend(columns.get(f, [None] * size))

    if start:
        put(depth=[-1] * n, conv_id=c.tolist(), n_leaves=leaves.tolist(), saved_tokens=saved[:, 0].tolist())
    text = [str(x) for x in c.tolist()]
    most = np.iinfo(np.int64).max
    above = None
    for k in range(width + 1):
        at = np.flatnonzero(starts[:, k])
        if not len(at):
            break

        def add(x):
            return np.add.reduceat(np.where(exists[:, k], x, 0).astype(np.int64), at)

        children = add(fresh[:, k + 1]) if k < width else np.zeros(len(at), np.int64)
        if k == 0 and start:  # the node itself belongs to the band above
            put(key=[ups[i] for i in at], depth=[start] * len(at), n_children=children.tolist())
            above = (at, None, np.ones(len(at), bool))
            continue
        least = np.minimum.reduceat(np.where(exists[:, k], c, most), at)
        partial = add(cont) > 0 if k == band else np.zeros(len(at), bool)
        partial[0] |= at[0] == 0 and k <= met
        partial[-1] |= bool(exists[-1, k]) and k <= goes_on
        ended = add((length == k) & ~cont).tolist()
        ids = [",".join(text[i : i + e]) for i, e in zip(at.tolist(), ended)]
        ends = [s if p else hashlib.sha256(s.encode()).hexdigest() if s else NO_ENDS for s, p in zip(ids, partial)]
        own = [_key(ups[i], paths[i][: k * NAME]) if p else None for i, p in zip(at, partial)]
        if k == 0:
            parent_key, parent = [None] * len(at), [None] * len(at)
        else:
            j = np.searchsorted(above[0], at, "right") - 1
            unknown = above[2][j]
            parent_key = [_key(ups[i], paths[i][: (k - 1) * NAME]) if u else None for i, u in zip(at, unknown)]
            parent = [None] * len(at) if above[1] is None else [None if u else int(v) for u, v in zip(unknown, above[1][j])]
        put(key=own, parent_key=parent_key, depth=[start + k] * len(at), conv_id=least.tolist(), parent_conv_id=parent,
            n_convs=add(1).tolist(), n_children=children.tolist(), n_leaves=add(leaves).tolist(),
            saved_tokens=add(saved[:, k]).tolist(), ends=ends)
        above = (at, least, partial)
    out["shard"] = [shard] * len(out["depth"])
    return out


# -- all shards -----------------------------------------------------------------------------------


def band_nodes(rows: DataFrame, start: int, band: int) -> DataFrame:
    """Records of :func:`shard_nodes` for one band of rows. Written."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    order = ["up", "path", "cont", "c"]
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *order)
    dealt = stage(dealt.withColumn("shard", F.spark_partition_id()))
    ends = dealt.groupBy("shard").agg(F.min(F.struct(*order)).alias("first"), F.max(F.struct(*order)).alias("last"))
    line = Window.orderBy("shard")  # a row for each shard
    near = ends.select("shard", F.lag("last").over(line).alias("before"), F.lead("first").over(line).alias("after"))
    want = to_arrow_schema(_parse_datatype_string(OUT))

    def run(left, right):
        gone = right.to_pylist()[0]
        sides = [None if x is None else (bytes(x["up"]), bytes(x["path"])) for x in (gone["before"], gone["after"])]
        lists = {f: left.column(f).to_pylist() for f in ("c", "up", "path", "words", "cont", "saved", "leaves")}
        made = shard_nodes(lists, *sides, gone["shard"], start, band)
        return pa.table({f.name: pa.array(made[f.name], f.type) for f in want}, schema=want)

    return stage(dealt.groupBy("shard").cogroup(near.groupBy("shard")).applyInArrow(run, OUT))


def bands(longest: int) -> list[tuple[int, int]]:
    """Start and width of each band of a trie of this depth."""
    out = [(0, FIRST)]
    while sum(out[-1]) < longest:
        out.append((sum(out[-1]), min(2 * out[-1][1], WIDEST)))
    return out


def _band_of(pos):
    """Number of the band of a position."""
    widths = [FIRST]
    while 2 * widths[-1] <= WIDEST:
        widths.append(2 * widths[-1])
    edges = list(accumulate(widths))
    number = F.lit(0)
    for edge in edges[:-1]:
        number = number + (pos >= edge).cast("int")
    return (number + F.greatest(F.floor((pos - edges[-1]) / WIDEST) + 1, F.lit(0))).cast("int")


@collector_off
def _hash_pieces(batches):
    """SHA-256 of the comma-joined pieces of each key, which come in order."""
    at, state = None, None
    for batch in batches:
        done = {"key": [], "depth": [], "ends_sha256": []}
        for key, depth, piece in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            if (key, depth) != at:
                if at is not None:
                    for f, v in zip(done, (*at, state.hexdigest())):
                        done[f].append(v)
                at, state = (key, depth), hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.encode())
        yield _hashed(done)
    if at is not None:
        yield _hashed({"key": [at[0]], "depth": [at[1]], "ends_sha256": [state.hexdigest()]})


def _hashed(done):
    kinds = {"key": pa.binary(), "depth": pa.int32(), "ends_sha256": pa.string()}
    return pa.record_batch({f: pa.array(done[f], t) for f, t in kinds.items()})


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256 (of the comma-joined ascending ids of the conversations that end there).

    ``turns``: c, pos from 0 without gaps, name, words. ``convs``: c and n, the number of turns.
    """
    longest = convs.agg(F.max("n")).first()[0] or 0
    plan = bands(longest)
    lists = F.array_sort(F.collect_list(F.struct("pos", "name", "words")))  # at most as many as the band is wide
    packed = turns.groupBy("c", _band_of(F.col("pos")).alias("b")).agg(lists.alias("t"))
    path = F.unhex(F.concat_ws("", F.transform("t", lambda t: t["name"])))
    packed = packed.select("c", "b", path.alias("path"), F.transform("t", lambda t: t["words"]).alias("words"))
    packed = stage(packed.join(convs, "c", "right").select("c", "n", F.coalesce("b", F.lit(0)).alias("b"), F.coalesce("path", F.lit(b"")).alias("path"),
                                                           F.coalesce("words", F.array().cast("array<int>")).alias("words")))
    rows, up = [], None
    for b, (start, band) in enumerate(plan):
        own = packed.where(F.col("b") == b).withColumn("cont", (F.col("n") > start + band).cast("int"))
        own = own.withColumn("up", F.lit(b"")) if up is None else own.join(up, "c")
        if len(plan) > 1:
            own = stage(own)
        up = own.where("cont = 1").select("c", F.unhex(F.sha2(F.concat("up", "path"), 256)).alias("up"))
        rows.append(own)
    parts, below = [], None
    for (start, band), own in reversed(list(zip(plan, rows))):
        own = own.join(below, "c", "left") if below is not None else own.selectExpr("*", "0L saved", "0L leaves")
        own = own.select("c", "up", "path", "words", "cont", F.coalesce("saved", F.lit(0)).alias("saved"), F.coalesce("leaves", F.lit(0)).alias("leaves"))
        made = band_nodes(own, start, band)
        below = made.where("depth = -1").selectExpr("conv_id c", "saved_tokens saved", "n_leaves leaves")
        parts.append(made.where("depth >= 0"))
    nodes = parts[0]
    for p in parts[1:]:
        nodes = nodes.unionByName(p)
    return _recombine(nodes)


def _recombine(nodes: DataFrame) -> DataFrame:
    """Add up partial nodes and look up the parents that were partial."""
    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    cut = nodes.where("key IS NOT NULL")
    added = cut.groupBy("key", "depth").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.min("parent_conv_id").alias("parent_conv_id"),
        *[F.sum(s).alias(s) for s in sums])
    pieces = cut.where("ends <> ''").select("key", "depth", "shard", "ends").repartition("key", "depth").sortWithinPartitions("key", "depth", "shard")
    hashed = pieces.mapInArrow(_hash_pieces, "key binary, depth int, ends_sha256 string")
    added = stage(added.join(hashed, ["key", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))))
    columns = ["conv_id", "depth", "parent_conv_id", *sums, "ends_sha256"]
    whole = nodes.where("key IS NULL").withColumnRenamed("ends", "ends_sha256")
    every = whole.select("parent_key", *columns).unionByName(added.select("parent_key", *columns))
    parents = added.select(F.col("key").alias("parent_key"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("of"))
    found = join_counted(every, parents, ["parent_key", "depth"], "left")
    found = found.withColumn("parent_conv_id", F.coalesce("of", "parent_conv_id")).withColumn("depth", F.col("depth").cast("long"))
    return found.select(*columns)


#: The heads exchanged for those of the first of 20 conversations, crc32 bit by bit, then nodes as lists of names.
ORACLE = r"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
         length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS name,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c FROM t),
bits AS (
  SELECT c, list_reduce(
      list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, 256, 256, 256, 256, 256, 256, 256, 256]))),
      lambda a, x: CASE WHEN x < 256 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS r FROM ids),
h AS (SELECT c, CAST(xor(r, 4294967295) % 4 AS BIGINT) AS h FROM bits),
parts AS (
  SELECT h.c, 0 AS side, t.pos, t.name, t.words FROM h JOIN t ON t.c = h.c - h.c % 20 AND t.pos < h.h
  UNION ALL SELECT h.c, 1, t.pos, t.name, t.words FROM h JOIN t ON t.c = h.c AND t.pos >= h.h),
full_ AS (SELECT ids.c, coalesce(list(sha256(name) ORDER BY side, pos) FILTER (WHERE name IS NOT NULL), []) AS p,
            coalesce(list(words ORDER BY side, pos) FILTER (WHERE name IS NOT NULL), []) AS w FROM ids LEFT JOIN parts USING (c) GROUP BY ids.c),
pre AS (SELECT c, d, list_slice(p, 1, d) AS k, CASE WHEN d > 0 THEN w[d] ELSE 0 END AS words, d = len(p) AS ends
        FROM (SELECT *, unnest(range(0, len(p) + 1)) AS d FROM full_)),
node AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
           sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM pre GROUP BY k, d),
kids AS (SELECT list_slice(k, 1, d - 1) AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
up AS (SELECT list_slice(k, 1, e) AS k, sum((n_convs - 1) * words) AS saved, count(*) FILTER (WHERE leaf) AS leaves
       FROM (SELECT node.*, unnest(range(0, d + 1)) AS e, kids.n IS NULL AS leaf FROM node LEFT JOIN kids USING (k)) GROUP BY 1)
SELECT node.conv_id, CAST(node.d AS BIGINT) AS depth, above.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n, 0) AS n_children,
       leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, node.ends_sha256
FROM node JOIN up USING (k) LEFT JOIN kids USING (k) LEFT JOIN node above ON node.d > 0 AND above.k = list_slice(node.k, 1, node.d - 1)
"""
