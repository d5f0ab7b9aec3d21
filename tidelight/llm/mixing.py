"""Mixing sources to target weights by pivotal dependent rounding. DataFrame functions only.

Targets: the sources in code point order (null last) weigh 5, 2, 1, repeating, and share 150 % of
all words; a target stops at twice its source's words and the excess is shared again by weight.
The level at which no target is above is found from running sums over the sources in the order
in which they fill up.

Rounding: a document is taken ``floor(r)`` times for sure, r being its source's target by size,
and once more with probability p, the fraction of r. Pivotal rounding settles these: of two open
documents, one hands words of probability mass to the other (p times size), in either direction
with the odds that keep both expectations, until one of the two is certain. The sum of taken
words never changes, so a source comes within one document of its target. Pairs are folded in
buckets of about 200 documents; what stays open in each, one document, goes up a reduction tree
of such buckets, and the last one of a source is drawn. Each level is a grouping spread over
tasks, and a hot source simply has more buckets.

Draws come from hashes of seed, level, bucket and place in the bucket, so reruns agree. Rows equal in id and text are numbered, so that they spread too; which of them is taken does not matter.

Defined cases: a null or empty text has size 0 and is never taken; a null source is a source of
its own, last in order; equal ids and repeated rows are mixed as rows of their own; an empty
table gives no rows; sources of size 0 have target 0; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.skew import join_small
from .common import col, stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
BUCKET = 200


def sized(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """Rows with size, a key of the source that is never null, and the number of the repeat."""
    rows = docs.select(
        col(id_col).alias("doc_id"), col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(col(text_col)).alias("digest"))
    return rows.withColumn("copy", _copy_number("doc_id", "digest"))


def _copy_number(*keys: str):
    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))


def targets(rows: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, n_docs, target: one row for each source."""
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # windows over sources, not over documents
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    by = by.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (rank - 1) % len(weights) + 1))
    by = by.withColumn("cap", most * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("w").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = share * F.sum("source_size").over(everything)
    by = by.withColumn("level", (total - before) / onward)
    by = by.withColumn("open", F.col("cap") > F.col("w") * F.col("level"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), "source", "level"))).over(everything)["level"]
    share_of = F.when(F.col("open"), F.col("w") * level).otherwise(F.col("cap"))
    return by.select("source", "source_size", "n_docs", share_of.alias("target"))


def _draw(seed: int, *what):
    """Uniform in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *what), 11) * F.lit(2.0**-53)


def _fold(rows, seed: int, level: int):
    """Settle an array of open documents; the last element of the result is the one left open."""
    marked = F.transform(rows, lambda e, i: e.withField("u", _draw(seed, F.lit(level), e["bucket"], e["skey"], i)))

    def step(state, b):
        a, out = state["open"], state["out"]
        gain, loss = F.least(a["w"] - a["x"], b["x"]), F.least(a["x"], b["w"] - b["x"])
        up = b["u"] * (gain + loss) < loss  # a takes from b
        a_settled = F.when(up, a["w"] - a["x"] <= b["x"]).otherwise(a["x"] <= b["w"] - b["x"])
        settled = F.when(a_settled, a.withField("more", F.when(up, 1).otherwise(0))).otherwise(
            b.withField("more", F.when(up, 0).otherwise(1)))
        b_left = b.withField("x", F.when(up, b["x"] - (a["w"] - a["x"])).otherwise(b["x"] + a["x"]))
        a_left = a.withField("x", F.when(up, a["x"] + b["x"]).otherwise(a["x"] - (b["w"] - b["x"])))
        return F.struct(F.when(a_settled, b_left).otherwise(a_left).alias("open"), F.array_append(out, settled).alias("out"))

    first = F.struct(F.element_at(marked, 1).alias("open"), F.filter(marked, lambda e: F.lit(False)).alias("out"))
    return F.aggregate(F.slice(marked, 2, F.greatest(F.size(marked) - 1, F.lit(0))), first, step,
                       lambda s: F.array_append(s["out"], s["open"]))


def copies(docs: DataFrame, seed: int = 7, bucket: int = BUCKET, **columns) -> DataFrame:
    """doc_id, digest, copy, source, size, source_size, target, copies for each row of ``docs``."""
    rows = stage(sized(docs, **columns))
    goals = stage(targets(rows))
    skey = lambda: F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = join_small(rows.withColumn("skey", skey()), goals.withColumn("skey", skey()).drop("source"), ["skey"])
    rows = rows.withColumn("base", F.floor(ratio).cast("int")).withColumn("p", ratio - F.floor(ratio))
    sure = (F.col("size") == 0) | (F.col("p") <= 0)
    done = rows.where(sure).withColumn("more", F.lit(0))
    kept = ["doc_id", "digest", "copy", "source", "size", "source_size", "target", "base", "more"]
    parts = [done.select(*kept)]
    most = goals.agg(F.max("n_docs")).first()[0] or 0
    levels = max(1, math.ceil(math.log(max(most, 2), bucket)))
    left = rows.where(~sure).select(
        "skey", *kept[:-1], "n_docs", F.lit(0).alias("more"), F.col("size").cast("double").alias("w"),
        (F.col("p") * F.col("size")).alias("x"))
    for level in range(levels):
        # a bucket of one source holds about ``bucket`` of its open documents; the last level has one bucket
        buckets = F.lit(1) if level == levels - 1 else F.ceil(F.col("n_docs") / F.lit(float(bucket) ** (level + 1)))
        slot = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "doc_id", "digest", "copy"), buckets.cast("long"))
        left = left.withColumn("bucket", slot)
        item = F.struct(F.xxhash64(F.lit(seed), "doc_id", "digest", "copy").alias("order"), *left.columns, F.lit(0.0).alias("u"))
        met = left.groupBy("skey", "bucket").agg(F.sort_array(F.collect_list(item)).alias("rows"))
        met = met.select(F.posexplode(_fold(F.col("rows"), seed, level)).alias("at", "r"), F.size("rows").alias("n"))
        met = stage(met.select((F.col("at") == F.col("n") - 1).alias("is_open"), "r.*").drop("u", "order", "bucket"))
        parts.append(met.where(~F.col("is_open")).select(*kept))
        left = met.where("is_open").drop("is_open")
    last = _draw(seed, F.lit("last"), "skey", "doc_id") * F.col("w") < F.col("x")
    parts.append(left.withColumn("more", F.when(last, 1).otherwise(0)).select(*kept))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("copies", F.col("base") + F.col("more")).drop("base", "more")


def mix(docs: DataFrame, seed: int = 7, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Rows equal in id and text are alike; they share the copies of all of them."""
    took = copies(docs, seed, id_col=id_col, text_col=text_col, source_col=source_col)
    took = stage(took.groupBy(_name(F.col("doc_id")).alias("_key"), F.col("digest").alias("_digest")).agg(
        F.sum("copies").alias("_took"), F.count("*").alias("_rows")).where("_took > 0"))
    rows = docs.withColumns({"_key": _name(col(id_col)), "_digest": F.xxhash64(col(text_col))})
    times = F.col("_took")
    if not took.where("_rows > 1").isEmpty():
        rows = rows.withColumn("_copy", _copy_number("_key", "_digest"))
        times = F.floor(times / F.col("_rows")) + (F.col("_copy") <= times % F.col("_rows")).cast("long")
    joined = rows.join(took, ["_key", "_digest"]).withColumn("_times", times).where("_times > 0")
    return joined.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*map(col, docs.columns))


def _name(key):
    return F.coalesce(key.cast("string"), F.lit(""))
