"""Skew-safe building blocks.

A key may own a third of all rows. Nothing here lets such a key land in one task: hot keys of a
join are split by adaptive execution, first-wins picks combine map-side, and exact quantiles of
a hot group are found by narrowing a value bracket instead of sorting the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import BROADCAST_BYTES, BROADCAST_ROWS, HOT_GROUP_ROWS
from ..session import cut_lineage


def split_join(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Shuffled join. Adaptive execution splits the partitions of hot keys of ``big`` and
    reads those of ``small`` once for each part; keys that are not hot cost nothing extra.

    The hint matters: Spark takes an exploded or pruned table for as small as the file it comes from,
    and would collect it on the driver for a broadcast."""
    return big.join(small.hint("merge"), list(keys), how)


def join_small(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    limit: int = BROADCAST_ROWS,
    limit_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join raw rows with a table of few rows per key without shuffling the raw rows.

    ``small`` is materialised, counted and measured. Up to ``limit`` rows of at most
    ``limit_bytes`` in all it is broadcast; beyond that it is a shuffled join. Deciding before the
    join starts matters: at run time the raw side would already have been written to shuffle files.
    """
    small = cut_lineage(small)
    # JSON is longer than the rows in memory are, fixed-width fields included
    size = F.sum(F.length(F.to_json(F.struct(*small.columns))) + 16 * len(small.columns))
    n, size = small.limit(limit + 1).agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    if n <= limit and size <= limit_bytes:
        return big.join(F.broadcast(small), list(keys), how)
    return split_join(big, small, keys, how)


def spread(rows: DataFrame) -> DataFrame:
    """Deal rows evenly over all tasks before a CPU-bound kernel.

    Each row is one unit of work. The number is explicit because adaptive execution would
    otherwise merge the few bytes of such an input into one task.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Keep-first dedup. ``order`` must be unique within a key (a row ordinal).

    ``min_by`` combines map-side, so copies of a key never meet in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """Exact interpolated quantiles of ``value`` per key, NULL and NaN ignored.

    One counting job decides which groups are hot. Groups of at most ``hot_rows``
    rows use the built-in exact percentile; larger ones go through
    :func:`_narrowed_quantiles`. Both give identical values.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    hot = cut_lineage(sizes.where(F.col("_n") > hot_rows))
    plain = [F.percentile("_v", F.lit(p)).alias(name) for name, p in probs.items()]
    if hot.isEmpty():
        return rows.groupBy(*keys).agg(*plain)
    tagged = join_small(rows, hot, keys, "left")
    cold = tagged.where(F.col("_n").isNull()).groupBy(*keys).agg(*plain)
    hot_part = _narrowed_quantiles(tagged.where(F.col("_n").isNotNull()).drop("_n"), hot, keys, probs, hot_rows)
    return cold.unionByName(hot_part)


def _narrowed_quantiles(rows, sizes, keys, probs, budget):
    """Quantiles of hot groups: shrink [lo, hi] around the wanted ranks until few distinct
    values are left, then rank only those.

    Brackets are one row for each hot group and quantile, so they are broadcast and the raw rows
    are not shuffled. A mergeable sketch proposes a bracket, exact counts check it. If
    the ranks lie beside it, the old bracket is cut there instead; both ends are values of the
    data, so every pass leaves less, until the budget holds or nothing but equal values is left.
    """
    wanted = F.explode(
        F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in probs.items()])
    )
    pos = F.col("_p") * (F.col("_n") - 1)
    bracket = (
        sizes.withColumn("_w", wanted)
        .select(*keys, "_n", F.col("_w.name").alias("_name"), F.col("_w.p").alias("_p"))
        .withColumn("_r0", F.floor(pos))
        .withColumn("_r1", F.ceil(pos))
        .withColumn("_frac", pos - F.floor(pos))
        .withColumn("_lo", F.lit(float("-inf")))
        .withColumn("_hi", F.lit(float("inf")))
        .withColumn("_left", F.col("_n"))
    )
    group = [*keys, "_name"]
    meta = [*group, "_n", "_p", "_r0", "_r1", "_frac"]
    inside = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    before = None
    while True:
        most, total = bracket.agg(F.max("_left"), F.sum("_left")).first()
        if most <= budget or total == before:
            break
        before = total
        # rank inside the bracket, as a fraction of the rows it still holds
        under = join_small(rows, bracket.drop("_left"), keys).groupBy(*meta, "_lo", "_hi").agg(
            F.count_if(F.col("_v") < F.col("_lo")).alias("_under"), F.count_if(inside).alias("_in"),
            F.percentile_approx(F.when(inside, F.col("_v")), [i / 200 for i in range(201)], 10000).alias("_q"),
        )
        at = F.floor((F.col("_r0") - F.col("_under")) / F.col("_in") * 200).cast("int")
        sketch = under.select(
            *meta, "_lo", "_hi", F.element_at("_q", F.greatest(at - 1, F.lit(1))).alias("_nlo"),
            F.element_at("_q", F.least(at + 4, F.lit(201))).alias("_nhi"),
        )
        checked = join_small(rows, sketch, keys).groupBy(*meta, "_lo", "_hi", "_nlo", "_nhi").agg(
            F.count_if(F.col("_v") < F.col("_nlo")).alias("_b"), F.count_if(F.col("_v") <= F.col("_nhi")).alias("_u"),
        )
        low = F.when(F.col("_r1") >= F.col("_u"), F.col("_nhi")).when(F.col("_r0") >= F.col("_b"), F.col("_nlo"))
        high = F.when(F.col("_r0") < F.col("_b"), F.col("_nlo")).when(F.col("_r1") < F.col("_u"), F.col("_nhi"))
        # two neighbouring ranks on both sides of an end: that end is the value of one of them
        narrowed = checked.select(*meta, F.coalesce(low, F.col("_lo")).alias("_lo"), F.coalesce(high, F.col("_hi")).alias("_hi"))
        left = join_small(rows, narrowed, keys).where(inside).groupBy(*meta, "_lo", "_hi", "_v").agg(F.lit(1).alias("_one"))
        bracket = cut_lineage(left.groupBy(*meta, "_lo", "_hi").agg(F.count("*").alias("_left")))
    # distinct values left in the bracket, with their exact cumulative ranks
    met = join_small(rows, bracket.drop("_left"), keys)
    start = met.groupBy(*group).agg(F.count_if(F.col("_v") < F.col("_lo")).alias("_under"))
    cands = met.where(inside).groupBy(*meta, "_v").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*group).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = cands.join(start, group).withColumn("_end", F.col("_under") + F.sum("_c").over(w))
    begin = F.col("_end") - F.col("_c")

    def at_rank(rank):
        return F.max(F.when((begin <= F.col(rank)) & (F.col("_end") > F.col(rank)), F.col("_v")))

    found = ranked.groupBy(*group, "_frac").agg(at_rank("_r0").alias("_a"), at_rank("_r1").alias("_b"))
    between = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_frac")
    found = found.withColumn("_x", F.when((F.col("_a") == F.col("_b")) | (F.col("_frac") == 0), F.col("_a")).otherwise(between))
    return found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == n, F.col("_x"))).alias(n) for n in probs]
    )
