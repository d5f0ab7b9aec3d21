"""Class-level power-law slopes from paired fluxes, as grouped sums.

No step collects a source or a class: every mean, sum and slope is a map-side combined
aggregate, and per-source or per-class constants are joined back to the pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SlopeConfig
from ..functions.expr import finite
from ..functions.photometry import log_sigma
from ..session import cut_lineage
from .skew import grouped_quantiles, join_small

CLASSES = ["BH", "NS", "UNKNOWN"]


def pooled_slope(
    pairs: DataFrame, cls: str = "cls", cfg: SlopeConfig = SlopeConfig()
) -> DataFrame:
    """Weighted log-log line with free offset per class: beta, beta_err, n_pairs.

    ``pairs`` has cls, xf, of, oe. Bad errors take the median good one (1 if none).
    Classes with fewer than ``min_pairs`` pairs fall back to the default slope.
    """
    rows = pairs.select(
        F.col(cls).alias("cls"),
        F.log10(F.greatest("xf", F.lit(cfg.flux_floor))).alias("x"),
        F.log10("of").alias("y"),
        log_sigma(F.col("oe"), F.col("of")).alias("s"),
        "xf",
    )
    good = finite(F.col("s")) & (F.col("s") > 0)
    # the pairs are read once per pass below: materialise them once
    rows = cut_lineage(rows.withColumn("good", F.when(good, F.col("s"))))
    fill = grouped_quantiles(rows, ["cls"], "good", {"fill": 0.5})
    rows = join_small(rows, fill, ["cls"], "left")
    rows = rows.withColumn(
        "w", 1.0 / F.pow(F.coalesce("good", "fill", F.lit(1.0)), F.lit(2.0))
    )
    sums = rows.groupBy("cls").agg(
        F.count("*").alias("n_pairs"),
        F.sum("w").alias("s0"),
        (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mx"),
        (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("my"),
    )
    rows = join_small(rows, sums, ["cls"])
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    fit = rows.groupBy("cls", "n_pairs").agg(
        F.sum(F.col("w") * dx * dx).alias("sxx"), F.sum(F.col("w") * dx * dy).alias("sxy")
    )
    ok = (F.col("n_pairs") >= cfg.min_pairs) & (F.col("sxx") > 0)
    fit = fit.select(
        "cls", "n_pairs",
        F.when(ok, F.try_divide("sxy", "sxx")).otherwise(cfg.fallback_beta).alias("beta"),
        F.when(ok, F.sqrt(F.try_divide(F.lit(1.0), "sxx"))).alias("beta_err"),
    )
    return _all_classes(fit, cfg, {"n_pairs": 0})


def fixed_effects_slope(
    pairs: DataFrame, cls: str = "cls", source: str = "source", cfg: SlopeConfig = SlopeConfig()
) -> DataFrame:
    """Slope through the origin of per-source centred log fluxes, clipped once.

    Output per class: beta, beta_err, scatter_dex, n_pairs_used, n_pairs_total,
    n_sources_used, n_sources_total.
    """
    keys = ["cls", "source"]
    rows = pairs.select(
        F.col(cls).alias("cls"), F.col(source).alias("source"), "xf", "of", "oe"
    )
    valid = finite(F.col("xf")) & finite(F.col("of")) & finite(F.col("oe"))
    # the pairs are read once per pass below: materialise them once
    rows = cut_lineage(rows.withColumn("ok", valid & (F.col("xf") > 0) & (F.col("of") > 0)))
    totals = rows.groupBy(*keys).agg(
        F.count("*").alias("np"),
        F.count_if("ok").alias("nv"),
        F.coalesce(F.bool_and(F.when(F.col("ok"), F.col("oe") > 0)), F.lit(False)).alias("weighted"),
    )
    usable = totals.where(F.col("nv") >= cfg.min_pairs_per_source)
    per_class = totals.groupBy("cls").agg(
        F.sum("np").alias("n_pairs_total"),
        F.count("*").alias("n_sources_total"),
        F.count_if(F.col("nv") >= cfg.min_pairs_per_source).alias("n_sources_used"),
    )
    rows = join_small(rows.where("ok"), usable.select(*keys, "weighted"), keys)
    dex = F.greatest(log_sigma(F.col("oe"), F.col("of")), F.lit(cfg.sigma_floor_dex))
    rows = rows.select(
        *keys, F.log10("xf").alias("x"), F.log10("of").alias("y"),
        F.when(F.col("weighted"), dex).otherwise(1.0).alias("s"),
    ).withColumn("w", 1.0 / F.pow("s", F.lit(2.0)))
    means = rows.groupBy(*keys).agg(
        (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mx"),
        (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("my"),
    )
    rows = join_small(rows, means, keys)
    rows = rows.select(
        "cls", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"), "s", "w"
    )
    wxx, wxy = F.col("w") * F.col("x") * F.col("x"), F.col("w") * F.col("x") * F.col("y")
    first = rows.groupBy("cls").agg(
        F.count("*").alias("n0"), F.sum(wxx).alias("sxx"), F.sum(wxy).alias("sxy")
    )
    first = first.where((F.col("n0") >= cfg.min_pairs) & (F.col("sxx") > 0)).select(
        "cls", "n0", (F.col("sxy") / F.col("sxx")).alias("b0")
    )
    rows = join_small(rows, first, ["cls"])
    rows = rows.withColumn(
        "keep", F.abs((F.col("y") - F.col("b0") * F.col("x")) / F.col("s")) <= cfg.clip_sigma
    )
    # both the clipped and the full sums in one pass; the guard picks one of them
    def sums(cond, tag):
        pick = lambda c: F.sum(F.when(cond, c))
        return [
            F.count_if(cond).alias(f"n{tag}"), pick(F.col("w")).alias(f"w{tag}"),
            pick(wxx).alias(f"xx{tag}"), pick(wxy).alias(f"xy{tag}"),
            pick(F.col("w") * F.col("y") * F.col("y")).alias(f"yy{tag}"),
        ]
    fit = rows.groupBy("cls").agg(*sums(F.col("keep"), "k"), *sums(F.lit(True), "a"))
    clipped = (F.col("nk") >= cfg.min_pairs) & (F.col("nk") < F.col("na"))
    pick = lambda name: F.when(clipped, F.col(f"{name}k")).otherwise(F.col(f"{name}a")).alias(name)
    fit = fit.select("cls", *[pick(n) for n in ("n", "w", "xx", "xy", "yy")])
    beta = F.try_divide("xy", "xx")
    # sum w (y - b x)^2 at the least-squares slope
    rss = F.greatest(F.col("yy") - F.col("xy") * beta, F.lit(0.0))
    fit = fit.where((F.col("xx") > 0) & (F.abs(beta) <= cfg.max_abs_beta)).select(
        "cls", beta.alias("beta"), F.sqrt(1.0 / F.col("xx")).alias("beta_err"),
        F.sqrt(rss / F.col("w")).alias("scatter_dex"), F.col("n").alias("n_pairs_used"),
    )
    fit = per_class.join(fit, "cls", "left").withColumn(
        "n_sources_used", F.when(F.col("beta").isNotNull(), F.col("n_sources_used")).otherwise(0)
    )
    zero = {"n_pairs_used": 0, "n_pairs_total": 0, "n_sources_used": 0, "n_sources_total": 0}
    return _all_classes(fit, cfg, zero)


def _all_classes(fit: DataFrame, cfg: SlopeConfig, zero: dict[str, int]) -> DataFrame:
    """One row per class; a class without a fit, and UNKNOWN always, takes the fallback."""
    spark = fit.sparkSession
    classes = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in CLASSES])).alias("cls"))
    out = classes.join(fit.where("cls <> 'UNKNOWN'"), "cls", "left")
    cols = [
        F.coalesce(c, F.lit(zero[c])).cast("long").alias(c) if c in zero
        else F.coalesce(c, F.lit(cfg.fallback_beta)).alias(c) if c == "beta"
        else F.col(c)
        for c in out.columns if c != "cls"
    ]
    return out.select(F.col("cls").alias("compact_object"), *cols)
