"""Spans, pairing in time, slopes, forward simulation, hardness, photometry."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import SlopeConfig
from ..functions import photometry as ph
from ..functions.expr import rnd
from ..functions.names import canonical_key, class_label
from ..operators import slope, timejoin
from ..operators.skew import first_per_key, grouped_quantiles, join_small
from ..session import cut_lineage
from ..sources.tables import lightcurve, multiband, optical, table, xray
from . import sqltext as q
from .sqltext import LC, MULTI, OPT, XRAY, r, with_

SPAN = ["source", "outburst_idx"]


def thirds(spark, sf):
    """Three closed spans per source covering its light curve."""
    ends = lightcurve(spark, sf).groupBy("source").agg(F.min("mjd").alias("a"), F.max("mjd").alias("b"))
    step = (F.col("b") - F.col("a")) / 3.0
    one = F.explode(F.sequence(F.lit(1), F.lit(3))).alias("outburst_idx")
    spans = ends.select("source", "a", step.alias("s"), one).select(
        "source", F.col("outburst_idx").cast("long").alias("outburst_idx"),
        (F.col("a") + F.col("s") * (F.col("outburst_idx") - 1)).alias("t_start"),
        (F.col("a") + F.col("s") * F.col("outburst_idx")).alias("t_end"),
    )
    return cut_lineage(spans)


def classification(spark, sf):
    """Free-text class list keyed by a spelling variant of the source name."""
    c = table(spark, sf, "customer")
    label = (
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", "BH candidate")
        .when(F.col("c_mktsegment") == "BUILDING", "Black hole")
        .when(F.col("c_mktsegment") == "FURNITURE", "NS")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "neutron star")
    )
    kind = F.when(F.col("c_nationkey") % 5 != 0, F.when(F.col("c_nationkey") % 2 == 0, "LMXB").otherwise("HMXB"))
    return c.select(
        F.concat(F.lit("src -"), F.col("c_custkey").cast("string")).alias("name"),
        label.alias("label"), kind.alias("kind"), F.col("c_custkey").alias("pos"),
    )


def class_lookup(spark, sf):
    """One row per canonical key, the last one wins."""
    c = classification(spark, sf).select(
        canonical_key(F.col("name")).alias("ckey"), class_label(F.col("label")).alias("cls"),
        F.coalesce("kind", F.lit("UNKNOWN")).alias("src_type"), "pos",
    )
    return first_per_key(c, ["ckey"], -F.col("pos")).drop("pos")


def with_class(df, spark, sf):
    """Left join on the canonical key; a miss is UNKNOWN."""
    df = df.withColumn("ckey", canonical_key(F.concat(F.lit("SRC_"), F.col("source").cast("string"))))
    out = join_small(df, class_lookup(spark, sf), ["ckey"], "left")
    return out.drop("ckey").fillna("UNKNOWN", ["cls", "src_type"])


def xray_flux(spark, sf):
    return xray(spark, sf).select(
        "source", "mjd", ph.counts_to_cgs(F.col("xf")).alias("xf"),
        ph.counts_to_cgs(F.col("xe")).alias("xe"), "row_id",
    )


def optical_flux(spark, sf):
    return optical(spark, sf).select(
        "source", "mjd", ph.flux_mjy(F.col("mag")).alias("of"),
        ph.flux_mjy_err(F.col("mag"), F.col("magerr")).alias("oe"), "row_id",
    )


def _pairs(opt, xr, spans, cfg=SlopeConfig()):
    """Optical rows with the nearest X-ray row of the same span."""
    left = timejoin.crop_to_spans(opt, spans, ["source"]).drop("t_start", "t_end")
    right = timejoin.crop_to_spans(xr, spans, ["source"]).drop("t_start", "t_end")
    return timejoin.nearest_in_time(left, right, SPAN, cfg.tol_days, "row_id")


def simple_pairs(spark, sf, spans=None):
    near = _pairs(optical_flux(spark, sf), xray_flux(spark, sf), thirds(spark, sf) if spans is None else spans)
    return near.where((F.col("r_xf") > 0) & (F.col("of") > 0))


def phase_pairs_df(spark, sf, which="rise", cfg=SlopeConfig()):
    """Pairs on one side of the X-ray peak, above the SNR cut and the optical baseline."""
    spans = thirds(spark, sf)
    opt = optical_flux(spark, sf)
    xr = timejoin.crop_to_spans(xray_flux(spark, sf), spans, ["source"]).drop("t_start", "t_end")
    xr = timejoin.with_peak(xr, SPAN, "xf")
    if which == "rise":
        xr = xr.where(F.col("mjd") <= F.col("peak_mjd"))
    elif which == "decay":
        xr = xr.where(F.col("mjd") >= F.col("peak_mjd"))
    xr = xr.drop("peak_mjd", "peak_value", "n_span")
    left = timejoin.crop_to_spans(opt, spans, ["source"]).drop("t_start", "t_end")
    near = timejoin.nearest_in_time(left, xr, SPAN, cfg.tol_days, "row_id")
    floor = grouped_quantiles(opt, ["source"], "of", {"quiet": cfg.baseline_percentile})
    near = join_small(near, floor, ["source"])
    near = near.withColumn("excess", F.col("of") - F.col("quiet"))
    snr = F.col("r_xf") / F.greatest("r_xe", F.lit(1e-30))
    return near.where((F.col("r_xf") > 0) & (snr >= cfg.min_snr) & (F.col("excess") > 0))


def span_crop(spark, sf):
    df = timejoin.crop_to_spans(xray(spark, sf), thirds(spark, sf), ["source"])
    return df.select("source", "outburst_idx", "row_id", rnd(F.col("mjd"), 6).alias("mjd"), "xf")


def padded_view(spark, sf):
    """Points within 2 days of a span, flagged inside or outside."""
    df = timejoin.crop_to_spans(xray(spark, sf), thirds(spark, sf), ["source"], pad=2.0)
    inside = (F.col("mjd") >= F.col("t_start")) & (F.col("mjd") <= F.col("t_end"))
    return df.groupBy("source", "outburst_idx").agg(
        F.count("*").alias("n_view"), F.count_if(inside).alias("n_inside")
    )


def nearest_pairs(spark, sf):
    near = simple_pairs(spark, sf)
    return near.select(
        "source", "outburst_idx", "row_id", "r_row_id", rnd(F.col("dt"), 6).alias("dt"),
        rnd(F.col("of"), 4).alias("of"), rnd(F.col("r_xf") * 1e9, 6).alias("xf_nano"),
    )


def _phase_query(which):
    def run(spark, sf):
        near = phase_pairs_df(spark, sf, which)
        return near.select(
            "source", "outburst_idx", "row_id", "r_row_id", rnd(F.col("dt"), 6).alias("dt"),
            rnd(F.col("excess"), 4).alias("excess"),
        )
    return run


def phase_label(spark, sf):
    df = timejoin.crop_to_spans(xray(spark, sf), thirds(spark, sf), ["source"])
    df = timejoin.with_peak(df, SPAN, "xf")
    return df.select(
        "source", "outburst_idx", "row_id", timejoin.phase(F.col("mjd"), F.col("peak_mjd")).alias("phase"),
        rnd(F.col("peak_mjd"), 6).alias("peak_mjd"), "peak_value",
    )


def percentile_baseline(spark, sf):
    return grouped_quantiles(optical_flux(spark, sf), ["source"], "of", {"p10": 0.1, "p50": 0.5}).select(
        "source", rnd(F.col("p10"), 4).alias("p10"), rnd(F.col("p50"), 4).alias("p50")
    )


def wls_loglog(spark, sf):
    near = with_class(simple_pairs(spark, sf), spark, sf)
    fit = slope.pooled_slope(near.select("cls", F.col("r_xf").alias("xf"), "of", "oe"))
    return fit.select(
        "compact_object", rnd(F.col("beta"), 6).alias("beta"), rnd(F.col("beta_err"), 6).alias("beta_err"), "n_pairs"
    )


def _fixed_effects_fit(spark, sf):
    near = with_class(phase_pairs_df(spark, sf, "rise"), spark, sf)
    return slope.fixed_effects_slope(
        near.select("cls", "source", F.col("r_xf").alias("xf"), F.col("excess").alias("of"), "oe")
    )


def fixed_effects_beta(spark, sf):
    fit = _fixed_effects_fit(spark, sf)
    return fit.select(
        "compact_object", rnd(F.col("beta"), 6).alias("beta"), rnd(F.col("beta_err"), 6).alias("beta_err"),
        rnd(F.col("scatter_dex"), 6).alias("scatter_dex"),
        "n_pairs_used", "n_pairs_total", "n_sources_used", "n_sources_total",
    )


def span_points(spark, sf, spans=None):
    """X-ray points of spans with at least three of them, with their peak and class."""
    df = timejoin.crop_to_spans(xray_flux(spark, sf), thirds(spark, sf) if spans is None else spans, ["source"])
    df = timejoin.with_peak(df, SPAN, "xf").where("n_span >= 3")
    return with_class(df, spark, sf)


def with_beta(df, fit):
    """Slope per class with the default for classes that have none."""
    betas = fit.select(F.col("compact_object").alias("cls"), "beta")
    out = join_small(df, betas, ["cls"], "left")
    return out.withColumn("beta", F.coalesce("beta", F.lit(SlopeConfig().fallback_beta)))


def forward_sim(spark, sf):
    near = with_class(simple_pairs(spark, sf), spark, sf)
    fit = slope.pooled_slope(near.select("cls", F.col("r_xf").alias("xf"), "of", "oe"))
    df = with_beta(span_points(spark, sf), fit)
    return df.select(
        "source", "outburst_idx", "row_id", timejoin.phase(F.col("mjd"), F.col("peak_mjd")).alias("phase"),
        rnd(ph.reprocessed(F.col("xf"), F.col("beta")), 8).alias("predicted"),
        rnd(ph.unit_power(F.col("xf"), F.col("beta")), 8).alias("floored"),
    )


def forward_sim_tapered(spark, sf):
    cfg = SlopeConfig()
    df = with_beta(span_points(spark, sf), _fixed_effects_fit(spark, sf))
    snr = F.col("xf") / F.greatest("xe", F.lit(1e-30))
    clean = ph.snr_weight(snr, cfg.snr_floor, cfg.taper_width) * F.greatest("xf", F.lit(0.0))
    return df.select(
        "source", "outburst_idx", "row_id", timejoin.phase(F.col("mjd"), F.col("peak_mjd")).alias("phase"),
        # of the logarithm, so that small predictions are compared as closely as large ones
        rnd(F.when(clean > 0, F.log10(ph.reprocessed(clean, F.col("beta")))), 6).alias("log_shape"),
    )


def hardness_points(spark, sf):
    """Coerced, both bands positive, relative errors at most one where known."""
    m = multiband(spark, sf).where("flux_4_10 > 0 AND flux_10_20 > 0")
    for b in ("4_10", "10_20"):
        err = F.col(f"err_{b}")
        m = m.where(err.isNull() | (F.abs(err / F.col(f"flux_{b}")) <= 1.0))
    hr, hr_err = ph.hardness(
        F.col("flux_4_10"), F.col("flux_10_20"), F.col("err_4_10"), F.col("err_10_20")
    )
    return m.withColumn("hr_x", hr).withColumn("hr_x_err", hr_err)


def hardness_ratio(spark, sf):
    return hardness_points(spark, sf).select(
        "source", rnd(F.col("mjd"), 1).alias("mjd"), rnd(F.col("hr_x"), 6).alias("hr_x"),
        rnd(F.col("hr_x_err"), 6).alias("hr_x_err"), rnd(F.col("flux_2_20"), 6).alias("flux_2_20"),
    )


def hardness_in_spans(spark, sf):
    df = timejoin.crop_to_spans(hardness_points(spark, sf), thirds(spark, sf), ["source"])
    return df.groupBy("source", "outburst_idx").agg(
        F.count("*").alias("n_hr"), rnd(F.min("hr_x"), 6).alias("hr_min"),
        rnd(F.max("hr_x"), 6).alias("hr_max"),
        (F.count("flux_2_20") >= 2).alias("has_hid"),
    )


def hardness_series(spark, sf):
    """Hardness points of each span, in time order, and whether they make a hardness-intensity track."""
    df = timejoin.crop_to_spans(hardness_points(spark, sf), thirds(spark, sf), SPAN[:1])
    # a span's daily points are bounded by its length
    whole = Window.partitionBy(*SPAN)
    df = df.withColumn("point", F.row_number().over(whole.orderBy("mjd")))
    track = (F.count("flux_2_20").over(whole) >= 2) & F.col("flux_2_20").isNotNull()
    return df.select(
        *SPAN, F.col("point").cast("long").alias("point"), rnd(F.col("mjd"), 1).alias("mjd"), rnd(F.col("hr_x"), 6).alias("hr_x"),
        rnd(F.col("hr_x_err"), 6).alias("hr_x_err"), rnd(F.col("flux_2_20"), 6).alias("flux_2_20"), track.alias("in_track"),
    )


def observed_vs_predicted(spark, sf):
    """Observed excess beside the prediction of the pooled slope, scaled to the span's own median."""
    near = with_class(simple_pairs(spark, sf), spark, sf)
    fit = slope.pooled_slope(near.select("cls", F.col("r_xf").alias("xf"), "of", "oe"))
    df = with_beta(near, fit).withColumn("model", ph.reprocessed(F.col("r_xf"), F.col("beta")))
    df = cut_lineage(df)
    for value, name in (("of", "mo"), ("model", "mm")):
        df = join_small(df, grouped_quantiles(df, SPAN, value, {name: 0.5}), SPAN)
    return df.select(
        *SPAN, "row_id", rnd(F.col("of"), 4).alias("observed"),
        rnd(F.col("model") * F.try_divide("mo", "mm"), 4).alias("predicted"),
    )


def four_panels(spark, sf):
    """Points of the sources that have both curves: panel, time, value and error of each."""
    x, o = xray(spark, sf), optical(spark, sf)
    both = x.select("source").distinct().join(o.select("source").distinct(), "source")
    bands = o.where("filtercode IN ('zg', 'zr')")
    parts = [
        x.select("source", F.lit("xray").alias("panel"), "mjd", F.col("xf").alias("val"), F.col("xe").alias("err")),
        bands.select("source", F.col("filtercode").alias("panel"), "mjd", F.col("mag").alias("val"), F.col("magerr").alias("err")),
    ]
    hard = hardness_points(spark, sf).select("source", F.lit("hardness").alias("panel"), "mjd", F.col("hr_x").alias("val"), F.col("hr_x_err").alias("err"))
    df = parts[0].unionByName(parts[1]).unionByName(hard)
    df = join_small(df, both, ["source"])
    return df.select("source", "panel", rnd(F.col("mjd"), 4).alias("mjd"), rnd(F.col("val"), 6).alias("val"), rnd(F.col("err"), 6).alias("err"))


def mag_to_flux(spark, sf):
    return optical(spark, sf).select(
        "row_id",
        rnd(ph.relative_flux(F.col("mag")) * 1e6, 6).alias("rel_e6"),
        rnd(ph.relative_flux_err(F.col("mag"), F.col("magerr")) * 1e6, 6).alias("rel_err_e6"),
        rnd(ph.flux_mjy(F.col("mag")), 4).alias("mjy"),
        rnd(ph.flux_mjy_err(F.col("mag"), F.col("magerr")), 4).alias("mjy_err"),
    )


QUERIES = {
    "span_crop": span_crop,
    "padded_view": padded_view,
    "nearest_pairs": nearest_pairs,
    "phase_pairs_rise": _phase_query("rise"),
    "phase_pairs_decay": _phase_query("decay"),
    "phase_label": phase_label,
    "percentile_baseline": percentile_baseline,
    "wls_loglog": wls_loglog,
    "fixed_effects_beta": fixed_effects_beta,
    "forward_sim": forward_sim,
    "forward_sim_tapered": forward_sim_tapered,
    "hardness_ratio": hardness_ratio,
    "hardness_in_spans": hardness_in_spans,
    "hardness_series": hardness_series,
    "observed_vs_predicted": observed_vs_predicted,
    "four_panels": four_panels,
    "mag_to_flux": mag_to_flux,
}

SPANS = """
ends AS (SELECT source, min(mjd) AS a, max(mjd) AS b FROM lc GROUP BY source),
spans AS (
  SELECT source, CAST(i AS BIGINT) AS outburst_idx, a + ((b - a) / 3.0) * (i - 1) AS t_start,
         a + ((b - a) / 3.0) * i AS t_end
  FROM ends, (SELECT unnest([1, 2, 3]) AS i))"""
XF = "xs AS (SELECT source, mjd, xf * (2.4e-8 / 3.3) AS xf, xe * (2.4e-8 / 3.3) AS xe, row_id FROM xr)"
OF = """os AS (SELECT source, mjd, 3631.0 * pow(10.0, -0.4 * mag) * 1000.0 AS of,
  3631.0 * pow(10.0, -0.4 * mag) * 1000.0 * magerr / 1.0857 AS oe, row_id FROM opt)"""
CROP = """
xw AS (SELECT s.outburst_idx, x.* FROM xs x JOIN spans s ON s.source = x.source AND x.mjd BETWEEN s.t_start AND s.t_end),
ow AS (SELECT s.outburst_idx, o.* FROM os o JOIN spans s ON s.source = o.source AND o.mjd BETWEEN s.t_start AND s.t_end)"""


def near(xname: str) -> str:
    return f"""
nn AS (
  SELECT o.*, x.row_id AS r_row_id, x.xf, x.xe, abs(x.mjd - o.mjd) AS dt,
         row_number() OVER (PARTITION BY o.source, o.outburst_idx, o.row_id ORDER BY abs(x.mjd - o.mjd), x.row_id) AS k
  FROM ow o JOIN {xname} x ON x.source = o.source AND x.outburst_idx = o.outburst_idx AND abs(x.mjd - o.mjd) <= 1.0)"""


SIMPLE = "pairs AS (SELECT * FROM nn WHERE k = 1 AND xf > 0 AND of > 0)"


def phase_ctes(op: str) -> str:
    return f"""
pk AS (SELECT source, outburst_idx, arg_max(mjd, xf ORDER BY mjd) AS peak_mjd FROM xw GROUP BY 1, 2),
xp AS (SELECT xw.* FROM xw JOIN pk USING (source, outburst_idx) WHERE xw.mjd {op} pk.peak_mjd),
{near('xp')},
q10 AS (SELECT source, quantile_cont(of, 0.1) AS quiet FROM os GROUP BY source),
pairs AS (
  SELECT nn.*, of - quiet AS excess FROM nn JOIN q10 USING (source)
  WHERE k = 1 AND xf > 0 AND xf / greatest(xe, 1e-30) >= 3.0 AND of - quiet > 0)"""


CLS = """
cls AS (
  SELECT DISTINCT ON (ckey) ckey, cls, kind FROM (
    SELECT 'SRC' || c_custkey AS ckey, c_custkey AS pos,
           CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'BH' WHEN 'BUILDING' THEN 'BH' WHEN 'FURNITURE' THEN 'NS'
                WHEN 'HOUSEHOLD' THEN 'NS' ELSE 'UNKNOWN' END AS cls,
           CASE WHEN c_nationkey % 5 = 0 THEN 'UNKNOWN' WHEN c_nationkey % 2 = 0 THEN 'LMXB' ELSE 'HMXB' END AS kind
    FROM customer) ORDER BY ckey, pos DESC)"""
CLASSED = """
cp AS (SELECT pairs.*, coalesce(cls.cls, 'UNKNOWN') AS cls
       FROM pairs LEFT JOIN cls ON cls.ckey = 'SRC' || pairs.source)"""
THREE = "three AS (SELECT unnest(['BH', 'NS', 'UNKNOWN']) AS c)"
BASE = [LC, OPT, XRAY, SPANS, XF, OF, CROP]
POOLED = """
l0 AS (SELECT cls, log10(greatest(xf, 1e-30)) AS x, log10(of) AS y, oe / of / ln(10.0) AS s FROM cp),
l1 AS (SELECT *, median(CASE WHEN s > 0 THEN s END) OVER (PARTITION BY cls) AS fill FROM l0),
l2 AS (SELECT cls, x, y, 1.0 / coalesce(CASE WHEN s > 0 THEN s END, fill, 1.0) ** 2 AS w FROM l1),
l3 AS (SELECT cls, count(*) AS n, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM l2 GROUP BY cls),
l4 AS (SELECT l2.cls, any_value(n) AS n, sum(w * (x - mx) ** 2) AS sxx, sum(w * (x - mx) * (y - my)) AS sxy
       FROM l2 JOIN l3 USING (cls) GROUP BY l2.cls),
fit AS (SELECT cls, n, CASE WHEN n >= 5 THEN sxy / sxx ELSE 0.5 END AS beta,
               CASE WHEN n >= 5 THEN sqrt(1.0 / sxx) END AS beta_err FROM l4 WHERE cls <> 'UNKNOWN')"""
FIXED = """
f0 AS (SELECT cls, source, xf, excess AS of, oe, xf > 0 AND excess > 0 AS ok FROM cp),
f1 AS (SELECT cls, source, count(*) AS np, count(*) FILTER (WHERE ok) AS nv,
              bool_and(oe > 0) FILTER (WHERE ok) AS weighted FROM f0 GROUP BY cls, source),
f2 AS (SELECT cls, sum(np) AS npt, count(*) AS nst, count(*) FILTER (WHERE nv >= 2) AS nsu FROM f1 GROUP BY cls),
f3 AS (SELECT f0.cls, f0.source, log10(xf) AS x, log10(of) AS y,
              CASE WHEN weighted THEN greatest(oe / (of * ln(10.0)), 1e-3) ELSE 1.0 END AS s
       FROM f0 JOIN f1 USING (cls, source) WHERE ok AND nv >= 2),
f4 AS (SELECT cls, x - sum(x / s ** 2) OVER g / sum(1 / s ** 2) OVER g AS x,
              y - sum(y / s ** 2) OVER g / sum(1 / s ** 2) OVER g AS y, s
       FROM f3 WINDOW g AS (PARTITION BY cls, source)),
f5 AS (SELECT cls, count(*) AS n0, sum(x * y / s ** 2) / sum(x * x / s ** 2) AS b0 FROM f4 GROUP BY cls HAVING count(*) >= 5),
f6 AS (SELECT f4.*, abs((y - b0 * x) / s) <= 3.0 AS keep FROM f4 JOIN f5 USING (cls)),
f7 AS (SELECT *, count(*) FILTER (WHERE keep) OVER (PARTITION BY cls) AS nk, count(*) OVER (PARTITION BY cls) AS na FROM f6),
f8 AS (SELECT * FROM f7 WHERE keep OR NOT (nk >= 5 AND nk < na)),
f9 AS (SELECT cls, count(*) AS n, sum(x * y / s ** 2) / sum(x * x / s ** 2) AS beta,
              sqrt(1.0 / sum(x * x / s ** 2)) AS beta_err FROM f8 GROUP BY cls),
fa AS (SELECT f8.cls, any_value(f9.n) AS n, any_value(beta) AS beta, any_value(beta_err) AS beta_err,
              sqrt(sum((y - beta * x) ** 2 / s ** 2) / sum(1 / s ** 2)) AS scatter
       FROM f8 JOIN f9 USING (cls) GROUP BY f8.cls HAVING any_value(abs(beta)) <= 3.0)"""
XCLASSED = """
xc0 AS (SELECT xw.*, arg_max(mjd, xf ORDER BY mjd) OVER (PARTITION BY source, outburst_idx) AS pm0,
              count(*) OVER (PARTITION BY source, outburst_idx) AS n FROM xw),
xpk AS (SELECT source, outburst_idx, arg_max(mjd, xf ORDER BY mjd) AS peak_mjd FROM xw GROUP BY 1, 2),
xc AS (SELECT x.*, peak_mjd, coalesce(cls.cls, 'UNKNOWN') AS cls
       FROM (SELECT *, count(*) OVER (PARTITION BY source, outburst_idx) AS n FROM xw) x
       JOIN xpk USING (source, outburst_idx) LEFT JOIN cls ON cls.ckey = 'SRC' || x.source WHERE n >= 3)"""
XCLASSED = XCLASSED[XCLASSED.index("xpk AS"):]
HARD = """
hr AS (
  SELECT *, flux_10_20 / flux_4_10 AS hr_x,
         flux_10_20 / flux_4_10 * sqrt((err_10_20 / flux_10_20) ** 2 + (err_4_10 / flux_4_10) ** 2) AS hr_x_err
  FROM mb WHERE flux_4_10 > 0 AND flux_10_20 > 0
    AND (err_4_10 IS NULL OR abs(err_4_10 / flux_4_10) <= 1.0)
    AND (err_10_20 IS NULL OR abs(err_10_20 / flux_10_20) <= 1.0))"""
PHASE_COLS = f"SELECT source, outburst_idx, row_id, r_row_id, {r('dt', 6, 'dt')}, {r('excess', 4, 'excess')} FROM pairs"

ORACLE = {
    "span_crop": with_(LC, XRAY, SPANS) + """
SELECT x.source, outburst_idx, row_id, round(mjd, 6) + 0.0 AS mjd, xf
FROM xr x JOIN spans s ON s.source = x.source AND x.mjd BETWEEN t_start AND t_end""",
    "padded_view": with_(LC, XRAY, SPANS) + """
SELECT x.source, outburst_idx, count(*) AS n_view, count(*) FILTER (WHERE mjd BETWEEN t_start AND t_end) AS n_inside
FROM xr x JOIN spans s ON s.source = x.source AND x.mjd BETWEEN t_start - 2.0 AND t_end + 2.0 GROUP BY 1, 2""",
    "nearest_pairs": with_(*BASE, near("xw"), SIMPLE) + f"""
SELECT source, outburst_idx, row_id, r_row_id, {r('dt', 6, 'dt')}, {r('of', 4, 'of')},
       {r('xf * 1e9', 6, 'xf_nano')} FROM pairs""",
    "phase_pairs_rise": with_(*BASE, phase_ctes("<=")) + PHASE_COLS,
    "phase_pairs_decay": with_(*BASE, phase_ctes(">=")) + PHASE_COLS,
    "phase_label": with_(
        LC, XRAY, SPANS,
        "w AS (SELECT s.outburst_idx, x.* FROM xr x JOIN spans s ON s.source = x.source AND x.mjd BETWEEN t_start AND t_end)",
        "p AS (SELECT source, outburst_idx, arg_max(mjd, xf ORDER BY mjd) AS pm, max(xf) AS pv FROM w GROUP BY 1, 2)",
    ) + """SELECT source, outburst_idx, row_id, CASE WHEN mjd <= pm THEN 'rise' ELSE 'decay' END AS phase,
  round(pm, 6) + 0.0 AS peak_mjd, pv AS peak_value FROM w JOIN p USING (source, outburst_idx)""",
    "percentile_baseline": with_(LC, OPT, OF) + """
SELECT source, round(quantile_cont(of, 0.1), 4) + 0.0 AS p10, round(quantile_cont(of, 0.5), 4) + 0.0 AS p50
FROM os GROUP BY source""",
    "wls_loglog": with_(*BASE, near("xw"), SIMPLE, CLS, CLASSED, POOLED, THREE) + """
SELECT c AS compact_object, round(coalesce(beta, 0.5), 6) + 0.0 AS beta, round(beta_err, 6) + 0.0 AS beta_err,
       coalesce(n, 0) AS n_pairs FROM three LEFT JOIN fit ON fit.cls = c""",
    "fixed_effects_beta": with_(*BASE, phase_ctes("<="), CLS, CLASSED, FIXED, THREE) + """
SELECT c AS compact_object, round(coalesce(beta, 0.5), 6) + 0.0 AS beta, round(beta_err, 6) + 0.0 AS beta_err,
       round(scatter, 6) + 0.0 AS scatter_dex, coalesce(n, 0) AS n_pairs_used,
       CAST(CASE WHEN c = 'UNKNOWN' THEN 0 ELSE coalesce(npt, 0) END AS BIGINT) AS n_pairs_total,
       CASE WHEN beta IS NULL OR c = 'UNKNOWN' THEN 0 ELSE nsu END AS n_sources_used,
       CASE WHEN c = 'UNKNOWN' THEN 0 ELSE coalesce(nst, 0) END AS n_sources_total
FROM three LEFT JOIN (SELECT * FROM fa WHERE cls <> 'UNKNOWN') fa ON fa.cls = c LEFT JOIN f2 ON f2.cls = c""",
    "forward_sim": with_(*BASE, near("xw"), SIMPLE, CLS, CLASSED, POOLED, XCLASSED) + """
SELECT source, outburst_idx, row_id, CASE WHEN mjd <= peak_mjd THEN 'rise' ELSE 'decay' END AS phase,
       round(pow(greatest(xf, 0.0), coalesce(beta, 0.5)), 8) + 0.0 AS predicted,
       round(pow(greatest(xf, 1e-30), coalesce(beta, 0.5)), 8) + 0.0 AS floored
FROM xc LEFT JOIN fit ON fit.cls = xc.cls""",
    "forward_sim_tapered": with_(*BASE, phase_ctes("<="), CLS, CLASSED, FIXED, XCLASSED) + """
SELECT source, outburst_idx, row_id, CASE WHEN mjd <= peak_mjd THEN 'rise' ELSE 'decay' END AS phase,
       CASE WHEN xf > 0 THEN round(log10(pow(xf / (1.0 + exp(-(xf / greatest(xe, 1e-30) - 3.0) / 1.5)), coalesce(beta, 0.5))), 6) + 0.0 END AS log_shape
FROM xc LEFT JOIN (SELECT * FROM fa WHERE cls <> 'UNKNOWN') fa ON fa.cls = xc.cls""",
    "hardness_ratio": with_(LC, MULTI, HARD) + f"""
SELECT source, {r('mjd', 1, 'mjd')}, {r('hr_x', 6, 'hr_x')}, {r('hr_x_err', 6, 'hr_x_err')},
       {r('flux_2_20', 6, 'flux_2_20')} FROM hr""",
    "hardness_series": with_(LC, MULTI, HARD, SPANS) + f"""
SELECT h.source, outburst_idx, row_number() OVER (PARTITION BY h.source, outburst_idx ORDER BY mjd) AS point,
       {r('mjd', 1, 'mjd')}, {r('hr_x', 6, 'hr_x')}, {r('hr_x_err', 6, 'hr_x_err')}, {r('flux_2_20', 6, 'flux_2_20')},
       flux_2_20 IS NOT NULL AND count(flux_2_20) OVER (PARTITION BY h.source, outburst_idx) >= 2 AS in_track
FROM hr h JOIN spans s ON s.source = h.source AND mjd BETWEEN t_start AND t_end""",
    "observed_vs_predicted": with_(*BASE, near("xw"), SIMPLE, CLS, CLASSED, POOLED,
        "mo AS (SELECT cp.*, pow(greatest(xf, 0.0), coalesce(beta, 0.5)) AS model FROM cp LEFT JOIN fit ON fit.cls = cp.cls)") + f"""
SELECT source, outburst_idx, row_id, {r('of', 4, 'observed')},
       round(model * median(of) OVER g / nullif(median(model) OVER g, 0), 4) + 0.0 AS predicted
FROM mo WINDOW g AS (PARTITION BY source, outburst_idx)""",
    "four_panels": with_(LC, OPT, XRAY, MULTI, HARD, """p4 AS (
  SELECT source, 'xray' AS panel, mjd, xf AS val, xe AS err FROM xr
  UNION ALL SELECT source, filtercode, mjd, mag, magerr FROM opt WHERE filtercode IN ('zg', 'zr')
  UNION ALL SELECT source, 'hardness', mjd, hr_x, hr_x_err FROM hr)""") + f"""
SELECT source, panel, {r('mjd', 4, 'mjd')}, {r('val', 6, 'val')}, {r('err', 6, 'err')} FROM p4
WHERE source IN (SELECT source FROM xr) AND source IN (SELECT source FROM opt)""",
    "hardness_in_spans": with_(LC, MULTI, HARD, SPANS) + """
SELECT h.source, outburst_idx, count(*) AS n_hr, round(min(hr_x), 6) + 0.0 AS hr_min,
       round(max(hr_x), 6) + 0.0 AS hr_max, count(flux_2_20) >= 2 AS has_hid
FROM hr h JOIN spans s ON s.source = h.source AND h.mjd BETWEEN t_start AND t_end GROUP BY 1, 2""",
    "mag_to_flux": with_(OPT) + """
SELECT row_id, round(pow(10.0, -0.4 * mag) * 1e6, 6) + 0.0 AS rel_e6,
       round(pow(10.0, -0.4 * mag) * (ln(10.0) * 0.4) * magerr * 1e6, 6) + 0.0 AS rel_err_e6,
       round(3631.0 * pow(10.0, -0.4 * mag) * 1000.0, 4) + 0.0 AS mjy,
       round(3631.0 * pow(10.0, -0.4 * mag) * 1000.0 * magerr / 1.0857, 4) + 0.0 AS mjy_err FROM opt""",
}
