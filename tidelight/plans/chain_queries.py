"""The operators in a row: detected events, qualified spans, then fits, hardness, pairs, slopes
and predictions inside those spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import FitConfig
from ..functions import photometry as ph
from ..functions.expr import rnd
from ..operators import pulsefit, slope, timejoin
from ..operators.skew import join_small
from ..session import cut_lineage
from ..sources import readers
from ..sources.tables import lightcurve
from . import sqltext as q
from .population_queries import with_level
from .series_queries import SG, SRC, S, events
from .sqltext import LC, MULTI, OPT, XRAY, r, with_
from .time_queries import (
    CLASSED, CLS, CROP, HARD, OF, POOLED, SIMPLE, SPAN, THREE, XCLASSED, XF, hardness_points, near, simple_pairs, span_points,
    with_beta, with_class,
)

MIN_POINTS = 4


def spans_of_events(spark, sf):
    """Spans and ids of the detected events that are worth a fit, as the catalog reader gives them."""
    found = events(spark, sf).withColumns({
        "file_stem": F.concat(F.lit("s"), F.col("source").cast("string")), "instrument": F.lit("maxi"), "band": F.lit(readers.XRAY_BAND)})
    good = readers.qualified_outbursts(found, "MAXI", "2-20 keV", MIN_POINTS, FitConfig().min_duration_days)
    return cut_lineage(good.select(
        "source", F.col("outburst_id").alias("outburst_idx"), F.col("mjd_start").alias("t_start"), F.col("mjd_end").alias("t_end")))


def event_spans(spark, sf):
    return spans_of_events(spark, sf).select(
        *SPAN, rnd(F.col("t_start"), 4).alias("t_start"), rnd(F.col("t_end"), 4).alias("t_end"))


def event_hardness(spark, sf):
    """Hardness inside the detected events."""
    df = timejoin.crop_to_spans(hardness_points(spark, sf), spans_of_events(spark, sf), ["source"])
    return df.groupBy(*SPAN).agg(
        F.count("*").alias("n_hr"), rnd(F.min("hr_x"), 6).alias("hr_min"), rnd(F.max("hr_x"), 6).alias("hr_max"))


def event_pairs(spark, sf):
    """X-ray and optical points paired in time inside the detected events."""
    pairs = simple_pairs(spark, sf, spans_of_events(spark, sf))
    return pairs.select(*SPAN, "row_id", "r_row_id", rnd(F.col("dt"), 6).alias("dt"), rnd(F.col("of"), 4).alias("of"))


def _slopes(spark, sf, spans):
    near_ = with_class(simple_pairs(spark, sf, spans), spark, sf)
    return slope.pooled_slope(near_.select("cls", F.col("r_xf").alias("xf"), "of", "oe"))


def event_slopes(spark, sf):
    """Slope of each class from the pairs inside the detected events."""
    fit = _slopes(spark, sf, spans_of_events(spark, sf))
    return fit.select("compact_object", rnd(F.col("beta"), 6).alias("beta"), rnd(F.col("beta_err"), 6).alias("beta_err"), "n_pairs")


def event_simulation(spark, sf):
    """Predicted flux, and the flux it comes from, of the points of detected events with the fitted slopes."""
    spans = spans_of_events(spark, sf)
    df = with_beta(span_points(spark, sf, spans), _slopes(spark, sf, spans))
    return df.select(
        *SPAN, "row_id", timejoin.phase(F.col("mjd"), F.col("peak_mjd")).alias("phase"), rnd(F.col("xf") * 1e9, 6).alias("xf_nano"),
        rnd(F.col("xe") * 1e9, 6).alias("xe_nano"), rnd(ph.reprocessed(F.col("xf"), F.col("beta")), 8).alias("predicted"),
    )


def _fits(spark, sf):
    """Spans padded to hold enough points, with 1-based ordinals, and their fits."""
    ends = lightcurve(spark, sf).groupBy("source").agg(F.min("mjd").alias("a"), F.max("mjd").alias("b"))
    spans = join_small(spans_of_events(spark, sf), ends, ["source"]).select(
        *SPAN, F.greatest(F.col("t_start") - 5.0, "a").alias("t_start"), F.least(F.col("t_end") + 5.0, "b").alias("t_end"))
    return pulsefit.fit_pulses(with_level(spark, sf), spans, SRC)


def event_fit(spark, sf):
    """Pulse fits of the detected events."""
    digits = {"chi2": 3, "chi2_red": 3, "aic": 3, "t90": 3, "baseline": 5, "threshold": 5}
    return _fits(spark, sf).select(
        *SPAN, rnd(F.col("span_start_mjd"), 4).alias("span_start_mjd"), rnd(F.col("span_end_mjd"), 4).alias("span_end_mjd"),
        "n_points", "dof", "converged", "error", *[rnd(F.col(c), digits.get(c, 4)).alias(c) for c in pulsefit.FIT_FIELDS],
    )


def event_fit_inputs(spark, sf):
    """What the fits of the detected events start from."""
    return _fits(spark, sf).select(
        *SPAN, "n_points", "dof", rnd(F.col("span_start_mjd"), 4).alias("span_start_mjd"),
        rnd(F.col("baseline"), 5).alias("baseline"), rnd(F.col("threshold"), 5).alias("threshold"))


def event_residuals(spark, sf):
    """Residuals of the fits in units of the errors, one row for each point."""
    df = _fits(spark, sf).select(*SPAN, F.posexplode("resid_sigma").alias("point", "sigma"))
    return df.select(*SPAN, (F.col("point") + 1).cast("long").alias("point"), rnd(F.col("sigma"), 3).alias("sigma"))


def event_curves(spark, sf):
    """The fitted pulses of the detected events at 200 even times of their span."""
    df = pulsefit.fitted_curves(_fits(spark, sf), SRC, 200)
    return df.select(*SPAN, "point", rnd(F.col("mjd"), 4).alias("mjd"), rnd(F.col("model"), 4).alias("model"), "in_t90", "is_peak")


QUERIES = {
    "event_spans": event_spans,
    "event_hardness": event_hardness,
    "event_pairs": event_pairs,
    "event_slopes": event_slopes,
    "event_simulation": event_simulation,
    "event_fit": event_fit,
    "event_fit_inputs": event_fit_inputs,
    "event_residuals": event_residuals,
    "event_curves": event_curves,
}

FOUND = [S, SG, q.based("b", "sg", "source"), q.events_of("e", "b", "source"), f"""
spans AS (SELECT source, outburst_id AS outburst_idx, mjd_start AS t_start, mjd_end AS t_end FROM e
          WHERE n_points >= {MIN_POINTS} AND mjd_end - mjd_start >= 0.5)"""]
CHAIN = [LC, OPT, XRAY, *FOUND, XF, OF, CROP]
FIT_IN = """
ends AS (SELECT source, min(mjd) AS a, max(mjd) AS z FROM lc GROUP BY source),
wide AS (SELECT source, outburst_idx, greatest(t_start - 5.0, a) AS t0, least(t_end + 5.0, z) AS t1 FROM spans JOIN ends USING (source)),
med AS (SELECT source, median(val) AS m, stddev_pop(val) AS sd FROM s GROUP BY source),
mad AS (SELECT source, any_value(m) AS m, any_value(sd) AS sd, median(abs(val - m)) * 1.4826 AS d FROM s JOIN med USING (source) GROUP BY source),
lev AS (SELECT source, m AS baseline, m + 3.0 * CASE WHEN d > 0 THEN d WHEN sd > 0 THEN sd ELSE 1e-6 END AS threshold FROM mad)"""

ORACLE = {
    "event_spans": with_(LC, *FOUND) + f"SELECT source, outburst_idx, {r('t_start', 4, 't_start')}, {r('t_end', 4, 't_end')} FROM spans",
    "event_hardness": with_(LC, MULTI, HARD, *FOUND) + """
SELECT h.source, outburst_idx, count(*) AS n_hr, round(min(hr_x), 6) + 0.0 AS hr_min, round(max(hr_x), 6) + 0.0 AS hr_max
FROM hr h JOIN spans ON spans.source = h.source AND mjd BETWEEN t_start AND t_end GROUP BY 1, 2""",
    "event_pairs": with_(*CHAIN, near("xw"), SIMPLE) + f"""
SELECT source, outburst_idx, row_id, r_row_id, {r('dt', 6, 'dt')}, {r('of', 4, 'of')} FROM pairs""",
    "event_slopes": with_(*CHAIN, near("xw"), SIMPLE, CLS, CLASSED, POOLED, THREE) + """
SELECT c AS compact_object, round(coalesce(beta, 0.5), 6) + 0.0 AS beta, round(beta_err, 6) + 0.0 AS beta_err,
       coalesce(n, 0) AS n_pairs FROM three LEFT JOIN fit ON fit.cls = c""",
    "event_simulation": with_(*CHAIN, near("xw"), SIMPLE, CLS, CLASSED, POOLED, XCLASSED) + f"""
SELECT source, outburst_idx, row_id, CASE WHEN mjd <= peak_mjd THEN 'rise' ELSE 'decay' END AS phase,
       {r('xf * 1e9', 6, 'xf_nano')}, {r('xe * 1e9', 6, 'xe_nano')},
       round(pow(greatest(xf, 0.0), coalesce(beta, 0.5)), 8) + 0.0 AS predicted
FROM xc LEFT JOIN fit ON fit.cls = xc.cls""",
    "event_fit_inputs": with_(LC, *FOUND, FIT_IN) + f"""
SELECT source, outburst_idx, count(*) AS n_points, count(*) - 5 AS dof, round(any_value(t0), 4) + 0.0 AS span_start_mjd,
       round(any_value(baseline), 5) + 0.0 AS baseline, round(any_value(threshold), 5) + 0.0 AS threshold
FROM wide JOIN s USING (source) JOIN lev USING (source) WHERE mjd BETWEEN t0 AND t1
GROUP BY source, outburst_idx HAVING count(*) >= {FitConfig().min_points}""",
}
