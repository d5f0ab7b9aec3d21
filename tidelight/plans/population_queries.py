"""Events in context: bootstrap, periods, pulse fits, populations, tiers, ingest."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DetectorConfig, FitConfig
from ..functions import coords
from ..functions import photometry as ph
from ..functions.expr import rnd
from ..operators import bootstrap, detect, periodic, population, pulsefit, report
from ..operators.skew import first_per_key, grouped_quantiles, join_small
from ..session import cut_lineage, shared_folder
from ..sources import readers, stores, text
from ..sources.tables import lightcurve, mjd_of, multiband, optical, table
from . import sqltext as q
from .series_queries import SG, SRC, S, based_series, series
from .sqltext import LC, MULTI, OPT, with_
from .time_queries import CLS, SPANS, thirds, with_class

# ------------------------------------------------------------------ events and periods


GIVEN_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
]


def outburst_report(spark, sf, cfg=DetectorConfig()):
    """The full event record: detection, false-alarm probability unless skipped, and recurrence."""
    based = cut_lineage(based_series(spark, sf, cfg))
    events = cut_lineage(detect.detect_events(based, SRC, cfg))
    rows = report.event_records(events, based, SRC, cfg)
    return rows.select(
        F.col("source").cast("string").alias("source"), F.concat(F.lit("s"), F.col("source").cast("string")).alias("file_stem"),
        F.lit("maxi").alias("instrument"), F.lit(readers.XRAY_BAND).alias("band"), *report.FIELDS,
    )


def outburst_report_no_fap(spark, sf):
    """The event record of a run that skips the resampling."""
    df = outburst_report(spark, sf, DetectorConfig(skip_fap=True)).drop("fap_empirical", "period_fap")
    return df.withColumn("source", F.col("source").cast("long"))


def null_draws(spark, sf):
    """Per resampling draw: size and level of the null curves and their false events."""
    based = cut_lineage(based_series(spark, sf))
    nulls = bootstrap.null_series(based, SRC)
    fake = detect.detect_events(nulls, [*SRC, "draw"]).groupBy("draw").agg(F.count("*").alias("n_null_events"))
    size = nulls.groupBy("draw").agg(
        F.countDistinct("source").alias("n_series"), F.count("*").alias("n_points"), rnd(F.avg("val"), 4).alias("mean_val")
    )
    return size.join(fake, "draw", "left").fillna(0, ["n_null_events"])


def lomb_scargle(spark, sf):
    p = periodic.periodogram(series(spark, sf), SRC)
    return p.select(
        "source", rnd(F.col("best_period"), 3).alias("best_period"), rnd(F.col("power"), 6).alias("power"),
        rnd(F.col("fap"), 5).alias("fap"),
    )


def _purchases(spark, sf):
    return lightcurve(spark, sf).where("band = 'purchase'")


def _starts(spark, sf):
    """First purchase of each day: a bounded list of starts per source."""
    return _purchases(spark, sf).groupBy("source", F.floor("mjd").alias("_d")).agg(F.min("mjd").alias("mjd_start")).drop("_d")


def recurrence_cv(spark, sf):
    g = periodic.spacing(_starts(spark, sf), SRC, "mjd_start")
    return g.select(
        "source", "n_events", rnd(F.col("spacing_cv"), 6).alias("spacing_cv"),
        rnd(F.col("median_gap"), 6).alias("median_gap"),
        (F.col("spacing_cv") < 0.3).alias("regular"),
    )


def candidate_periodic(spark, sf):
    gaps = cut_lineage(periodic.spacing(_starts(spark, sf), SRC, "mjd_start"))
    s = series(spark, sf).join(gaps.select("source"), "source", "left_semi")
    df = periodic.candidate_periodic(gaps, periodic.periodogram(s, SRC), SRC)
    return df.select("source", "n_events", "candidate_periodic")


def daily_tail_probability(spark, sf):
    """Share of a source's daily values at least as high as the value of each day of purchases."""
    s = series(spark, sf).select("source", "mjd", "val")
    peak = s.groupBy("source").agg(F.max("val").alias("top"), F.median("val").alias("mid"))
    df = s.join(peak, "source")
    return df.groupBy("source").agg(
        rnd(F.avg(F.when(F.col("val") >= F.col("mid"), 1.0).otherwise(0.0)), 4).alias("p_mid"),
        rnd(F.avg(F.when(F.col("val") >= 0.5 * F.col("top"), 1.0).otherwise(0.0)), 4).alias("p_half"),
    )


# ------------------------------------------------------------------------- pulse shapes


def with_level(spark, sf):
    """Daily series with the median and the 3-sigma line of its source."""
    s = series(spark, sf)
    w = Window.partitionBy("source")
    s = s.withColumn("baseline", F.median("val").over(w))
    s = s.withColumn("_d", F.abs(F.col("val") - F.col("baseline")))
    mad = F.median("_d").over(w) * 1.4826
    s = s.withColumn("_m", mad).withColumn("_sd", F.stddev_pop("val").over(w))
    spread = F.when(F.col("_m") > 0, F.col("_m")).when(F.col("_sd") > 0, F.col("_sd")).otherwise(1e-6)
    return s.withColumn("threshold", F.col("baseline") + FitConfig().sigma_thresh * spread).drop("_d", "_m", "_sd")


def _whole_spans(spark, sf):
    ends = lightcurve(spark, sf).groupBy("source").agg(F.floor(F.min("mjd")).alias("a"), F.ceil(F.max("mjd")).alias("b"))
    return ends.select(
        "source", F.lit(1).cast("long").alias("outburst_idx"), F.col("a").cast("double").alias("t_start"),
        F.col("b").cast("double").alias("t_end"),
    )


def pulse_fit(spark, sf):
    fit = pulsefit.fit_pulses(with_level(spark, sf), _whole_spans(spark, sf), SRC)
    digits = {"chi2": 3, "chi2_red": 3, "aic": 3, "t90": 3, "baseline": 5, "threshold": 5}
    return fit.select(
        "source", "outburst_idx", "span_start_mjd", "span_end_mjd", "n_points", "dof", "converged", "error",
        *[rnd(F.col(c), digits.get(c, 4)).alias(c) for c in pulsefit.FIT_FIELDS],
    )


def pulse_model(spark, sf):
    """Residuals of a fixed pulse on every daily point: chi2, reduced chi2, AIC, residual moments."""
    s = with_level(spark, sf)
    t0 = F.min("mjd").over(Window.partitionBy("source"))
    s = s.withColumn("t0", t0)
    model = F.col("baseline") + ph.norris(F.col("mjd"), F.lit(40.0), F.col("t0"), F.lit(2.0), F.lit(9.0))
    s = s.withColumn("resid", F.col("val") - model)
    g = s.groupBy("source").agg(
        F.count("*").alias("n"), F.sum(F.pow(F.col("resid") / F.col("err"), 2.0)).alias("chi2"),
        F.avg("resid").alias("resid_mean"), F.stddev_pop("resid").alias("resid_std"),
        F.max(F.abs("resid")).alias("resid_max_abs"),
    )
    dof = F.col("n") - 5
    return g.select(
        "source", dof.alias("dof"), rnd(F.col("chi2"), 4).alias("chi2"),
        rnd(F.when(dof > 0, ph.reduced_chi2(F.col("chi2"), dof)), 4).alias("chi2_red"),
        rnd(ph.aic(F.col("chi2"), F.lit(5), F.col("n")), 4).alias("aic"),
        *[rnd(F.col(c), 5).alias(c) for c in ("resid_mean", "resid_std", "resid_max_abs")],
    )


def cumulative_trapezoid_t90(spark, sf):
    """5, 95 and 90 percent fluence times of each daily curve by linear interpolation."""
    o = Window.partitionBy("source").orderBy("mjd")
    s = series(spark, sf).withColumn("f", F.greatest("val", F.lit(0.0)))
    s = s.withColumn("_t", F.lag("mjd").over(o)).withColumn("_f", F.lag("f").over(o))
    area = F.coalesce(0.5 * (F.col("f") + F.col("_f")) * (F.col("mjd") - F.col("_t")), F.lit(0.0))
    s = s.withColumn("_a", area)
    s = s.withColumn("cum", F.sum("_a").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("tot", F.sum("_a").over(Window.partitionBy("source"))).where("tot > 0")
    s = s.withColumn("q1", F.col("cum") / F.col("tot")).withColumn("q0", (F.col("cum") - F.col("_a")) / F.col("tot"))

    def cross(level):
        hit = (F.col("q0") < level) & (F.col("q1") >= level)
        at = F.col("_t") + (level - F.col("q0")) / (F.col("q1") - F.col("q0")) * (F.col("mjd") - F.col("_t"))
        return F.min(F.when(hit, at))

    g = s.groupBy("source").agg(cross(0.05).alias("t5"), cross(0.95).alias("t95"))
    return g.select(
        "source", rnd(F.col("t5"), 4).alias("t5"), rnd(F.col("t95"), 4).alias("t95"),
        rnd(F.col("t95") - F.col("t5"), 4).alias("t90"),
    )


def boxcar_smooth(spark, sf):
    """Centred moving average over 5 rows, zero outside the curve."""
    o = Window.partitionBy("source").orderBy("mjd").rowsBetween(-2, 2)
    return series(spark, sf).select(
        "source", rnd(F.col("mjd"), 4).alias("mjd"), rnd(F.sum("val").over(o) / 5.0, 6).alias("smooth")
    )


# -------------------------------------------------------------------------- populations


def _shape_rows(spark, sf):
    """One row per (source, third): duration-like parameter with its classes."""
    s = thirds(spark, sf)
    lc = lightcurve(spark, sf).select("source", "mjd", "val")
    j = join_small(lc, s, ["source"]).where("mjd BETWEEN t_start AND t_end")
    g = j.groupBy("source", "outburst_idx").agg(
        F.max_by("mjd", F.struct("val", -F.col("mjd"))).alias("pk"), F.min("mjd").alias("a"), F.max("val").alias("top")
    )
    g = with_class(g, spark, sf)
    known = lambda c: F.when(F.col(c) != "UNKNOWN", F.col(c))
    return g.select(
        "source", "outburst_idx", (F.col("pk") - F.col("a")).alias("t_rise"), F.col("top").alias("peak"),
        known("cls").alias("compact"), known("src_type").alias("system"),
    ).withColumn("combined", population.combined_label(F.col("compact"), F.col("system")))


def histogram_bins(spark, sf):
    h = population.equal_width_histogram(_shape_rows(spark, sf), "compact", "t_rise", "source")
    return h.select(
        "group_value", "bin", rnd(F.col("left_edge"), 6).alias("left_edge"), rnd(F.col("right_edge"), 6).alias("right_edge"),
        "count", "n_outbursts", "n_sources", rnd(F.col("median"), 6).alias("median"),
    )


def parameter_histogram(spark, sf):
    """All sources together, 5 to 20 bins."""
    rows = _shape_rows(spark, sf).withColumn("all", F.lit("all"))
    h = population.equal_width_histogram(rows, "all", "peak", "source", 5, 20)
    return h.select("bin", rnd(F.col("left_edge"), 6).alias("left_edge"), "count", rnd(F.col("median"), 6).alias("median"))


def class_label_sets(spark, sf):
    """By object, by system and by both in one pass of grouping sets."""
    df = _shape_rows(spark, sf).select("compact", "system", "peak", "source")
    g = df.groupingSets([[F.col("compact")], [F.col("system")], [F.col("compact"), F.col("system")]], F.col("compact"), F.col("system"))
    g = g.agg(F.grouping_id().cast("long").alias("gid"), F.count("*").alias("n"), rnd(F.max("peak"), 4).alias("max_peak"))
    return g.select("compact", "system", "gid", "n", "max_peak")


def column_audit(spark, sf):
    return population.column_audit(
        table(spark, sf, "orders").withColumn("kind", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderstatus"))), "kind", ["O", "F"]
    )


def band_filter(spark, sf):
    """Rows whose free-text band means 2-20 keV; the band stands under one of its other names."""
    li = table(spark, sf, "lineitem")
    n = F.col("l_linenumber")
    band = F.when(n == 1, "2-20 keV").when(n == 2, "2.0 - 20.0keV").when(n == 3, "4-10 keV").when(n == 4, "2-20").otherwise("10-20 keV")
    kept = population.in_band(li.select(band.alias("E_Band")))
    return kept.groupBy(F.col("E_Band").alias("band")).agg(F.count("*").alias("n"))


def observable(spark, sf):
    """Positions each survey can look at: none far south for one, no missing position for the other."""
    pos = table(spark, sf, "customer").select(
        "c_custkey", (F.col("c_custkey") % 3 * 100.0).alias("ra"), F.when(F.col("c_custkey") % 3 == 0, 0.0).otherwise(
            F.col("c_acctbal") / 120.0).alias("dec"))
    return pos.select("c_custkey", coords.above_southern_limit(F.col("dec")).alias("ztf"),
                      coords.has_position(F.col("ra"), F.col("dec")).alias("atlas"))


def distinct_bands(spark, sf):
    """Optical bands of each source over two tables, whatever each calls its filter column."""
    opt = optical(spark, sf).select("source", "filtercode", F.lit(1).alias("x"))
    other = lightcurve(spark, sf).where("band = 'signup'").select(
        "source", F.when(F.col("row_id") % 2 == 0, "o").otherwise("c").alias("F"), F.lit("y").alias("filter_id"))
    return population.count_bands([opt, other], "source")


# --------------------------------------------------------------------- tiers and ingest


def _tiers(spark, sf):
    """Gold, Silver, Bronze per source of the master list; second optical source only as fallback."""
    lc = lightcurve(spark, sf)
    m = multiband(spark, sf).where(F.col("source") % 5 != 0)
    live = lambda c: F.max(F.when(F.coalesce(F.col(c), F.lit(0.0)) != 0, 1).otherwise(0))
    maxi = m.groupBy("source").agg(
        F.count("*").alias("maxi_rows"), (live("flux_2_4") + live("flux_4_10") + live("flux_10_20")).alias("_sub"),
        live("flux_2_20").alias("_broad"),
    )
    swift = lc.where((F.col("band") == "error") & (F.col("source") % 3 == 0)).groupBy("source").agg(F.count("*").alias("swift_rows"))
    ztf_rows = optical(spark, sf).where(F.col("source") % 4 != 1).select("source", F.col("filtercode").alias("filt"), F.lit("ztf").alias("inst"))
    atlas_all = lc.where("band = 'signup'").select("source", F.when(F.col("row_id") % 2 == 0, "o").otherwise("c").alias("filt"), F.lit("atlas").alias("inst"))
    has_ztf = ztf_rows.select("source").distinct()
    atlas_rows = atlas_all.join(has_ztf, "source", "left_anti")
    opt = ztf_rows.unionByName(atlas_rows).groupBy("source", "filt", "inst").agg(F.count("*").alias("n"))
    opt = opt.groupBy("source").agg(
        F.countDistinct("filt").alias("n_optical_bands"),
        F.sum(F.when(F.col("inst") == "ztf", F.col("n")).otherwise(0)).alias("ztf_rows"),
        F.sum(F.when(F.col("inst") == "atlas", F.col("n")).otherwise(0)).alias("atlas_rows"),
    )
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("source"))
    df = base.join(maxi, "source", "left").join(swift, "source", "left").join(opt, "source", "left").fillna(0)
    bands = F.when(F.col("_sub") > 0, F.col("_sub")).otherwise(F.col("_broad")) + (F.col("swift_rows") > 0).cast("int")
    df = df.withColumn("n_xray_bands", bands.cast("long"))
    maxi_, swift_, ztf_, atlas_ = (F.col(f"{x}_rows") > 0 for x in ("maxi", "swift", "ztf", "atlas"))
    return df.select(
        F.col("source").alias("source_id"),
        population.tier(maxi_, maxi_ | swift_, ztf_ | atlas_, F.col("n_xray_bands"), F.col("n_optical_bands")).alias("tier"),
        maxi_.alias("has_maxi"), swift_.alias("has_swift"), ztf_.alias("has_ztf"), atlas_.alias("has_atlas"),
        "n_xray_bands", "n_optical_bands", "maxi_rows", "swift_rows", "ztf_rows", "atlas_rows",
    )


def tier_counts(spark, sf):
    return _tiers(spark, sf).groupBy("tier").agg(F.count("*").alias("n"))


def band_conditional_stats(spark, sf):
    """Count, median and range of magnitude per filter, and the time range, per source."""
    opt = optical(spark, sf).where(F.col("catflags").bitwiseAND(32768) == 0)
    by = opt.groupBy("source", "filtercode").agg(
        F.count("mag").alias("n"), (F.max("mag") - F.min("mag")).alias("r"), F.min("mjd").alias("a"), F.max("mjd").alias("b")
    ).join(grouped_quantiles(opt, ["source", "filtercode"], "mag", {"m": 0.5}), ["source", "filtercode"])
    out = []
    for band in ("zg", "zr", "zi"):
        hit = F.col("filtercode") == band
        out += [
            F.max(F.when(hit, F.col("n"))).alias(f"n_{band[1]}"),
            rnd(F.max(F.when(hit, F.col("m"))), 3).alias(f"med_mag_{band[1]}"),
            rnd(F.max(F.when(hit, F.col("r"))), 3).alias(f"range_mag_{band[1]}"),
        ]
    return by.groupBy("source").agg(*out, rnd(F.min("a"), 6).alias("jd_min"), rnd(F.max("b"), 6).alias("jd_max"))


def optical_bands(spark, sf):
    """Good magnitudes per filter as relative flux; bands with few rows drop out."""
    opt = optical(spark, sf).withColumnRenamed("filtercode", "band")
    df = readers.clean_optical(opt.select("source", "band", "mjd", "mag", "magerr", "catflags"), ["source", "band"], 4)
    return df.groupBy("source", "band").agg(
        F.count("*").alias("n"), rnd(F.avg("val") * 1e6, 5).alias("mean_e6"), rnd(F.max("err") * 1e6, 5).alias("max_err_e6")
    )


def key_audit(spark, sf):
    """Sources in both lists, only with a light curve, or only catalogued."""
    a = lightcurve(spark, sf).groupBy("source").agg(F.lit(1).alias("lc")).select("source", "lc", F.lit(0).alias("cat"))
    b = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("source")).agg(F.lit(1).alias("cat")).select("source", F.lit(0).alias("lc"), "cat")
    g = a.unionByName(b).groupBy("source").agg(F.max("lc").alias("lc"), F.max("cat").alias("cat"))
    status = F.when((F.col("lc") == 1) & (F.col("cat") == 1), "both").when(F.col("lc") == 1, "no_catalog").otherwise("no_light_curve")
    return g.select("source", status.alias("status"))


def existing_only(spark, sf):
    """Catalog rows whose light curve exists, with a usable balance as coordinate stand-in."""
    c = table(spark, sf, "customer").where("c_acctbal IS NOT NULL AND c_acctbal > -900")
    have = lightcurve(spark, sf).select(F.col("source").alias("c_custkey")).distinct()
    return c.join(have, "c_custkey", "left_semi").select("c_custkey", "c_name")


def pending_work(spark, sf):
    """(source, instrument) pairs not yet fetched: neither data nor a recorded miss."""
    src = table(spark, sf, "customer").select(F.col("c_custkey").alias("source"))
    want = src.withColumn("instrument", F.explode(F.array(F.lit("click"), F.lit("view"), F.lit("error"))))
    done = lightcurve(spark, sf).select("source", F.col("band").alias("instrument")).distinct()
    missed = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("source"), F.lit("error").alias("instrument")
    ).distinct()
    left = want.join(done, ["source", "instrument"], "left_anti").join(missed, ["source", "instrument"], "left_anti")
    return left.groupBy("instrument").agg(F.count("*").alias("n_pending"))


def first_available(spark, sf):
    """First candidate per customer whose fetch succeeded."""
    o = table(spark, sf, "orders").where("o_orderstatus <> 'P'")
    return first_per_key(
        o.select(F.col("o_custkey").alias("cust"), "o_orderpriority", "o_orderkey"), ["cust"], F.struct("o_orderpriority", "o_orderkey")
    )


def sentinel_clean(spark, sf):
    """Text balances coerced to numbers; sentinels and blanks dropped."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    raw = F.when(k % 17 == 0, "--").when(k % 13 == 0, "nan").otherwise(F.col("c_acctbal").cast("string"))
    val = raw.try_cast("double")
    c = c.select("c_mktsegment", F.when(~F.isnan(val), val).alias("v")).where("v > -900")
    return c.groupBy("c_mktsegment").agg(F.count("*").alias("n"), rnd(F.avg("v"), 6).alias("mean"))


def whitespace_table(spark, sf):
    """Text lines with comments and bad fields parsed, missing fluxes and early rows cut."""
    e = table(spark, sf, "events")
    k = F.col("event_id")
    flux = F.when(k % 19 == 0, "-999.0").when(k % 23 == 0, "bad").otherwise(F.col("value").cast("string"))
    line = F.concat_ws("  ", F.floor(mjd_of("ts")).cast("string"), flux, F.col("user_id").cast("string"))
    line = F.when(k % 29 == 0, F.concat(F.lit("# "), line)).when(k % 31 == 0, "").otherwise(line)
    df = text.split_lines(e.select(line.alias("value")), ["mjd", "rate", "src"])
    df = text.in_range(text.valid_scan(df, "rate"), 60315.0, None)
    return df.groupBy(F.col("mjd").cast("long").alias("day")).agg(F.count("*").alias("n"), rnd(F.sum("rate"), 4).alias("total"))


def pipe_table(spark, sf):
    """Pipe-separated rows with backslash comments."""
    e = table(spark, sf, "events")
    k = F.col("event_id")
    line = F.concat(F.col("user_id").cast("string"), F.lit(" | "), F.col("value").cast("string"), F.lit("|"), k.cast("string"))
    line = F.when(k % 10 == 0, F.concat(F.lit("\\ "), line)).otherwise(line)
    df = text.split_lines(e.select(line.alias("value")), ["src", "mag", "id"], sep=r"\s*\|\s*", comments="\\")
    return df.groupBy(F.col("src").cast("long").alias("source")).agg(F.count("*").alias("n"), rnd(F.sum("mag"), 4).alias("total"))


def chunked_union_distinct(spark, sf):
    """Closed 5-day chunks fetched one by one, stacked and de-duplicated.

    A row on a chunk border belongs to both chunks. Chunk numbers are computed, not joined.
    """
    lc = lightcurve(spark, sf).select("source", (F.floor(F.col("mjd") * 2) / 2).alias("mjd"), "band")
    start, end = lc.agg(F.floor(F.min("mjd")), F.max("mjd")).first()
    if start is None:
        start = end = 0.0
    last = max(int(-(-(end - start) // 5.0)) - 1, 0)
    pos = (F.col("mjd") - float(start)) / 5.0
    k = F.floor(pos)
    chunks = F.when((pos == k) & (k > 0), F.when(k <= last, F.array(k - 1, k)).otherwise(F.array(k - 1))).otherwise(F.array(k))
    fetched = lc.withColumn("chunk", F.explode(chunks))
    n = fetched.groupBy("source").agg(F.count("*").alias("n_fetched"))
    d = fetched.drop("chunk").dropDuplicates().groupBy("source").agg(F.count("*").alias("n_distinct"))
    return n.join(d, "source")


def chunked_union_stored(spark, sf):
    """The same chunks from curves stored by range of days, of which only the wanted files are read."""
    lc = lightcurve(spark, sf).select("source", (F.floor(F.col("mjd") * 2) / 2).alias("mjd"), "band")
    folder = shared_folder(spark)
    stores.store_by_range(lc, folder, 3.0)
    start, end = lc.agg(F.floor(F.min("mjd")), F.max("mjd")).first()
    chunks = stores.even_chunks(spark, float(start or 0.0), float(end or 0.0), 5.0)
    chunks = chunks.withColumn("end", F.col("start") + 5.0)
    fetched = stores.scan_chunks(spark, folder, chunks, 3.0, closed=True)
    n = fetched.groupBy("source").agg(F.count("*").alias("n_fetched"))
    d = fetched.select("source", "mjd", "band").dropDuplicates().groupBy("source").agg(F.count("*").alias("n_distinct"))
    return n.join(d, "source")


def stored_spans(spark, sf):
    """Spans of the first of three stored lists that has any for the source."""
    t = thirds(spark, sf).select(F.col("source").cast("string").alias("source"), "outburst_idx", "t_start", "t_end")
    a = t.where("source % 3 = 0").select("source", F.col("t_start").alias("MJD_start"), F.when(F.col("outburst_idx") > 1, F.col("t_end")).otherwise(F.col("t_start")).alias("MJD_end"))
    b = t.where("source % 2 = 0").select("source", "t_start", "t_end")
    b = b.unionByName(b)
    c = t.where("outburst_idx = 1").select("source", F.col("t_start").alias("span_start_mjd"), F.col("t_end").alias("span_end_mjd"))
    df = readers.first_stored_spans([a, b, c])
    return df.select(F.col("source").cast("long").alias("source"), rnd(F.col("t_start"), 6).alias("t_start"), rnd(F.col("t_end"), 6).alias("t_end"))


def span_upsert(spark, sf):
    t = thirds(spark, sf).select(F.col("source").cast("string").alias("source"), "t_start", "t_end")
    new = lightcurve(spark, sf).where("source % 5 = 0").groupBy(F.col("source").cast("string").alias("source")).agg(
        F.min("mjd").alias("t_start"), F.max("mjd").alias("t_end")
    )
    df = readers.upsert_spans(t, new)
    return df.select("source", rnd(F.col("t_start"), 6).alias("t_start"), rnd(F.col("t_end"), 6).alias("t_end"))


def qualified_outbursts(spark, sf):
    """Compound qualification over a catalog derived from the daily curves."""
    s = series(spark, sf).groupBy("source").agg(
        F.count("*").alias("n_points"), (F.max("mjd") - F.min("mjd")).alias("duration_days"), F.min("mjd").alias("mjd_start")
    )
    cat = s.select(
        "source", F.concat(F.lit("S"), F.col("source").cast("string")).alias("file_stem"), "n_points", "duration_days", "mjd_start",
        F.when(F.col("source") % 2 == 0, "MAXI").otherwise("ztf").alias("instrument"),
        F.when(F.col("source") % 3 == 0, "2-20 KeV").otherwise("zg").alias("band"),
    )
    df = readers.qualified_outbursts(cat, "maxi", "2-20keV", 20)
    return df.select("source", "file_stem", "n_points", rnd(F.col("duration_days"), 4).alias("duration_days"))


def mjd_datetime(spark, sf):
    """MJD to timestamp and back, with the run-date stamp."""
    lc = lightcurve(spark, sf)
    micros = F.round((F.col("mjd") - 40587.0) * 8.64e10).cast("long")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(micros / 86_400_000_000).cast("int"))
    back = F.unix_micros(F.timestamp_micros(micros)) / 8.64e10 + 40587.0
    return lc.select("row_id", F.date_format(day, "yyyyMMdd").alias("stamp"), rnd(back, 6).alias("mjd"))


def largest_table(spark, sf):
    """The largest given table with two key columns or more, as its schema tells."""
    parts = None
    for n in GIVEN_TABLES:
        df = table(spark, sf, n)
        if sum(c.endswith(("key", "_id")) for c in df.columns) >= 2:
            one = df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("name"), "n_rows")
            parts = one if parts is None else parts.unionByName(one)
    return parts.agg(F.max_by("name", F.struct("n_rows", "name")).alias("name"), F.max("n_rows").alias("n_rows"))


def top_series(spark, sf):
    """The ten sources with most raw rows."""
    return lightcurve(spark, sf).groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


QUERIES = {
    f.__name__.lstrip("_"): f
    for f in [
        outburst_report, outburst_report_no_fap, null_draws, lomb_scargle, recurrence_cv, candidate_periodic, daily_tail_probability,
        pulse_fit, pulse_model, cumulative_trapezoid_t90, boxcar_smooth, histogram_bins, parameter_histogram,
        class_label_sets, column_audit, band_filter, observable, distinct_bands, tier_counts, band_conditional_stats, optical_bands, key_audit,
        existing_only, pending_work, first_available, sentinel_clean, whitespace_table, pipe_table,
        chunked_union_distinct, chunked_union_stored, stored_spans, span_upsert, qualified_outbursts, mjd_datetime, largest_table, top_series,
    ]
}
QUERIES["tier_summary"] = _tiers

W = "1.0 / greatest(err, 1e-8) ** 2"
LS = f"""
ls0 AS (SELECT *, mjd - lag(mjd) OVER (PARTITION BY source ORDER BY mjd) AS gap FROM s),
ls1 AS (SELECT source, mjd, val, {W} / sum({W}) OVER g AS w, min(mjd) OVER g AS t0, max(mjd) OVER g - min(mjd) OVER g AS span,
          count(*) OVER g AS n, coalesce(median(gap) OVER g, 1.0) AS cad FROM ls0 WINDOW g AS (PARTITION BY source)),
ls2 AS (SELECT *, val - sum(w * val) OVER g AS y, mjd - avg(mjd) OVER g AS t2, 2.0 / span AS fmin, 1.0 / greatest(2.0, 5.0 * cad) AS fmax,
          0.2 / span AS df FROM ls1 WHERE span > 0 WINDOW g AS (PARTITION BY source)),
ls3 AS (SELECT *, unnest(range(0, CAST(round_even((fmax - fmin) / df, 0) AS BIGINT) + 1)) AS i,
          CAST(round_even((fmax - fmin) / df, 0) AS BIGINT) AS steps FROM ls2 WHERE fmax > fmin),
ls4 AS (SELECT *, fmin + df * i AS f, cos(2 * pi() * (fmin + df * i) * (mjd - t0)) AS c, sin(2 * pi() * (fmin + df * i) * (mjd - t0)) AS s FROM ls3),
ls5 AS (SELECT source, i, any_value(f) AS f, any_value(steps) AS steps, any_value(n) AS n, any_value(span) AS span,
          sum(w * c) AS c, sum(w * s) AS s, sum(w * y * c) AS yc, sum(w * y * s) AS ys, sum(w * c * c) AS cc, sum(w * c * s) AS cs,
          sum(w * y * y) AS yy, sum(w * t2 * t2) - sum(w * t2) ** 2 AS vt FROM ls4 GROUP BY source, i),
ls6 AS (SELECT *, ((1 - cc - s * s) * yc * yc + (cc - c * c) * ys * ys - 2 * (cs - c * s) * yc * ys)
          / (yy * ((cc - c * c) * (1 - cc - s * s) - (cs - c * s) ** 2)) AS power FROM ls5),
ls7 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY power DESC, i) AS rn FROM ls6),
ls8 AS (SELECT *, CASE WHEN steps > 0 THEN i / steps ELSE 0.5 END AS frac,
          (round_even(12.5 * n - 0.5, 0) + 0.5) / (5.0 * span) * sqrt(4 * pi() * vt) AS wd FROM ls7 WHERE rn = 1),
ls9 AS (SELECT *, pow(1 - power, (n - 3) / 2.0) AS fs,
          sqrt(2.0 / (n - 1)) * exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) * wd * pow(1 - power, 0.5 * (n - 4)) * sqrt(0.5 * (n - 1) * power) AS tau FROM ls8),
per AS (SELECT source, power, CASE WHEN frac > 0.02 AND frac < 0.98 THEN 1.0 / f END AS best_period,
          CASE WHEN frac > 0.02 AND frac < 0.98 THEN fs + (1 - fs) * (1 - exp(-tau)) END AS fap FROM ls9)"""
GAPS = """
st AS (SELECT source, min(mjd) AS t FROM lc WHERE band = 'purchase' GROUP BY source, floor(mjd)),
gp AS (SELECT source, t - lag(t) OVER (PARTITION BY source ORDER BY t) AS gap FROM st),
sp AS (SELECT source, count(*) AS n_events, CASE WHEN avg(gap) > 0 AND count(gap) > 1 THEN stddev_pop(gap) / avg(gap) END AS cv,
         median(gap) AS mg FROM gp GROUP BY source HAVING count(*) >= 5)"""
LEVEL = """
lv0 AS (SELECT *, median(val) OVER (PARTITION BY source) AS baseline, min(mjd) OVER (PARTITION BY source) AS t0 FROM s)"""
SHAPE = """
sh AS (SELECT l.source, outburst_idx, arg_max(mjd, val ORDER BY mjd) - min(mjd) AS t_rise, max(val) AS peak
       FROM lc l JOIN spans p ON p.source = l.source AND l.mjd BETWEEN t_start AND t_end GROUP BY 1, 2),
sc AS (SELECT sh.*, nullif(cls.cls, 'UNKNOWN') AS compact, nullif(cls.kind, 'UNKNOWN') AS system FROM sh LEFT JOIN cls ON cls.ckey = 'SRC' || sh.source)"""


def hist(group: str, value: str, low: int, high: int) -> str:
    return f"""
hv AS (SELECT {group} AS grp, {value} AS v, source FROM sc WHERE {group} IS NOT NULL),
hs AS (SELECT grp, count(*) AS n, min(v) AS lo, max(v) AS hi, median(v) AS med, count(DISTINCT source) AS ns,
         least(greatest(count(*) // 2, {low}), {high}) AS nb FROM hv GROUP BY grp),
hf AS (SELECT *, unnest(range(0, nb)) AS bin, (hi - lo) / nb AS wd FROM hs),
hc AS (SELECT hv.grp, least(CAST(floor((v - lo) / ((hi - lo) / nb)) AS BIGINT), nb - 1) AS bin, count(*) AS cnt FROM hv JOIN hs USING (grp) GROUP BY 1, 2)"""


TIER = """
mx AS (SELECT source, count(*) AS mr, max((coalesce(flux_2_4, 0) <> 0)::INT) + max((coalesce(flux_4_10, 0) <> 0)::INT)
          + max((coalesce(flux_10_20, 0) <> 0)::INT) AS sub, max((coalesce(flux_2_20, 0) <> 0)::INT) AS broad
       FROM mb WHERE source % 5 <> 0 GROUP BY source),
sw AS (SELECT source, count(*) AS sr FROM lc WHERE band = 'error' AND source % 3 = 0 GROUP BY source),
zt AS (SELECT source, filtercode AS f FROM opt WHERE source % 4 <> 1),
atl AS (SELECT source, CASE WHEN row_id % 2 = 0 THEN 'o' ELSE 'c' END AS f FROM lc WHERE band = 'signup' AND source NOT IN (SELECT source FROM zt)),
oz AS (SELECT source, count(DISTINCT f) AS nb, count(*) FILTER (WHERE i = 1) AS zr, count(*) FILTER (WHERE i = 2) AS ar
       FROM (SELECT *, 1 AS i FROM zt UNION ALL SELECT *, 2 FROM atl) GROUP BY source),
tj AS (SELECT c_custkey AS source_id, coalesce(mr, 0) AS maxi_rows, coalesce(sr, 0) AS swift_rows, coalesce(zr, 0) AS ztf_rows, coalesce(ar, 0) AS atlas_rows,
         CAST(CASE WHEN coalesce(sub, 0) > 0 THEN sub ELSE coalesce(broad, 0) END + (coalesce(sr, 0) > 0)::INT AS BIGINT) AS n_xray_bands,
         coalesce(nb, 0) AS n_optical_bands
       FROM customer LEFT JOIN mx ON mx.source = c_custkey LEFT JOIN sw ON sw.source = c_custkey LEFT JOIN oz ON oz.source = c_custkey),
tiers AS (SELECT source_id, CASE WHEN maxi_rows > 0 AND ztf_rows + atlas_rows > 0 AND n_xray_bands >= 2 AND n_optical_bands >= 2 THEN 'Gold'
           WHEN maxi_rows + swift_rows > 0 AND ztf_rows + atlas_rows > 0 THEN 'Silver' ELSE 'Bronze' END AS tier,
         maxi_rows > 0 AS has_maxi, swift_rows > 0 AS has_swift, ztf_rows > 0 AS has_ztf, atlas_rows > 0 AS has_atlas,
         n_xray_bands, n_optical_bands, maxi_rows, swift_rows, ztf_rows, atlas_rows FROM tj)"""

EVENT_GAPS = GAPS.replace(GAPS[GAPS.index("st AS"):GAPS.index("gp AS")], "st AS (SELECT source, mjd_start AS t FROM e),\n")

ORACLE = {
    "outburst_report_no_fap": with_(LC, S, SG, q.based("b", "sg", "source"), q.events_of("e", "b", "source"), LS, EVENT_GAPS) + """
SELECT e.source, 's' || e.source AS file_stem, 'maxi' AS instrument, '2-20keV' AS band, outburst_id, round(mjd_start, 4) + 0.0 AS mjd_start,
  round(mjd_end, 4) + 0.0 AS mjd_end, round(duration_days, 4) + 0.0 AS duration_days, n_points, round(peak_value, 6) + 0.0 AS peak_value,
  round(peak_mjd, 4) + 0.0 AS peak_mjd, round(baseline_value, 6) + 0.0 AS baseline_value,
  round(significance_sigma, 2) + 0.0 AS significance_sigma,
  coalesce(coalesce(cv < 0.3, false) OR coalesce(fap < 0.05 AND abs(best_period - mg) / mg < 0.25, false), false) AS candidate_periodic,
  CASE WHEN sp.source IS NOT NULL THEN nullif(round(best_period, 3) + 0.0, 0) END AS best_period_days,
  nullif(round(cv, 3) + 0.0, 0) AS spacing_cv
FROM e LEFT JOIN sp USING (source) LEFT JOIN per ON per.source = sp.source""",
    "lomb_scargle": with_(LC, S, LS) + """
SELECT source, round(best_period, 3) + 0.0 AS best_period, round(power, 6) + 0.0 AS power, round(fap, 5) + 0.0 AS fap FROM per""",
    "recurrence_cv": with_(LC, GAPS) + """
SELECT source, n_events, round(cv, 6) + 0.0 AS spacing_cv, round(mg, 6) + 0.0 AS median_gap, cv < 0.3 AS regular FROM sp""",
    "candidate_periodic": with_(LC, S, LS, GAPS) + """
SELECT sp.source, n_events, coalesce(cv < 0.3, false) OR coalesce(fap < 0.05 AND abs(best_period - mg) / mg < 0.25, false) AS candidate_periodic
FROM sp LEFT JOIN per USING (source)""",
    "daily_tail_probability": with_(LC, S, "p AS (SELECT *, max(val) OVER (PARTITION BY source) AS top, median(val) OVER (PARTITION BY source) AS mid FROM s)") + """
SELECT source, round(avg((val >= mid)::INT), 4) + 0.0 AS p_mid, round(avg((val >= 0.5 * top)::INT), 4) + 0.0 AS p_half FROM p GROUP BY source""",
    "pulse_model": with_(
        LC, S, LEVEL,
        "rs AS (SELECT *, val - (baseline + CASE WHEN mjd > t0 THEN 40.0 * exp(-2.0 / (mjd - t0) - (mjd - t0) / 9.0) ELSE 0.0 END) AS resid FROM lv0)",
        "ag AS (SELECT source, count(*) AS n, sum((resid / err) ** 2) AS chi2, avg(resid) AS rm, stddev_pop(resid) AS rsd, max(abs(resid)) AS rx FROM rs GROUP BY source)",
    ) + """SELECT source, n - 5 AS dof, round(chi2, 4) + 0.0 AS chi2, round(CASE WHEN n > 5 THEN chi2 / (n - 5) END, 4) + 0.0 AS chi2_red,
  round(chi2 + 10 + 60.0 / greatest(n - 6, 1), 4) + 0.0 AS aic, round(rm, 5) + 0.0 AS resid_mean, round(rsd, 5) + 0.0 AS resid_std,
  round(rx, 5) + 0.0 AS resid_max_abs FROM ag""",
    "cumulative_trapezoid_t90": with_(
        LC, S,
        "c0 AS (SELECT source, mjd, greatest(val, 0.0) AS f, lag(mjd) OVER g AS pt, lag(greatest(val, 0.0)) OVER g AS pf FROM s WINDOW g AS (PARTITION BY source ORDER BY mjd))",
        "c1 AS (SELECT *, coalesce(0.5 * (f + pf) * (mjd - pt), 0.0) AS a FROM c0)",
        "c2 AS (SELECT *, sum(a) OVER (PARTITION BY source ORDER BY mjd) AS cum, sum(a) OVER (PARTITION BY source) AS tot FROM c1)",
        "c3 AS (SELECT *, cum / tot AS q1, (cum - a) / tot AS q0 FROM c2 WHERE tot > 0)",
        """c4 AS (SELECT source, min(pt + (0.05 - q0) / (q1 - q0) * (mjd - pt)) FILTER (WHERE q0 < 0.05 AND q1 >= 0.05) AS t5,
             min(pt + (0.95 - q0) / (q1 - q0) * (mjd - pt)) FILTER (WHERE q0 < 0.95 AND q1 >= 0.95) AS t95 FROM c3 GROUP BY source)""",
    ) + "SELECT source, round(t5, 4) + 0.0 AS t5, round(t95, 4) + 0.0 AS t95, round(t95 - t5, 4) + 0.0 AS t90 FROM c4",
    "boxcar_smooth": with_(LC, S) + """
SELECT source, round(mjd, 4) + 0.0 AS mjd, round(sum(val) OVER (PARTITION BY source ORDER BY mjd ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0, 6) + 0.0 AS smooth FROM s""",
    "histogram_bins": with_(LC, SPANS, CLS, SHAPE, hist("compact", "t_rise", 4, 15)) + """
SELECT hf.grp AS group_value, CAST(hf.bin AS BIGINT) AS bin, round(lo + wd * hf.bin, 6) + 0.0 AS left_edge, round(lo + wd * (hf.bin + 1), 6) + 0.0 AS right_edge,
  coalesce(cnt, 0) AS count, n AS n_outbursts, ns AS n_sources, round(med, 6) + 0.0 AS median FROM hf LEFT JOIN hc ON hc.grp = hf.grp AND hc.bin = hf.bin""",
    "parameter_histogram": with_(LC, SPANS, CLS, SHAPE, hist("'all'", "peak", 5, 20)) + """
SELECT CAST(hf.bin AS BIGINT) AS bin, round(lo + wd * hf.bin, 6) + 0.0 AS left_edge, coalesce(cnt, 0) AS count, round(med, 6) + 0.0 AS median
FROM hf LEFT JOIN hc ON hc.grp = hf.grp AND hc.bin = hf.bin""",
    "class_label_sets": with_(LC, SPANS, CLS, SHAPE) + """
SELECT compact, system, CAST(grouping(compact, system) AS BIGINT) AS gid, count(*) AS n, round(max(peak), 4) + 0.0 AS max_peak
FROM sc GROUP BY GROUPING SETS ((compact), (system), (compact, system))""",
    "column_audit": """
SELECT CASE WHEN k IS NULL THEN 'missing' ELSE 'unrecognized' END AS problem, coalesce(k, '') AS value, count(*) AS n_rows
FROM (SELECT CASE WHEN o_orderkey % 9 <> 0 THEN o_orderstatus END AS k FROM orders) WHERE k IS NULL OR k NOT IN ('O', 'F') GROUP BY 1, 2""",
    "band_filter": """
SELECT CASE l_linenumber WHEN 1 THEN '2-20 keV' WHEN 2 THEN '2.0 - 20.0keV' ELSE '2-20' END AS band, count(*) AS n FROM lineitem WHERE l_linenumber IN (1, 2, 4) GROUP BY 1""",
    "tier_summary": with_(LC, OPT, MULTI, TIER) + "SELECT * FROM tiers",
    "tier_counts": with_(LC, OPT, MULTI, TIER) + "SELECT tier, count(*) AS n FROM tiers GROUP BY tier",
    "band_conditional_stats": with_(OPT, "o AS (SELECT * FROM opt WHERE catflags & 32768 = 0)") + "SELECT source, "
    + ", ".join(
        f"nullif(count(mag) FILTER (WHERE filtercode = 'z{b}'), 0) AS n_{b}, round(median(mag) FILTER (WHERE filtercode = 'z{b}'), 3) + 0.0 AS med_mag_{b}, "
        f"round(max(mag) FILTER (WHERE filtercode = 'z{b}') - min(mag) FILTER (WHERE filtercode = 'z{b}'), 3) + 0.0 AS range_mag_{b}"
        for b in "gri"
    ) + ", round(min(mjd), 6) + 0.0 AS jd_min, round(max(mjd), 6) + 0.0 AS jd_max FROM o GROUP BY source",
    "optical_bands": with_(
        OPT,
        """f AS (SELECT source, filtercode AS band, mjd, pow(10.0, -0.4 * mag) AS v, pow(10.0, -0.4 * mag) * (ln(10.0) * 0.4) * magerr AS e,
             count(*) OVER (PARTITION BY source, filtercode) AS c FROM opt WHERE catflags = 0 AND magerr > 0)""",
        """d AS (SELECT source, band, mjd, sum(v / greatest(e, 1e-8) ** 2) / sum(1.0 / greatest(e, 1e-8) ** 2) AS v,
             sqrt(1.0 / sum(1.0 / greatest(e, 1e-8) ** 2)) AS e FROM f WHERE c >= 4 GROUP BY 1, 2, 3)""",
    ) + "SELECT source, band, count(*) AS n, round(avg(v) * 1e6, 5) + 0.0 AS mean_e6, round(max(e) * 1e6, 5) + 0.0 AS max_err_e6 FROM d GROUP BY 1, 2",
    "key_audit": """
SELECT coalesce(a.s, b.s) AS source, CASE WHEN a.s IS NULL THEN 'no_light_curve' WHEN b.s IS NULL THEN 'no_catalog' ELSE 'both' END AS status
FROM (SELECT DISTINCT user_id AS s FROM events) a FULL JOIN (SELECT DISTINCT o_custkey AS s FROM orders) b ON a.s = b.s""",
    "existing_only": "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > -900 AND c_custkey IN (SELECT user_id FROM events)",
    "pending_work": """
SELECT i AS instrument, count(*) AS n_pending FROM customer, (SELECT unnest(['click', 'view', 'error']) AS i)
WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = i)
  AND NOT (i = 'error' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')) GROUP BY i""",
    "first_available": """
SELECT DISTINCT ON (o_custkey) o_custkey AS cust, o_orderpriority, o_orderkey FROM orders WHERE o_orderstatus <> 'P'
ORDER BY o_custkey, o_orderpriority, o_orderkey""",
    "sentinel_clean": """
SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) + 0.0 AS mean FROM customer
WHERE c_custkey % 17 <> 0 AND c_custkey % 13 <> 0 AND c_acctbal > -900 GROUP BY 1""",
    "whitespace_table": with_(LC) + """
SELECT CAST(floor(mjd) AS BIGINT) AS day, count(*) AS n, round(sum(val), 4) + 0.0 AS total FROM lc
WHERE row_id % 19 <> 0 AND row_id % 23 <> 0 AND row_id % 29 <> 0 AND row_id % 31 <> 0 AND floor(mjd) >= 60315 GROUP BY 1""",
    "pipe_table": "SELECT user_id AS source, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events WHERE event_id % 10 <> 0 GROUP BY 1",
    "observable": """
SELECT c_custkey, dec >= -30.0 AS ztf, NOT (ra = 0.0 AND dec = 0.0) AS atlas FROM (
  SELECT c_custkey, c_custkey % 3 * 100.0 AS ra, CASE WHEN c_custkey % 3 = 0 THEN 0.0 ELSE c_acctbal / 120.0 END AS dec FROM customer)""",
    "distinct_bands": with_(LC, OPT) + """
SELECT source, count(DISTINCT f) AS n_bands FROM (SELECT source, filtercode AS f FROM opt
  UNION ALL SELECT source, CASE WHEN row_id % 2 = 0 THEN 'o' ELSE 'c' END FROM lc WHERE band = 'signup') GROUP BY source""",
    "chunked_union_distinct": with_(
        LC, "h AS (SELECT source, floor(mjd * 2) / 2 AS mjd, band FROM lc)",
        "lim AS (SELECT floor(min(mjd)) AS a, max(mjd) AS z FROM h)",
        "ch AS (SELECT a + 5 * k AS s FROM (SELECT a, unnest(range(0, greatest(CAST(ceil((z - a) / 5) AS BIGINT), 1))) AS k FROM lim))",
        "c AS (SELECT h.* FROM h JOIN ch ON mjd BETWEEN s AND s + 5)",
        "d AS (SELECT DISTINCT * FROM c)",
    ) + "SELECT source, n AS n_fetched, m AS n_distinct FROM (SELECT source, count(*) AS n FROM c GROUP BY 1) JOIN (SELECT source, count(*) AS m FROM d GROUP BY 1) USING (source)",
    "stored_spans": with_(
        LC, SPANS,
        """u AS (SELECT source, 0 AS r, t_start, t_end FROM spans WHERE source % 3 = 0 AND outburst_idx > 1
           UNION ALL SELECT source, 1, t_start, t_end FROM spans WHERE source % 2 = 0
           UNION ALL SELECT source, 2, t_start, t_end FROM spans WHERE outburst_idx = 1)""",
    ) + """SELECT source, round(t_start, 6) + 0.0 AS t_start, round(t_end, 6) + 0.0 AS t_end FROM u
  WHERE t_end > t_start AND r = (SELECT min(r) FROM u v WHERE v.source = u.source AND v.t_end > v.t_start)""",
    "span_upsert": with_(LC, SPANS) + """
SELECT CAST(source AS VARCHAR) AS source, round(t_start, 6) + 0.0 AS t_start, round(t_end, 6) + 0.0 AS t_end FROM spans WHERE source % 5 <> 0
UNION ALL SELECT CAST(source AS VARCHAR), round(a, 6) + 0.0, round(b, 6) + 0.0 FROM ends WHERE source % 5 = 0""",
    "qualified_outbursts": with_(LC, S) + """
SELECT source, 'S' || source AS file_stem, count(*) AS n_points, round(max(mjd) - min(mjd), 4) + 0.0 AS duration_days FROM s
WHERE source % 6 = 0 GROUP BY source HAVING count(*) >= 20 AND max(mjd) - min(mjd) >= 0.5""",
    "mjd_datetime": with_(LC) + """
SELECT row_id, strftime(ts, '%Y%m%d') AS stamp, round(mjd, 6) + 0.0 AS mjd FROM lc JOIN events ON event_id = row_id""",
    "largest_table": "SELECT arg_max(name, n_rows) AS name, max(n_rows) AS n_rows FROM ("
    + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n_rows FROM {n}" for n in GIVEN_TABLES)
    + """) WHERE name IN (SELECT table_name FROM information_schema.columns WHERE regexp_matches(column_name, '(key|_id)$')
  GROUP BY table_name HAVING count(*) >= 2)""",
    "top_series": "SELECT user_id AS source, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, source LIMIT 10",
}
ORACLE["chunked_union_stored"] = ORACLE["chunked_union_distinct"]
