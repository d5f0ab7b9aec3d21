"""Small rules: band names, filter columns, position guards, catalogs, sinks, the log."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidelight.functions import coords
from tidelight.operators import population
from tidelight.plans import chain_queries, population_queries
from tidelight.schema import FLUX_NAMES, MISSION_NAMES
from tidelight.sources import readers, sinks

SF = "/root/testdata/sf0.001"


def test_band_names(spark):
    rows = spark.createDataFrame([("2-20 keV",), ("2.0 -20.0keV",), ("12-20",), ("2-2",), (None,)], "x string")
    for name in ("band", "energy_band", "E_BAND", "PassBand"):
        assert population.in_band(rows.withColumnRenamed("x", name)).count() == 3
    assert population.in_band(rows).count() == 5


def test_count_bands(spark):
    a = spark.createDataFrame([("s", "zg"), ("s", "zr"), ("t", None)], "k string, Filter string")
    b = spark.createDataFrame([("s", "zg", 1), ("t", "o", 2)], "k string, f string, other int")
    got = population.count_bands([a, b, a.drop("Filter")], "k").collect()
    assert {r.k: r.n_bands for r in got} == {"s": 2, "t": 1}


def test_names():
    assert population.named_like(["xmmssc", "CSCv2", "ztf", "SwiftMaster"], MISSION_NAMES) == ["xmmssc", "CSCv2", "SwiftMaster"]
    assert population.named_like(["EP_FLUX", "Rate_1", "ra"], FLUX_NAMES) == ["EP_FLUX", "Rate_1"]


def test_position_guards(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (5.0, -30.0), (5.0, -30.1), (None, 1.0)], "ra double, dec double")
    got = df.select(coords.above_southern_limit(F.col("dec")), coords.has_position(F.col("ra"), F.col("dec"))).collect()
    assert [tuple(r) for r in got] == [(True, False), (True, True), (True, True), (False, True), (True, True)]
    now = spark.range(1).select(coords.mjd_now().alias("m")).first().m
    want = (datetime.datetime.now(datetime.UTC) - datetime.datetime(1858, 11, 17, tzinfo=datetime.UTC)).total_seconds() / 86400
    assert now == pytest.approx(want, abs=0.01)


def test_catalogs_of_several_layouts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Name,RAJ2000,DEJ2000,Type\nA,04 19 42.0,-00 30 00,BH\nB,--,1,NS\n")
    (tmp_path / "b.csv").write_text("dec,ra,Name\n12.5,64.925,C\n")
    (tmp_path / "c.csv").write_text("x,y\n1,2\n")
    got = {r.Name: (round(r.ra, 6), r.dec, r.Type) for r in readers.load_catalog(spark, str(tmp_path)).collect()}
    assert got == {"A": (64.925, -0.5, "BH"), "C": (64.925, 12.5, None)}


def test_result_files(spark, tmp_path):
    report = population_queries.outburst_report(spark, SF)
    sinks.write_outbursts(report, str(tmp_path / "o"))
    back = spark.read.option("header", True).csv(str(tmp_path / "o"))
    assert back.columns == sinks.OUTBURST_COLUMNS and back.count() == report.count()
    fit = chain_queries.event_fit(spark, SF.replace("0.001", "0.01")).withColumn("source", F.col("source").cast("string"))
    sinks.write_log(fit.withColumn("band", F.lit("2-20keV")), str(tmp_path / "l"))
    lines = spark.read.text(str(tmp_path / "l"))
    assert lines.count() == fit.count() > 0 and "aic=" in lines.first().value


def test_fit_errors_are_rows(spark):
    from tidelight.operators import pulsefit

    rows = [("a", 58000.0 + i, 1.0 + i % 3, 0.1, 1.0, 2.0) for i in range(20)] + [("b", 58000.0, 1.0, 0.1, 1.0, 2.0)] * 12
    s = spark.createDataFrame(rows, "source string, mjd double, val double, err double, baseline double, threshold double")
    spans = spark.createDataFrame([(k, 1, 58000.0, 58020.0) for k in "ab"], "source string, outburst_idx long, t_start double, t_end double")
    got = {r.source: r for r in pulsefit.fit_pulses(s, spans, ["source"]).collect()}
    assert set(got) == {"a", "b"} and got["a"].converged is not None and len(got["a"].resid_sigma) == 20
    assert all((r.error is None) == (r.converged is not None) for r in got.values())
