"""FITS tables, pipe tables, stored spans, stored curves, stored catalogs, logs: on files made here."""

import glob as globs
import os
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelight.operators import pulsefit, sky
from tidelight.plans import sky_queries
from tidelight.sources import catalogs, fits, pipes, readers, sinks, stores, text

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------------------------- FITS


def card(key, value, comment=""):
    v = f"'{value:<8}'" if isinstance(value, str) else ("T" if value is True else "F" if value is False else str(value)).rjust(20)
    return f"{key:<8}= {v} / {comment}"[:80].ljust(80)


def header(cards):
    raw = "".join([*[card(*c) for c in cards], "COMMENT free text".ljust(80), "END".ljust(80)]).encode()
    return raw + b" " * (-len(raw) % 2880)


def table_hdu(name, columns, rows, extra=()):
    """columns: (name, form, struct code); rows: tuples of packed values."""
    body = b"".join(b"".join(struct.pack(">" + code, *(v if isinstance(v, tuple) else (v,))) for v, (_, _, code) in zip(r, columns)) for r in rows)
    width = struct.calcsize(">" + "".join(c[2] for c in columns))
    cards = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", width), ("NAXIS2", len(rows)), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(columns))]
    for i, (n, form, _) in enumerate(columns, 1):
        cards += [(f"TTYPE{i}", n), (f"TFORM{i}", form)]
    return header([*cards, ("EXTNAME", name), *extra]) + body + b"\0" * (-len(body) % 2880)


PRIMARY = header([("SIMPLE", True), ("BITPIX", -32), ("NAXIS", 1), ("NAXIS1", 1000)]) + b"\0" * (2880 * 2)
COLUMNS = [("Time", "1D", "d"), ("Rate", "E", "f"), ("n", "J", "i"), ("name", "6A", "6s"), ("ok", "L", "c"), ("pair", "2I", "2h"), ("big", "K", "q"), ("u", "I", "h"), ("bits", "9X", "2s")]


def rows_of(n):
    return [(50000.5 + i, float("nan") if i == 3 else i / 4, -99 if i == 2 else i, f"s{i}".encode(), b"T" if i % 2 else b"F", (i, -i), 2**40 + i, i - 5, b"\0\0") for i in range(n)]


def write_fits(path, n, columns=COLUMNS, name="RATE"):
    other = table_hdu("GTI", [("START", "D", "d")], [(1.0,), (2.0,)])
    keep = [c for c in columns]
    at = [COLUMNS.index(c) for c in keep]
    rows = [tuple(r[i] for i in at) for r in rows_of(n)]
    extra = [(f"TNULL{i + 1}", -99) for i, c in enumerate(keep) if c[0] == "n"] + [x for i, c in enumerate(keep) if c[0] == "u" for x in ((f"TZERO{i + 1}", 32768), (f"TSCAL{i + 1}", 1))]
    with open(path, "wb") as f:
        f.write(PRIMARY + other + table_hdu(name, keep, rows, extra))


def test_fits_tables(spark, tmp_path):
    write_fits(tmp_path / "a.fits", 40)
    df = fits.read_fits(spark, str(tmp_path), hdu="rate")
    assert dict(df.dtypes) == {"Time": "double", "Rate": "double", "n": "int", "name": "string", "ok": "boolean", "pair": "array<smallint>", "big": "bigint", "u": "double", "_file": "string"}
    got = sorted(df.collect(), key=lambda r: r.Time)
    assert len(got) == 40
    for i, r in enumerate(got):
        assert (r.Time, r.n, r.name, r.ok, list(r.pair), r.big, r.u) == (50000.5 + i, None if i == 2 else i, f"s{i}", bool(i % 2), [i, -i], 2**40 + i, i - 5 + 32768)
        assert np.isnan(r.Rate) if i == 3 else r.Rate == np.float32(i / 4)
    assert [r.START for r in fits.read_fits(spark, str(tmp_path)).orderBy("START").collect()] == [1.0, 2.0]  # the first table
    assert fits.read_fits(spark, str(tmp_path), hdu="2").count() == 40
    with pytest.raises(Exception, match="no binary table"):
        fits.read_fits(spark, str(tmp_path), hdu="NONE").count()


def test_fits_row_ranges_and_columns(spark, tmp_path):
    write_fits(tmp_path / "a.fits", 1000)
    write_fits(tmp_path / "b.fits", 3, COLUMNS[:2])
    spark.dataSource.register(fits.FitsTable)
    df = spark.read.format("fits_table").option("hdu", "RATE").option("partBytes", "5000").load(str(tmp_path))
    assert df.rdd.getNumPartitions() > 5
    assert sorted(r.n for r in df.where("n IS NOT NULL").select("n").collect()) == [i for i in range(1000) if i != 2]
    assert df.where(F.col("_file").endswith("b.fits")).selectExpr("count(*)", "count(n)").first()[:] == (3, 0)  # a column it lacks
    few = fits.read_fits(spark, str(tmp_path), hdu="RATE", schema="big long, Time double")
    assert few.columns == ["big", "Time"] and few.count() == 1003


def test_fits_curves(spark, tmp_path):
    write_fits(tmp_path / "a.fits", 20)
    df = fits.load_fits_curves(spark, str(tmp_path), start=50010.5, hdu="RATE")
    assert df.columns[:2] == ["MJD", "RATE"] and df.count() == 10 and df.where("isnan(RATE)").count() == 0


# ---------------------------------------------------------------------------- text tables

PIPES = """\\fixlen = T
\\ a comment
|   ra    |  name        | n   |note|
|  double |  char        | int |char|
|   deg   |              |     |    |
|  null   |  --          |     |    |
    10.5   Crab  PSR       12   ab
    null   --                   c d
  bad      x | y            7
"""


def test_pipe_header_tables(spark, tmp_path):
    (tmp_path / "a.tbl").write_text(PIPES)
    (tmp_path / "b.tbl").write_text("|name|ra   |\n Vela 128.8 \n")
    got = sorted(pipes.read_pipe_header(spark, str(tmp_path)).collect(), key=lambda r: (r._file, r.name or ""))
    rows = [(r.ra, r.name, r.n, r.note) for r in got]
    assert rows == [(None, None, None, "c d"), ("10.5", "Crab  PSR", 12, "ab"), (None, "x | y", 7, None), ("128.8", "Vela", None, None)] or rows == [
        (None, None, None, "c d"), (10.5, "Crab  PSR", 12, "ab"), (None, "x | y", 7, None), (128.8, "Vela", None, None)]
    one = pipes.read_pipe_header(spark, str(tmp_path / "a.tbl"))
    assert dict(one.dtypes) == {"ra": "double", "name": "string", "n": "bigint", "note": "string", "_file": "string"}
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.tbl").write_text("no header\n")
    with pytest.raises(ValueError, match="pipe"):
        pipes.read_pipe_header(spark, str(tmp_path / "none"))


def test_rates(spark, tmp_path):
    (tmp_path / "r.txt").write_text("! note\n# other\n58000.5 1.5 0.1 9\n58001.5 -95 0.1\n58002.5 -89 0.1\n58003.5 x 1\n")
    assert [r.mjd for r in text.read_rates(spark, str(tmp_path / "r.txt")).collect()] == [58000.5, 58002.5]
    assert [r.mjd for r in text.read_rates(spark, str(tmp_path / "r.txt"), start=58001.0).collect()] == [58002.5]
    assert text.read_raw_rates(spark, str(tmp_path / "r.txt")).columns == text.BAT_RAW_COLUMNS


def test_filter_ids(spark, tmp_path):
    (tmp_path / "a.csv").write_text("mjd,magpsf,sigmapsf,fid\n1,15,0.1,1\n2,16,0.1,2\n3,17,0.1,3\n")
    assert [r["filter"] for r in readers.load_magnitudes(spark, str(tmp_path)).orderBy("mjd").collect()] == ["g", "r", "3"]


def test_event_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("file_stem,instrument,band,outburst_id,mjd_start,mjd_end,n_points,duration_days\nx_maxi,MAXI,2-20 keV,1,10,20,30,10\nx_maxi,MAXI,2-20keV,2,30,31,3,1\n")
    (tmp_path / "b.csv").write_text("file_stem,instrument,band,span_start_mjd,span_end_mjd,n_points\ny_maxi,maxi,2-20keV,5,9,26\ny,maxi,2-20keV,,9,26\n")
    df = readers.load_outbursts(spark, str(tmp_path))
    assert sorted((r.file_stem, r.duration_days) for r in readers.qualified_outbursts(df, "maxi", "2-20keV").collect()) == [("x_maxi", 10.0), ("y_maxi", 4.0)]
    assert df.count() == 3


# -------------------------------------------------------------------------------- stores


def spans(spark, rows):
    return spark.createDataFrame(rows, "source string, t_start double, t_end double")


def stored(store):
    return sorted((r.source, r.t_start, r.t_end) for r in store.spans().collect()), sorted(r.source for r in store.misses().collect())


def test_span_store(spark, tmp_path):
    store = stores.SpanStore(spark, str(tmp_path / "s"), parts=4)
    assert stored(store) == ([], [])
    looked = spark.createDataFrame([(c,) for c in ["A", "b ", "C", None]], "source string")
    store.replace(spans(spark, [("A", 1.0, 2.0), ("A", 3.0, 4.0), ("D", 5.0, 6.0)]), looked)
    assert stored(store) == ([("A", 1.0, 2.0), ("A", 3.0, 4.0), ("D", 5.0, 6.0)], ["C", "b"])
    for _ in range(2):  # a repeated run changes nothing more
        store.replace(spans(spark, [(" a", 7.0, 8.0), ("B", 1.0, 1.5)]))
        assert stored(store) == ([("B", 1.0, 1.5), ("D", 5.0, 6.0), ("a", 7.0, 8.0)], ["C"])
    store.replace(spans(spark, []), spark.createDataFrame([("d",)], "source string"))
    assert stored(store) == ([("B", 1.0, 1.5), ("a", 7.0, 8.0)], ["C", "d"])
    assert sorted(r.source for r in store.seen().collect()) == ["B", "C", "a", "d"]


def test_failed_replacement_leaves_the_store(spark, tmp_path):
    store = stores.SpanStore(spark, str(tmp_path / "s"), parts=3)
    store.replace(spans(spark, [("A", 1.0, 2.0), ("B", 1.0, 2.0)]))
    before = stored(store)
    broken = spans(spark, [("A", 5.0, 6.0), ("C", 5.0, 6.0)]).withColumn("t_end", F.when(F.col("source") == "C", F.raise_error(F.lit("lost"))).otherwise(F.col("t_end")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        store.replace(broken)
    assert stored(store) == before
    store.replace(spans(spark, [("A", 5.0, 6.0), ("C", 5.0, 6.0)]))
    assert stored(store)[0] == [("A", 5.0, 6.0), ("B", 1.0, 2.0), ("C", 5.0, 6.0)]


def test_chunks_of_stored_curves(spark, tmp_path):
    rows = [("s", i / 4, float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "source string, mjd double, val double")
    stores.store_by_range(df, str(tmp_path / "c"), 5.0)
    chunks = spark.createDataFrame([(10.0, 20.0), (20.0, 22.5)], "start double, end double")
    got = stores.scan_chunks(spark, str(tmp_path / "c"), chunks, 5.0)
    assert sorted(r.mjd for r in got.collect()) == [t / 4 for t in range(40, 90)]  # rows on borders once
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    both = stores.scan_chunks(spark, str(tmp_path / "c"), chunks, 5.0, closed=True)
    assert both.where("mjd = 20").count() == 2 and both.where("mjd = 22.5").count() == 1
    stores.store_by_range(df.where("mjd < 5").withColumn("val", F.lit(0.0)), str(tmp_path / "c"), 5.0)
    back = spark.read.parquet(str(tmp_path / "c"))
    assert back.count() == 400 and back.where("val = 0").count() == 20


def test_stored_catalog(spark, tmp_path):
    folder, raw = str(tmp_path / "k"), str(tmp_path / "raw")
    sky_queries.part_positions(spark, SF).write.parquet(raw)
    reads = []

    def read():
        reads.append(1)
        return spark.read.parquet(raw)

    name = "t" + os.path.basename(str(tmp_path)).replace("-", "_")
    points = sky_queries.sources(spark, SF)
    want = sorted(map(str, sky.cone_join(points, read(), 10.0, ["row_idx"]).collect()))
    first = catalogs.kept_catalog(spark, folder, name, read, 10.0, ["row_idx"])
    assert sorted(map(str, first.join(points).collect())) == want and len(reads) == 2
    for part in ("rows", "boxes"):  # as a new session would find it
        spark.sql(f"DROP TABLE {name}_{part}")
    again = catalogs.kept_catalog(spark, folder, name, read, 10.0, ["row_idx"])
    df = again.nearest(points)
    assert sorted(map(str, again.join(points).collect())) == want and len(reads) == 2  # no raw file is read
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = again.nearest(points)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    lines = plan.splitlines()
    scans = [i for i, x in enumerate(lines) if f"{name}_" in x and "FileScan" in x]
    assert len(scans) == 2 and all("PartitionFilters: [_zone" in lines[i] for i in scans)
    depth = [len(x) - len(x.lstrip(" :")) for x in lines]
    for i in scans:  # up to the join above it, nothing shuffles the catalog
        above = [j for j in range(i) if depth[j] < min(depth[j + 1 : i + 1])]
        joined = max(j for j in above if "Join" in lines[j])
        assert not any("Exchange" in lines[j] for j in above if j > joined), plan
    assert df.columns
    wider = catalogs.kept_catalog(spark, folder, name, read, 20.0, ["row_idx"])
    assert len(reads) == 3 and wider.radius_arcsec == 20.0


# ------------------------------------------------------------------- dedup, curves, logs

AS = 1 / 3600.0


@pytest.mark.parametrize("tile,most,bound", [(4096, 50_000, 4), (2048, 50_000, 9)])
def test_ordered_chain_takes_few_rounds(spark, tile, most, bound):
    n = 10_000
    dec = np.arange(n) * 4 * AS - 20.0
    spots = spark.createDataFrame(pd.DataFrame({"ra": 10.0, "dec": dec, "_o": range(n)}))
    reps, rounds = sky.representatives(spots, 5.0, tile, most)
    assert sorted(r._o for r in reps.collect()) == list(range(0, n, 2))
    assert rounds <= bound, rounds


def test_crowded_tiles_go_by_cells(spark):
    rng = np.random.default_rng(4)
    xy = rng.normal(0, 40, (300, 2)) * AS + [50.0, 10.0]
    spots = spark.createDataFrame(pd.DataFrame({"ra": xy[:, 0], "dec": xy[:, 1], "_o": range(300)}))
    want = sorted(r._o for r in sky.representatives(spots, 5.0)[0].collect())
    for tile, most in ((8, 50_000), (4096, 10), (32, 60)):
        assert sorted(r._o for r in sky.representatives(spots, 5.0, tile, most)[0].collect()) == want


def test_fitted_curves(spark):
    rng = np.random.default_rng(1)
    t = np.arange(58000.0, 58060.0)
    true = np.where(t > 58010, 5 * np.exp(-2 / np.maximum(t - 58010, 1e-9) - (t - 58010) / 9), 0.0)
    rows = [("a", float(x), float(v + 0.02 * rng.normal()), 0.05, 0.0, 0.2) for x, v in zip(t, true)]
    s = spark.createDataFrame(rows, "source string, mjd double, val double, err double, baseline double, threshold double")
    one = spark.createDataFrame([("a", 1, 58000.0, 58059.0)], "source string, outburst_idx long, t_start double, t_end double")
    fits_ = pulsefit.fit_pulses(s, one, ["source"])
    f = fits_.first()
    got = pulsefit.fitted_curves(fits_, ["source"], 500).orderBy("point").collect()
    assert len(got) == 500 and got[0].mjd == f.span_start_mjd and got[-1].mjd == f.span_end_mjd
    # direct mean of the pulse over the window, on the grid of the fit
    step = max(59 / 3000, 0.02)
    grid = np.arange(58000.0 - max(2 * f.width_max, 15.0), 58059.0 + max(2 * f.width_max, 15.0) + step, step)
    lag = np.maximum(grid - f.t0, 1e-300)
    pulse = np.where(grid > f.t0, f.A * np.exp(-f.tau1 / lag - lag / f.tau2), 0.0)
    n = max(1, round(max(f.width, step) / step)) // 2 * 2 + 1
    smooth = np.convolve(pulse, np.ones(n) / n, mode="same")
    want = np.interp([r.mjd for r in got], grid, smooth)
    assert np.allclose([r.model for r in got], want, atol=1e-9)
    marked = [r.mjd for r in got if r.in_t90]
    assert min(marked) >= f.t5 and max(marked) <= f.t95 and sum(r.is_peak for r in got) == 1
    assert pulsefit.fitted_curves(fits_.withColumn("error", F.lit("x")), ["source"]).count() == 0


def test_logs_of_sources(spark, tmp_path):
    names = "source string, band string, outburst_idx int, span_start_mjd double, span_end_mjd double, A double, t0 double, tau1 double, tau2 double, width double, chi2 double, dof long, aic double, t90 double"
    rows = [(s, "b", i, *[float(i)] * 8, 3, 1.0, 2.0) for s in ("x", "y/z") for i in (2, 1)]
    sinks.write_source_logs(spark.createDataFrame(rows, names), str(tmp_path / "l"))
    sinks.write_source_logs(spark.createDataFrame(rows[:1], names), str(tmp_path / "l"))
    back = spark.read.text(str(tmp_path / "l"))
    assert sorted((r.log, r.value.split()[2]) for r in back.collect()) == [("x", "#2"), ("y/z", "#1"), ("y/z", "#2")]
    sinks.write_log(spark.createDataFrame(rows, names), str(tmp_path / "m"))
    for path in globs.glob(str(tmp_path / "m" / "part-*")):
        lines = open(path).read().split("\n")[:-1]
        assert lines == sorted(lines)
    review = spark.createDataFrame([tuple("abcd") + (True,) + tuple("efghi")], ", ".join(f"{c} {'boolean' if c == 'sign_ambiguous' else 'string'}" for c in sinks.REVIEW_COLUMNS))
    sinks.write_review(review.select(*reversed(review.columns)), str(tmp_path / "n"))
    assert spark.read.option("header", True).csv(str(tmp_path / "n")).columns == sinks.REVIEW_COLUMNS
