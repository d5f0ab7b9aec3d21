import numpy as np
from pyspark.sql import functions as F

from tidelight.operators import slope
from tidelight.sources import discovery, readers, sinks, text
from tidelight.streaming import incremental


def test_text_tables(spark, tmp_path):
    (tmp_path / "a.dat").write_text("# head\n58119.5  1.5 0.1\n\n58120.5 -999 0.1\n58121.5 x 0.1 9\n")
    df = text.read_whitespace(spark, str(tmp_path / "a.dat"), text.BAT_COLUMNS)
    assert [tuple(r) for r in df.orderBy("mjd").collect()] == [(58119.5, 1.5, 0.1), (58120.5, -999.0, 0.1), (58121.5, None, 0.1)]
    assert text.valid_scan(df, "count_rate").count() == 1
    (tmp_path / "b.tbl").write_text("\\ comment\n 1.0 | 2.0 |3.0\n")
    assert [tuple(r) for r in text.read_pipe(spark, str(tmp_path / "b.tbl"), ["a", "b", "c"]).collect()] == [(1.0, 2.0, 3.0)]
    (tmp_path / "c.txt").write_text("###MJD m F\n58000.1 17.2 o\n")
    df = text.read_headed(spark, str(tmp_path / "c.txt"))
    assert df.columns == ["MJD", "m", "F"] and df.count() == 1


def test_light_curve_readers(spark, tmp_path):
    rows = "\n".join(f"{58000 + i * 0.25},{1 + i % 3},0.5" for i in range(40))
    (tmp_path / "MAXI_J0001p123_maxi_lc.csv").write_text("MJD,flux_2_20,error_2_20\n" + rows + "\n58011.1,,0.5\n58012.1,3,-1\n58012.2,nan,1\n")
    got = readers.load_xray(spark, str(tmp_path))
    assert got.count() == 10 and got.first().source == "MAXI J0001+123"
    rows = "\n".join(f"{58000 + i * 0.25},{17 + i % 2},0.05,zg,{32768 if i == 3 else 0}" for i in range(20))
    (tmp_path / "X_ztf.csv").write_text("\\ note\nmjd,mag,magerr,filtercode,catflags\n" + rows + "\n58001.0,17,0.1,zr,0\n")
    got = readers.load_optical_bands(spark, str(tmp_path))
    assert {r.band for r in got.collect()} == {"zg"} and got.count() == 19
    tol = readers.load_magnitudes(spark, str(tmp_path), "*_ztf.csv")
    assert tol.count() == 21 and tol.first()["filter"] in ("zg", "zr")


def test_discovery_prefers_earlier_pattern(spark, tmp_path):
    for n in ("A_ztf.csv", "A_atlas.csv", "RJ0146.9+6121_maxi.csv", "note.md"):
        (tmp_path / n).write_text("x\n")
    files = discovery.list_files(spark, str(tmp_path))
    assert files.count() == 3
    got = {r.source_key: r.path.rsplit("/", 1)[1] for r in discovery.first_pattern(files, "path", discovery.OPTICAL_PATTERNS).collect()}
    assert got == {"A": "A_atlas.csv"}
    got = {r.source_key for r in discovery.first_pattern(files, "path", discovery.XRAY_PATTERNS).collect()}
    assert got == {"RJ0146.9+6121"}


def test_spans_upsert_and_classes(spark, tmp_path):
    old = spark.createDataFrame([("A", 1.0, 2.0), ("b", 3.0, 4.0)], "source string, t_start double, t_end double")
    new = spark.createDataFrame([(" a", 5.0, 6.0)], old.schema)
    assert {r.source for r in readers.upsert_spans(old, new).collect()} == {"b", " a"}
    (tmp_path / "c.csv").write_text("query_name,compact_object,xrb_type\nMAXI J1+2,Black Hole,LMXB\nMAXI_J1p2,NS,\nGX,odd,hmxb\n")
    got = {r.ckey: (r.compact_object, r.src_type) for r in readers.load_classification(spark, str(tmp_path / "c.csv")).collect()}
    assert got == {"MAXIJ12": ("NS", "UNKNOWN"), "GX": ("UNKNOWN", "HMXB")}


def test_sink_writes_header_even_without_rows(spark, tmp_path):
    df = spark.createDataFrame([], "a int, b string")
    sinks.write_csv(df, str(tmp_path / "o"), ["b", "a"])
    text_ = "".join(p.read_text() for p in (tmp_path / "o").glob("part*"))
    assert text_.strip() == "b,a"


def test_resume(spark, tmp_path):
    want = spark.createDataFrame([("a",), ("b",), ("c",)], "source string")
    done = want.where("source <> 'c'")
    assert {r.source for r in incremental.pending(want, done, ["source"]).collect()} == {"c"}
    assert {r.source for r in incremental.pending(want, done, ["source"], ["a"]).collect()} == {"a", "c"}
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.csv").write_text("mjd,val\n1,2\n2,3\n")
    schema = spark.createDataFrame([(1.0, 1.0)], "mjd double, val double").schema
    run = lambda: incremental.append_new_files(spark, src, schema, lambda d: d.groupBy("file_name").agg(F.sum("val").alias("s")), out, ck)
    run()
    run()
    (tmp_path / "in" / "2.csv").write_text("mjd,val\n1,7\n")
    run()
    assert {(r.file_name, r.s) for r in spark.read.parquet(out).collect()} == {("1.csv", 5.0), ("2.csv", 7.0)}


def test_slopes(spark):
    rng = np.random.default_rng(6)
    rows = []
    for s in range(8):
        x = 10 ** rng.uniform(-10, -8, 30)
        y = 10 ** (3.0 - 0.6 * s) * x**0.6
        rows += [("BH", f"s{s}", float(a), float(b), float(0.05 * b)) for a, b in zip(x, y)]
    rows += [("NS", "q", 1e-9, 1.0, 0.1)] * 3
    df = spark.createDataFrame(rows, "cls string, source string, xf double, of double, oe double")
    fixed = {r.compact_object: r for r in slope.fixed_effects_slope(df).collect()}
    assert abs(fixed["BH"].beta - 0.6) < 1e-9 and fixed["BH"].n_sources_used == 8
    assert fixed["NS"].beta == 0.5 and fixed["UNKNOWN"].beta == 0.5 and fixed["NS"].n_pairs_total == 3
    pooled = {r.compact_object: r for r in slope.pooled_slope(df).collect()}
    assert abs(pooled["BH"].beta - 0.6) > 0.01 and pooled["NS"].n_pairs == 3 and pooled["NS"].beta == 0.5
