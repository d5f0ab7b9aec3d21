"""Folders whose files differ in the order, case and names of their columns."""

import pytest
from pyspark.sql import functions as F

from tidelight.sources import discovery, headed, readers, text
from tidelight.streaming import incremental


@pytest.fixture
def values(spark):
    """Thirty values of the event table, as the numbers of the files."""
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("event_id").limit(30).select("value").collect()
    return [round(abs(r.value) + 1, 3) for r in rows]


def write(path, header, rows):
    path.write_text(header + "\n" + "\n".join(",".join(map(str, r)) for r in rows) + "\n")


def test_xray(spark, tmp_path, values):
    a = [(58000 + 2 * i, v, 0.5) for i, v in enumerate(values)]
    write(tmp_path / "A_maxi_lc.csv", "mjd,flux_2_20,err_2_20", a)
    write(tmp_path / "B_maxi.csv", "#error_2_20,extra,MJD,Flux_2_20", [(e, "x", t, v) for t, v, e in a])
    write(tmp_path / "C_maxi_lc", "datetime,mjd,flux_2_4,flux_2_20,err_2_4,err_2_20", [("d", t, 9, v, 9, e) for t, v, e in a])
    write(tmp_path / "A_maxi.csv", "mjd,flux_2_20,err_2_20", [(t, v + 100, e) for t, v, e in a])
    got = readers.load_xray(spark, str(tmp_path)).collect()
    by = {}
    for r in got:
        by.setdefault((r.source, r.file), []).append((r.mjd, r.val, r.err))
    assert len(by) == 4 and all(len(v) == len(values) for v in by.values())
    want = [(t, pytest.approx(v), pytest.approx(e)) for t, v, e in a]
    assert sorted(by["B", "B_maxi.csv"]) == want and sorted(by["C maxi lc", "C_maxi_lc"]) == want and sorted(by["A", "A_maxi_lc.csv"]) == want
    assert sorted(by["A", "A_maxi.csv"])[0][1] == pytest.approx(a[0][1] + 100)


def test_xray_without_column_is_an_error(spark, tmp_path):
    write(tmp_path / "A_maxi.csv", "mjd,flux_4_10,err_4_10", [(1, 2, 3)])
    with pytest.raises(KeyError):
        readers.load_xray(spark, str(tmp_path))


def test_optical(spark, tmp_path, values):
    a = [(58000 + i, 15 + v % 3, 0.05, "zg") for i, v in enumerate(values)]
    write(tmp_path / "A_ztf.csv", "mjd,mag,magerr,filtercode", a)
    write(tmp_path / "B_ztf.csv", "catflags,FilterCode,MAG,hjd,MagErr,MJD", [(i % 2, f, m, 0, e, t) for i, (t, m, e, f) in enumerate(a)])
    got = readers.load_optical_bands(spark, str(tmp_path)).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in got} == {"A": 30, "B": 15}
    got = readers.load_magnitudes(spark, str(tmp_path)).groupBy("_file").agg(F.sum("mag").alias("m"), F.min("filter").alias("f")).collect()
    assert len(got) == 2 and got[0].m == pytest.approx(got[1].m) and {r.f for r in got} == {"zg"}
    write(tmp_path / "C_other.csv", "a,b", [(1, 2)])
    assert readers.load_magnitudes(spark, str(tmp_path)).count() == 60


def test_hardness(spark, tmp_path, values):
    write(tmp_path / "A_maxi.csv", "mjd,flux_4_10,err_4_10,flux_10_20,err_10_20,flux_2_20", [(i, v, 0.1, v / 2, 0.1, 2 * v) for i, v in enumerate(values)])
    write(tmp_path / "B_maxi.csv", "FLUX_10_20,ERROR_4_10,FLUX_4_10,# MJD", [(v / 2, 0.1, v, i) for i, v in enumerate(values)])
    with pytest.raises(ValueError):
        readers.load_hardness(spark, str(tmp_path))
    write(tmp_path / "B_maxi.csv", "FLUX_10_20,ERROR_4_10,FLUX_4_10,MJD", [(v / 2, 0.1, v, i) for i, v in enumerate(values)])
    got = readers.load_hardness(spark, str(tmp_path))
    rows = {r._file: r for r in got.groupBy("_file").agg(F.count("*").alias("n"), F.sum("hr_x").alias("h"), F.sum("err_4_10").alias("e"), F.count("hr_x_err").alias("k")).collect()}
    a, b = rows["A_maxi.csv"], rows["B_maxi.csv"]
    assert a.n == b.n == 30 and a.h == pytest.approx(b.h) and b.e == pytest.approx(3.0) and (a.k, b.k) == (30, 0)


def test_text_and_unions(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("###MJD m F\n58000.1 17.2 o\n\n58000.3 17.4 c\n")
    (tmp_path / "t" / "b.txt").write_text("F MJD dm\nc 58000.2 0.1\n")
    got = {r.MJD: (r.m, r.F, r.dm) for r in text.read_headed(spark, str(tmp_path / "t")).collect()}
    assert got == {"58000.1": ("17.2", "o", None), "58000.3": ("17.4", "c", None), "58000.2": (None, "c", "0.1")}
    (tmp_path / "s").mkdir()
    write(tmp_path / "s" / "1.csv", "source,span_start_mjd,span_end_mjd", [("A", 1, 2)])
    write(tmp_path / "s" / "2.csv", "t_end,t_start,Source,note", [(4, 3, "B", "n")])
    assert {tuple(r) for r in readers.load_spans(spark, str(tmp_path / "s")).collect()} == {("A", 1.0, 2.0), ("B", 3.0, 4.0)}
    both = readers.union_files(spark, str(tmp_path / "missing.csv"), str(tmp_path / "s"))
    assert {(r.source, r.t_start, r.span_start_mjd, r.note) for r in both.collect()} == {("A", None, "1", None), ("B", "3", None, "n")}
    assert readers.union_files(spark, str(tmp_path / "s" / "1.csv"), str(tmp_path / "s")).count() == 1


def test_classification_of_several_files(spark, tmp_path):
    write(tmp_path / "a.csv", "query_name,compact_object,xrb_type", [("GX", "Black Hole", "LMXB"), ("Q", "NS", "hmxb")])
    write(tmp_path / "b.csv", "type,bh_ns,source", [("hmxb", "NS", "GX")])
    got = {r.ckey: (r.compact_object, r.src_type) for r in readers.load_classification(spark, str(tmp_path)).collect()}
    assert got == {"GX": ("NS", "HMXB"), "Q": ("NS", "HMXB")}


def test_new_files_of_other_layouts(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "1.csv", "mjd,val", [(1, 2), (2, 3)])
    write(tmp_path / "in" / "2.csv", "VAL,other,MJD", [(7, "x", 1)])
    schema = spark.createDataFrame([(1.0, 1.0)], "mjd double, val double").schema
    run = lambda: incremental.append_new_files(spark, src, schema, lambda d: d.groupBy("file_name").agg(F.sum("val").alias("s"), F.max("mjd").alias("m")), out, ck)
    run()
    write(tmp_path / "in" / "3.csv", "mjd", [(5,)])
    run()
    assert {(r.file_name, r.s, r.m) for r in spark.read.parquet(out).collect()} == {("1.csv", 5.0, 2.0), ("2.csv", 7.0, 1.0), ("3.csv", None, 5.0)}


def test_files_without_extension(spark, tmp_path):
    for n in ("A_maxi_lc", "B_maxi", "C_ztf_lc", "D_maxi.csv", "README"):
        (tmp_path / n).write_text("x\n")
    files = discovery.list_files(spark, str(tmp_path))
    assert {r.source_key for r in discovery.first_pattern(files, "path", discovery.XRAY_PATTERNS).collect()} == {"A", "B", "D"}
    assert {r.source_key for r in discovery.first_pattern(files, "path", discovery.ZTF_PATTERNS).collect()} == {"C"}


def test_header_names():
    assert headed.names_of('###MJD, "a" ,,A') == ["MJD", "a", "column_2", "A_3"]
