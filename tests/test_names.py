import pytest
from pyspark.sql import functions as F

from tidelight import schema
from tidelight.functions import coords, names

GOLDEN = {
    "MAXI_J2303p088_maxi_lc": "MAXI J2303+088",
    "MAXI_J2303+088_ztf": "MAXI J2303+088",
    "MAXI_J2304m086_maxi_lc": "MAXI J2304-086",
    "RJ0146.9+6121_maxi": "RX J0146.9+6121",
    "RJ0146.9+6121_ztf": "RX J0146.9+6121",
    "SCO_X-1_maxi": "Sco X-1",
    "SER_X-1_maxi": "Ser X-1",
    "V0332+53_maxi": "V0332+53",
    "VELA_X-1_maxi": "Vela X-1",
    "XTE_J1709-267_maxi": "XTE J1709-267",
    "4U0053_604_maxi": "4U 0053+604",
    "4U0115_634_ztf": "4U 0115+634",
    "MAXI_J0028_592_ztf": "MAXI J0028+592",
    "LMC_X-4_maxi": "LMC X-4",
}


def test_golden_names(spark):
    df = spark.createDataFrame([(k,) for k in GOLDEN], "f string")
    rows = {r.f: r for r in names.parse_names(df, "f").collect()}
    assert {k: r.query_name for k, r in rows.items()} == GOLDEN
    assert rows["V0332+53_maxi"].confidence == "low"
    assert rows["4U0053_604_maxi"].query_name_alt == "4U 0053-604"
    assert rows["MAXI_J0028_592_ztf"].sign_ambiguous
    assert rows["MAXI_J2303p088_maxi_lc"].instrument == "MAXI"
    assert rows["RJ0146.9+6121_ztf"].band == "optical"


def test_title_words(spark):
    df = spark.createDataFrame([("1a-bC", "1A-Bc"), ("O'NEIL", "O'Neil"), ("LMC", "Lmc")], "w string, want string")
    for r in df.select(names.title_word(F.col("w")).alias("got"), "want").collect():
        assert r.got == r.want


def test_keys_and_variants(spark):
    df = spark.createDataFrame([("MAXI_J1848m024",), ("MAXI J1848-024",)], "n string")
    got = df.select(names.canonical_key(F.col("n")).alias("c"), names.signed_key(F.col("n")).alias("s")).collect()
    assert {r.c for r in got} == {"MAXIJ1848024"} and {r.s for r in got} == {"MAXIJ1848-024"}
    df = spark.createDataFrame([("4U 0535+262",), ("Sco X-1",)], "n string")
    got = [[tuple(v) for v in r.v] for r in df.select(names.name_variants(F.col("n")).alias("v")).collect()]
    assert got == [[("4U 0535+26", False), ("4U 0535+26*", True)], []]


@pytest.mark.parametrize(
    "name,ra,dec,prec",
    [
        ("MAXI J2303+088", 345.75, 8.8, 900 * 0.98823),
        ("RX J0146.9+6121", 26.725, 61.35, 60.0),
        ("X J012345.6-301530", 20.94, -30.258333, 1.5 * 0.86377),
        ("X J0123+30", 20.75, 30.0, 3600.0),
        ("X J0123+30153", 20.75, 30.255, 900 * 0.8638),
        ("X J01234+301", None, None, None),
        ("X J0170+301", None, None, None),
        ("Sco X-1", None, None, None),
    ],
)
def test_j_names(spark, name, ra, dec, prec):
    df = spark.createDataFrame([(name,)], "n string")
    j = coords.with_j_position(df, "n").collect()[0].j
    if ra is None:
        assert j is None
    else:
        assert (j.ra, j.dec) == (pytest.approx(ra, abs=1e-5), pytest.approx(dec, abs=1e-5))
        assert j.precision == pytest.approx(prec, rel=1e-3)


def test_plain_candidates(spark):
    df = spark.createDataFrame([("4U 1957+115",), ("4U 1700-37",), ("4U 1700-990",)], "n string")
    got = [[(c.label, round(c.dec, 3)) for c in r.c] for r in coords.with_plain_candidates(df, "n").collect()]
    assert got == [
        [("tenths-of-degree", 11.5), ("whole-degree-truncated", 11.0)],
        [("whole-degree", -37.0)],
        [],
    ]


def test_sexagesimal(spark):
    rows = [("04 19 42.141", "-00 30 00"), ("04:19:42.141", "-0:30:0"), ("64.9255875", "-0.5"), ("--", "3"), (None, "1")]
    got = coords.with_position(spark.createDataFrame(rows, "r string, d string"), "r", "d").collect()
    for r in got[:3]:
        assert r.ra == pytest.approx(64.9255875) and r.dec == pytest.approx(-0.5)
    assert got[3].ra is None and got[4].ra is None


def test_column_rules():
    cols = ["MJD", "Flux_2_20", "error_2_20", "###time"]
    assert schema.by_name(cols, ["x", "mjd"]) == "MJD"
    assert schema.by_both(cols, "err", "2_20") == "error_2_20"
    assert schema.by_keyword(["a_mag", "MAGPSF"], ["magpsf", "mag"]) == "MAGPSF"
    assert schema.by_name(cols, ["y"]) is None
