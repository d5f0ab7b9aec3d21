"""Cone joins, positional dedup, name resolution and classification."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import coords
from ..functions.expr import rnd
from ..operators import classify as cl
from ..operators import sky
from ..operators.skew import split_join
from ..session import shared_folder
from ..sources import catalogs as catalogs_kept
from ..sources.tables import GOLDEN_DEG, GOLDEN_FRAC, sphere, table
from .sqltext import r, with_

AS = 1.0 / 3600.0


def sources(spark, sf):
    """Customers at their base position, shifted by a few arcseconds."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("src"), *sphere(k, dra=(k % 7) * AS, ddec=(k % 41 - 20) * AS)
    )


def part_positions(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(k.alias("row_idx"), *sphere(k))


def catalogs(spark, sf):
    """Four catalogs with their evidence columns, stacked with a priority."""
    s, p = table(spark, sf, "supplier"), table(spark, sf, "part")
    null = F.lit(None).cast("string")
    sk, pk = F.col("s_suppkey"), F.col("p_partkey")
    black = F.when(F.col("s_nationkey") % 3 == 0, "HMXB").otherwise("LMXB")
    even = sk % 2 == 0
    bh = s.select(
        F.when(even, "watchdog_bhxb").otherwise("blackcat_bh").alias("cat"),
        F.when(even, 0).otherwise(1).alias("priority"), sk.alias("row_idx"), *sphere(sk * 3),
        F.when(~even, black).alias("type"), null.alias("ppulse"), null.alias("msp"), null.alias("xtype"),
    )
    low = pk % 2 == 0
    period = F.when(F.col("p_size") % 4 == 0, F.col("p_size").cast("string")).when(F.col("p_size") % 4 == 1, "--")
    kind = (
        F.when(F.col("p_type") == "PROMO", "burster").when(F.col("p_type") == "STANDARD", "BH cand")
        .otherwise("")
    )
    xrb = p.select(
        F.when(low, "lmxb_xrbcats").otherwise("hmxb_heasarc").alias("cat"),
        F.when(low, 2).otherwise(3).alias("priority"), pk.alias("row_idx"), *sphere(pk),
        null.alias("type"), period.alias("ppulse"),
        F.when(low & (F.col("p_size") % 9 == 0), "1").alias("msp"), kind.alias("xtype"),
    )
    return bh.unionByName(xrb)


def _digits(x, width):
    return F.lpad(F.floor(x).cast("string"), width, "0")


def _mod(x, m):
    return x - m * F.floor(x / m)


def _with_digits(df):
    """Digit groups of ra and dec as columns of their own."""
    hours = F.col("ra") / 15.0
    size = F.abs("dec")
    return df.withColumns(
        {
            "hh": _digits(hours, 2), "mm": _digits(_mod(hours * 60.0, 60.0), 2),
            "ss": _digits(_mod(hours * 3600.0, 60.0), 2), "tenth": _digits(_mod(hours * 36000.0, 10.0), 1),
            "sign": F.when(F.col("dec") < 0, "-").otherwise("+"),
            "d2": _digits(size, 2), "d3": _digits(size * 10.0, 3),
            "dm": _digits(_mod(size * 60.0, 60.0), 2), "ds": _digits(_mod(size * 3600.0, 60.0), 2),
        }
    )


def source_names(spark, sf):
    """Names that encode the base position at several truncations, and plain ones."""
    k = F.col("src")
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("src"), *sphere(F.col("c_custkey")))
    base = _with_digits(base)
    plain = F.when(k % 8 == 2, F.col("d3")).otherwise(F.col("d2"))
    lost = (k % 4 == 2) & (k % 3 == 0)
    four_u = lambda sg: F.concat(F.lit("4U "), "hh", "mm", sg, plain)
    name = (
        F.when(k % 4 == 0, F.concat(F.lit("MAXI J"), "hh", "mm", "sign", "d3"))
        .when(k % 4 == 1, F.concat(F.lit("RX J"), "hh", "mm", "ss", F.lit("."), "tenth", "sign", "d2", "dm", "ds"))
        .when(k % 4 == 2, four_u(F.when(lost, F.lit("+")).otherwise(F.col("sign"))))
        .otherwise(F.concat(F.lit("Src "), k.cast("string")))
    )
    return base.select(
        "src", name.alias("query_name"), F.when(lost, four_u(F.lit("-"))).alias("query_name_alt")
    )


def name_index(spark, sf):
    """Local identifier table that stands for a name service."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    otype = (
        F.when(k % 5 == 0, "LXB").when(k % 5 == 1, "HXB").when(k % 5 == 2, "Pulsar").when(k % 5 == 3, "BH XB")
    )
    pos = p.select(k.alias("pos"), otype.alias("otype"), *sphere(k + 7, ddec=0.02))
    pos = _with_digits(pos)
    coded = F.concat(F.lit("4U "), "hh", "mm", "sign", "d2", F.when(F.col("pos") % 2 == 0, "0").otherwise("3"))
    name = F.when(F.col("pos") % 3 == 0, coded).otherwise(F.concat(F.lit("Src "), F.col("pos").cast("string")))
    return pos.select(
        name.alias("name"), F.concat(F.lit("id"), F.col("pos").cast("string")).alias("main_id"),
        "ra", "dec", "otype", "pos",
    )


def observations(spark, sf):
    """Archive detections around part positions, many per position."""
    li = table(spark, sf, "lineitem")
    k = F.col("l_partkey")
    return li.select(
        *sphere(k, ddec=F.col("l_linenumber") * 1.5 * AS), F.col("l_extendedprice").alias("flux"),
        F.col("l_returnflag").alias("archive"),
    )


def stacked_sources(spark, sf):
    """Three catalogs whose members crowd around common positions, with a row order."""
    def place(df, key, cat, prio, dra):
        k = F.col(key)
        g = F.floor(k / 3)
        return df.select(
            (F.lit(prio) * 1_000_000_000_000 + k).alias("ord"), F.lit(cat).alias("cat"),
            *sphere(g, dra=dra * AS, ddec=(k % 3) * 3.0 * AS),
        )
    return (
        place(table(spark, sf, "customer"), "c_custkey", "HMXB_A", 0, 0.0)
        .unionByName(place(table(spark, sf, "supplier"), "s_suppkey", "HMXB_B", 1, 2.0))
        .unionByName(place(table(spark, sf, "part"), "p_partkey", "LMXB_C", 2, 1.0))
    )


def cone_nearest(spark, sf):
    df = sky.cone_join(sources(spark, sf), part_positions(spark, sf), 10.0, ["row_idx"])
    return df.select("src", F.col("m_row_idx").alias("row_idx"), rnd(F.col("sep"), 4).alias("sep"))


def cone_nearest_stored(spark, sf):
    """The same matches from a catalog that is written once, clustered by sky cell, and opened again."""
    folder, name = shared_folder(spark), f"parts_{uuid.uuid4().hex}"
    store = lambda: catalogs_kept.kept_catalog(spark, folder, name, lambda: part_positions(spark, sf), 10.0, ["row_idx"])
    store()
    df = store().join(sources(spark, sf))
    return df.select("src", F.col("m_row_idx").alias("row_idx"), rnd(F.col("sep"), 4).alias("sep"))


def cone_best_catalog(spark, sf):
    cats = catalogs(spark, sf).select("ra", "dec", "cat", "priority", "row_idx")
    hits = sky.cone_join(sources(spark, sf), cats, 600.0, ["priority", "row_idx"], "inner")
    return hits.select("src", F.col("m_cat").alias("cat"), F.col("m_row_idx").alias("row_idx"), rnd(F.col("sep"), 4).alias("sep"))


def cone_archives(spark, sf):
    """Detection flag and largest flux per archive in a 5 arcsec cone around each part."""
    pts = part_positions(spark, sf)
    agg = sky.cone_aggregate(pts, observations(spark, sf), 5.0, "flux", by=["archive"])
    labels = {"A": "xmm", "N": "csc", "R": "swift"}
    hit = {x: F.col("archive") == f for f, x in labels.items()}
    agg = agg.groupBy("ra", "dec").agg(
        *[F.max(F.when(c, F.col("n_in_cone"))).alias(f"{x}_n") for x, c in hit.items()],
        *[F.max(F.when(c, F.col("max_value"))).alias(f"{x}_flux") for x, c in hit.items()],
    )
    out = split_join(pts, agg, ["ra", "dec"], "left")
    found = [F.coalesce(F.col(f"{x}_n"), F.lit(0)).cast("long") for x in labels.values()]
    return out.select(
        "row_idx", *[f.alias(f"{x}_n") for f, x in zip(found, labels.values())],
        *[(f > 0).alias(f"{x}_detected") for f, x in zip(found, labels.values())],
        *[f"{x}_flux" for x in labels.values()],
        (sum(found[1:], found[0]) > 0).alias("any_xray"),
    )


def positional_dedup(spark, sf):
    out = sky.greedy_dedup(stacked_sources(spark, sf), 5.0, "ord", "cat")
    return out.select("ord", F.col("labels").alias("catalogues"), F.col("n_close").cast("long").alias("n_close"))


def iau_coordinate(spark, sf):
    df = coords.with_j_position(source_names(spark, sf), "query_name")
    return df.where("j IS NOT NULL").select(
        "src", rnd(F.col("j.ra"), 6).alias("ra"), rnd(F.col("j.dec"), 6).alias("dec"),
        rnd(F.col("j.precision"), 3).alias("precision"),
    )


def coordinate_candidates(spark, sf):
    df = coords.with_plain_candidates(source_names(spark, sf), "query_name", "cs").select(
        "src", F.posexplode("cs").alias("i", "c")
    )
    return df.select(
        "src", F.col("i").cast("long").alias("i"), rnd(F.col("c.ra"), 6).alias("ra"),
        rnd(F.col("c.dec"), 6).alias("dec"), F.col("c.label").alias("label"),
    )


def sexagesimal(spark, sf):
    """Positions written in three styles read back to degrees; blanks dropped."""
    s = _with_digits(sources(spark, sf))
    sec = F.format_string("%.3f", _mod(F.col("ra") / 15.0 * 3600.0, 60.0))
    hms, dms = ["hh", "mm", "sec"], ["d2", "dm", "ds"]
    style = F.col("src") % 4
    ra_t = F.when(style == 0, F.concat_ws(" ", *hms)).when(style == 1, F.concat_ws(":", *hms)).when(
        style == 2, F.col("ra").cast("string")).otherwise("--")
    de_t = F.when(style == 0, F.concat("sign", F.concat_ws(" ", *dms))).when(
        style == 1, F.concat("sign", F.concat_ws(":", *dms))).when(style == 2, F.col("dec").cast("string")).otherwise(" N/A ")
    s = s.withColumn("sec", sec).select("src", ra_t.alias("ra_t"), de_t.alias("de_t"))
    df = coords.with_position(s, "ra_t", "de_t").where("ra IS NOT NULL AND dec IS NOT NULL")
    return df.select("src", rnd(F.col("ra"), 7).alias("ra"), rnd(F.col("dec"), 6).alias("dec"))


def _classified(spark, sf):
    return cl.classify(source_names(spark, sf), catalogs(spark, sf), name_index(spark, sf))


def classify_sources(spark, sf):
    return _classified(spark, sf).select(
        "src", "query_name", rnd(F.col("resolved_ra"), 6).alias("resolved_ra"),
        rnd(F.col("resolved_dec"), 6).alias("resolved_dec"), "xrb_type", "compact_object", "matched_catalog",
        rnd(F.col("match_separation_arcsec"), 4).alias("match_separation_arcsec"), "simbad_otype",
        "confidence", "resolution",
    )


def class_summary(spark, sf):
    """Counts by type, by object and by confidence in one pass."""
    df = _classified(spark, sf)
    pairs = F.explode(F.array(*[
        F.struct(F.lit(n).alias("what"), F.col(n).alias("value")) for n in ("xrb_type", "compact_object", "confidence")
    ]))
    return df.select(pairs.alias("p")).groupBy("p.what", "p.value").agg(F.count("*").alias("n"))


QUERIES = {
    "cone_nearest": cone_nearest,
    "cone_nearest_stored": cone_nearest_stored,
    "cone_best_catalog": cone_best_catalog,
    "cone_archives": cone_archives,
    "positional_dedup": positional_dedup,
    "iau_coordinate": iau_coordinate,
    "coordinate_candidates": coordinate_candidates,
    "sexagesimal": sexagesimal,
    "classify_sources": classify_sources,
    "class_summary": class_summary,
}


def pos(k: str, dra: str = "0.0", ddec: str = "0.0") -> str:
    def mod(a, m):
        return f"(({a}) - {m} * floor(({a}) / {m}))"
    ra = mod(f"{k} * {GOLDEN_DEG}e0 + {dra}", "360.0")
    frac = mod(f"{k} * {GOLDEN_FRAC}e0", "1.0")
    return f"({ra}) AS ra, degrees(asin(2.0 * {frac} - 1.0)) + {ddec} AS dec"


def sep(a: str, b: str) -> str:
    return (
        f"(2.0 * asin(sqrt(least(1.0, pow(sin(radians({b}.dec - {a}.dec) / 2), 2) + cos(radians({a}.dec)) * "
        f"cos(radians({b}.dec)) * pow(sin(radians({b}.ra - {a}.ra) / 2), 2)))) * 206264.80624709636)"
    )


def sepc(a_ra, a_de, b_ra, b_de):
    return (
        f"(2.0 * asin(sqrt(least(1.0, pow(sin(radians({b_de} - {a_de}) / 2), 2) + cos(radians({a_de})) * "
        f"cos(radians({b_de})) * pow(sin(radians({b_ra} - {a_ra}) / 2), 2)))) * 206264.80624709636)"
    )


SRC = f"src AS (SELECT c_custkey AS src, {pos('c_custkey', '(c_custkey % 7) / 3600.0', '(c_custkey % 41 - 20) / 3600.0')} FROM customer)"
PARTS = f"parts AS (SELECT p_partkey AS row_idx, {pos('p_partkey')} FROM part)"
CATS = f"""
cats AS (
  SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'watchdog_bhxb' ELSE 'blackcat_bh' END AS cat, s_suppkey % 2 AS priority,
         s_suppkey AS row_idx, {pos('(s_suppkey * 3)')},
         CASE WHEN s_suppkey % 2 = 1 THEN CASE WHEN s_nationkey % 3 = 0 THEN 'HMXB' ELSE 'LMXB' END END AS type,
         NULL AS ppulse, NULL AS msp, NULL AS xtype FROM supplier
  UNION ALL
  SELECT CASE WHEN p_partkey % 2 = 0 THEN 'lmxb_xrbcats' ELSE 'hmxb_heasarc' END, 2 + p_partkey % 2, p_partkey,
         {pos('p_partkey')}, NULL,
         CASE p_size % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN '--' END,
         CASE WHEN p_partkey % 2 = 0 AND p_size % 9 = 0 THEN '1' END,
         CASE p_type WHEN 'PROMO' THEN 'burster' WHEN 'STANDARD' THEN 'BH cand' ELSE '' END FROM part)"""


def dig(x: str, w: int) -> str:
    return f"lpad(CAST(CAST(floor({x}) AS BIGINT) AS VARCHAR), {w}, '0')"


def m60(x: str, m: str = "60.0") -> str:
    return f"(({x}) - {m} * floor(({x}) / {m}))"


HH, MM = dig("ra / 15.0", 2), dig(m60("ra / 15.0 * 60.0"), 2)
SS, TT = dig(m60("ra / 15.0 * 3600.0"), 2), dig(m60("ra / 15.0 * 36000.0", "10.0"), 1)
SG = "CASE WHEN dec < 0 THEN '-' ELSE '+' END"
D3, D2 = dig("abs(dec) * 10.0", 3), dig("abs(dec)", 2)
D6 = f"{D2} || {dig(m60('abs(dec) * 60.0'), 2)} || {dig(m60('abs(dec) * 3600.0'), 2)}"
LOST = "(src % 4 = 2 AND src % 3 = 0)"
PL = f"CASE WHEN src % 8 = 2 THEN {D3} ELSE {D2} END"
NAMES = f"""
nbase AS (SELECT c_custkey AS src, {pos('c_custkey')} FROM customer),
names AS (
  SELECT src, CASE src % 4 WHEN 0 THEN 'MAXI J' || {HH} || {MM} || {SG} || {D3}
     WHEN 1 THEN 'RX J' || {HH} || {MM} || {SS} || '.' || {TT} || {SG} || {D6}
     WHEN 2 THEN '4U ' || {HH} || {MM} || CASE WHEN {LOST} THEN '+' ELSE {SG} END || {PL}
     ELSE 'Src ' || src END AS query_name,
     CASE WHEN {LOST} THEN '4U ' || {HH} || {MM} || '-' || {PL} END AS query_name_alt
  FROM nbase)"""
INDEX = f"""
ibase AS (SELECT p_partkey AS pos, CASE p_partkey % 5 WHEN 0 THEN 'LXB' WHEN 1 THEN 'HXB' WHEN 2 THEN 'Pulsar'
                 WHEN 3 THEN 'BH XB' END AS otype, {pos('(p_partkey + 7)', '0.0', '0.02')} FROM part),
idx AS (SELECT CASE WHEN pos % 3 = 0 THEN '4U ' || {HH} || {MM} || {SG} || {D2} || CASE WHEN pos % 2 = 0 THEN '0' ELSE '3' END
               ELSE 'Src ' || pos END AS name, 'id' || pos AS main_id, ra, dec, otype, pos FROM ibase)"""
# readings of a name as positions
JPAT = r"'J(\d{4,6}(?:\.\d+)?)([+-])(\d{2,6}(?:\.\d+)?)'"
PPAT = r"'(\d{2})(\d{2}(?:\.\d+)?)\s*([+-])(\d{2,3}(?:\.\d+)?)\s*$'"


def jpos(src: str, name: str, out: str) -> str:
    """Names here have RA blocks HHMM or HHMMSS.s and Dec blocks DDd or DDMMSS."""
    return f"""
{out}0 AS (SELECT *, regexp_extract({name}, {JPAT}, 1) AS rb, regexp_extract({name}, {JPAT}, 2) AS sg,
                 regexp_extract({name}, {JPAT}, 3) AS db FROM {src}),
{out}1 AS (
  SELECT *, CASE WHEN length(split_part(rb, '.', 1)) = 4 THEN CAST(substr(rb, 1, 2) AS DOUBLE) + CAST(substr(rb, 3) AS DOUBLE) / 60.0
              ELSE CAST(substr(rb, 1, 2) AS DOUBLE) + CAST(substr(rb, 3, 2) AS DOUBLE) / 60.0 + CAST(substr(rb, 5) AS DOUBLE) / 3600.0 END AS h,
         CASE WHEN length(db) = 3 THEN CAST(substr(db, 1, 2) AS DOUBLE) + CAST(substr(db, 3, 1) AS DOUBLE) / 10.0
              ELSE CAST(substr(db, 1, 2) AS DOUBLE) + CAST(substr(db, 3, 2) AS DOUBLE) / 60.0 + CAST(substr(db, 5, 2) AS DOUBLE) / 3600.0 END AS d,
         CASE WHEN length(split_part(rb, '.', 1)) = 4 THEN 60.0 ELSE 0.1 END AS rstep,
         CASE WHEN length(db) = 3 THEN 360.0 ELSE 1.0 END AS dstep
  FROM {out}0 WHERE rb <> ''),
{out} AS (SELECT * EXCLUDE (rb, sg, db, h, d, rstep, dstep), h * 15.0 AS ra, CASE WHEN sg = '-' THEN -d ELSE d END AS dec,
          greatest(abs(rstep * 15.0 * cos(radians(d))), dstep) AS precision FROM {out}1)"""


def ppos(src: str, name: str, out: str) -> str:
    """Readings of catalog names: i, ra, dec, label."""
    return f"""
{out}0 AS (SELECT *, CAST(regexp_extract({name}, {PPAT}, 1) AS DOUBLE) AS hh, CAST(regexp_extract({name}, {PPAT}, 2) AS DOUBLE) AS mm,
          CASE WHEN regexp_extract({name}, {PPAT}, 3) = '-' THEN -1.0 ELSE 1.0 END AS sg,
          regexp_extract({name}, {PPAT}, 4) AS dd FROM {src} WHERE regexp_matches({name}, {PPAT})),
{out}1 AS (
  SELECT *, 0 AS i, sg * CAST(dd AS DOUBLE) AS dec, 'whole-degree' AS label FROM {out}0 WHERE length(dd) = 2
  UNION ALL SELECT *, 0, sg * CAST(dd AS DOUBLE) / 10.0, 'tenths-of-degree' FROM {out}0 WHERE length(dd) = 3
  UNION ALL SELECT *, CASE WHEN CAST(dd AS DOUBLE) / 10.0 <= 90 THEN 1 ELSE 0 END, sg * CAST(substr(dd, 1, 2) AS DOUBLE),
            'whole-degree-truncated' FROM {out}0 WHERE length(dd) = 3),
{out} AS (SELECT * EXCLUDE (hh, mm, sg, dd), m AS ra FROM (SELECT *, (hh + mm / 60.0) * 15.0 AS m0,
          ((hh + mm / 60.0) * 15.0) - 360.0 * floor(((hh + mm / 60.0) * 15.0) / 360.0) AS m FROM {out}1)
          WHERE abs(dec) <= 90 AND hh <= 24 AND mm <= 60)"""


NEAR_ALL = """
hit AS (
  SELECT c.*, k.ra AS k_ra, k.dec AS k_dec, {sep} AS sep,
         row_number() OVER (PARTITION BY c.src, c.which, c.step, c.i ORDER BY {sep}, k.priority, k.row_idx) AS rn
  FROM cand c JOIN cats k ON abs(k.dec - c.dec) <= 0.17 AND {sep} <= 600.0)""".format(sep=sep("c", "k"))
CLASSIFY = [
    """rd AS (SELECT src, 0 AS which, query_name AS name FROM names UNION ALL
       SELECT src, 1, query_name_alt FROM names WHERE query_name_alt IS NOT NULL)""",
    jpos("rd", "name", "jp"),
    ppos("(SELECT * FROM rd WHERE NOT EXISTS (SELECT 1 FROM jp WHERE jp.src = rd.src AND jp.which = rd.which AND jp.precision <= 10.0))", "name", "pp"),
    """cand AS (SELECT src, which, 1 AS step, 0 AS i, ra, dec, 'name, confirmed' AS how FROM jp WHERE precision > 10.0
       UNION ALL SELECT src, which, 2, i, ra, dec, label FROM pp)""",
    NEAR_ALL,
    """dcand AS (SELECT src, which, 0 AS step, 0.0 AS s, 0 AS i, ra, dec, 'name' AS how FROM jp WHERE precision <= 10.0
       UNION ALL SELECT src, which, step, CASE WHEN step = 2 THEN sep ELSE 0.0 END, i, k_ra, k_dec, how FROM hit WHERE rn = 1)""",
    "direct AS (SELECT DISTINCT ON (src) src, ra, dec, how FROM dcand ORDER BY src, which, step, s, i)",
    "ur AS (SELECT rd.* FROM rd WHERE src NOT IN (SELECT src FROM direct))",
    "ent AS (SELECT DISTINCT ON (name) name, ra, dec FROM idx ORDER BY name, pos)",
    f"""uh AS (SELECT j.src, j.which, x.ra, x.dec,
         row_number() OVER (PARTITION BY j.src, j.which ORDER BY {sep('j', 'x')}, x.pos) AS rn,
         {sep('j', 'x')} <= least(greatest(j.precision, 15.0), 600.0) AS ok
       FROM jp j JOIN idx x ON abs(x.dec - j.dec) <= 0.17 AND {sep('j', 'x')} <= 600.0
       WHERE j.src NOT IN (SELECT src FROM direct))""",
    r"""vs AS (SELECT src, which, name, regexp_extract(name, '^(.*?\D)(\d{2})(\d{2}(?:\.\d+)?)\s*([+-])(\d{2,3}(?:\.\d+)?)\s*$',
         ['a', 'b', 'c', 'd', 'e']) AS p FROM ur WHERE regexp_matches(name, '^(.*?\D)(\d{2})(\d{2}(?:\.\d+)?)\s*([+-])(\d{2,3}(?:\.\d+)?)\s*$')),
vt AS (SELECT src, which, name, p.a || p.b || p.c || p.d AS st, p.e AS dd, substr(p.e, 1, 2) AS d2 FROM vs),
va AS (SELECT src, which, 10 AS i, st || d2 AS alias, name, false AS wild FROM vt
  UNION ALL SELECT src, which, 11, st || d2, name, true FROM vt
  UNION ALL SELECT src, which, 12, st || CASE WHEN length(dd) = 3 THEN dd ELSE d2 || '0' END, name, false FROM vt
  UNION ALL SELECT src, which, 13, st || d2 || '5', name, false FROM vt WHERE length(dd) = 2)""",
    """wl AS (SELECT va.src, va.which, va.i, count(DISTINCT main_id) AS n, arg_min(idx.ra, idx.pos) AS ra, arg_min(idx.dec, idx.pos) AS dec
       FROM va JOIN idx ON starts_with(idx.name, va.alias) WHERE wild GROUP BY 1, 2, 3)""",
    """ucand AS (SELECT src, which, 0 AS step, 0 AS i, e.ra, e.dec, 'index, exact' AS how FROM ur JOIN ent e USING (name)
       UNION ALL SELECT src, which, 1, 0, ra, dec, 'index, cone' FROM uh WHERE rn = 1 AND ok
       UNION ALL SELECT src, which, 2, i, e.ra, e.dec, 'index, alias' FROM va JOIN ent e ON e.name = va.alias WHERE NOT wild AND alias <> va.name
       UNION ALL SELECT src, which, 2, i, ra, dec, 'index, wildcard' FROM wl WHERE n = 1)""",
    """placed AS (SELECT * FROM direct UNION ALL
       SELECT * FROM (SELECT DISTINCT ON (src) src, ra, dec, how FROM ucand ORDER BY src, which, step, i))""",
    f"""mt AS (SELECT p.src, k.cat, k.type, k.ppulse, k.msp, k.xtype, {sep('p', 'k')} AS sep,
         row_number() OVER (PARTITION BY p.src, k.cat ORDER BY {sep('p', 'k')}, k.row_idx) AS rn
       FROM placed p JOIN cats k ON abs(k.dec - p.dec) <= 0.003 AND {sep('p', 'k')} <= 10.0)""",
    "m1 AS (SELECT * FROM mt WHERE rn = 1)",
    f"""ot AS (SELECT p.src, x.otype, row_number() OVER (PARTITION BY p.src ORDER BY {sep('p', 'x')}, x.pos) AS rn
       FROM placed p JOIN idx x ON abs(x.dec - p.dec) <= 0.003 AND {sep('p', 'x')} <= 10.0)""",
    "on1 AS (SELECT DISTINCT ON (name) name, otype FROM idx ORDER BY name, pos)",
    """w AS (
  SELECT n.src, n.query_name, p.ra, p.dec, p.how, wd.sep AS wds, bc.sep AS bcs, bc.type AS bct, lm.sep AS lms, hm.sep AS hms,
         lm.ppulse AS lp, lm.msp AS lf, lm.xtype AS lx, hm.ppulse AS hp, hm.xtype AS hx,
         CASE WHEN p.ra IS NOT NULL AND wd.sep IS NULL AND bc.sep IS NULL AND lm.sep IS NULL AND hm.sep IS NULL
              THEN coalesce(ot.otype, on1.otype) END AS otype
  FROM names n LEFT JOIN placed p USING (src)
  LEFT JOIN m1 wd ON wd.src = n.src AND wd.cat = 'watchdog_bhxb' LEFT JOIN m1 bc ON bc.src = n.src AND bc.cat = 'blackcat_bh'
  LEFT JOIN m1 lm ON lm.src = n.src AND lm.cat = 'lmxb_xrbcats' LEFT JOIN m1 hm ON hm.src = n.src AND hm.cat = 'hmxb_heasarc'
  LEFT JOIN ot ON ot.src = n.src AND ot.rn = 1 LEFT JOIN on1 ON on1.name = n.query_name)""",
    """ev AS (
  SELECT *, wds IS NOT NULL OR bcs IS NOT NULL AS bh, hms IS NOT NULL AND (lms IS NULL OR hms <= lms) AS ishm,
         coalesce(lower(lp) NOT IN ('', '--', 'nan', 'none', 'masked'), false) OR coalesce(lf = '1', false) OR lx = 'burster' AS lns,
         coalesce(lx = 'BH cand', false) AS lbh,
         coalesce(lower(hp) NOT IN ('', '--', 'nan', 'none', 'masked'), false) AS hns, coalesce(hx = 'BH cand', false) AS hbh,
         upper(coalesce(otype, '')) AS up FROM w)""",
    """res AS (
  SELECT src, query_name, ra, dec, how, otype,
         CASE WHEN ishm THEN 'HMXB' WHEN lms IS NOT NULL THEN 'LMXB'
              WHEN bh THEN CASE WHEN wds IS NULL AND bct = 'HMXB' THEN 'HMXB' ELSE 'LMXB' END
              WHEN contains(up, 'HXB') THEN 'HMXB' WHEN contains(up, 'LXB') THEN 'LMXB' ELSE 'Unknown' END AS xrb_type,
         CASE WHEN bh THEN 'BH'
              WHEN ishm THEN CASE WHEN hns AND NOT hbh THEN 'NS' WHEN hbh AND NOT hns THEN 'BH' ELSE 'Unknown' END
              WHEN lms IS NOT NULL THEN CASE WHEN lns AND lbh THEN 'Unknown' WHEN lbh THEN 'BH' ELSE 'NS' END
              WHEN contains(up, 'PSR') OR contains(up, 'PULSAR') THEN 'NS' WHEN contains(up, 'BH') THEN 'BH'
              ELSE 'Unknown' END AS compact_object,
         CASE WHEN ishm THEN 'hmxb_heasarc' WHEN lms IS NOT NULL THEN 'lmxb_xrbcats' WHEN wds IS NOT NULL THEN 'watchdog_bhxb'
              WHEN bcs IS NOT NULL THEN 'blackcat_bh' WHEN ra IS NOT NULL THEN 'SIMBAD (fallback)' ELSE 'None' END AS matched_catalog,
         CASE WHEN ishm THEN hms WHEN lms IS NOT NULL THEN lms WHEN bh THEN coalesce(wds, bcs) END AS msep,
         CASE WHEN bh THEN 'high' WHEN ishm AND hns = hbh THEN 'medium' WHEN ishm OR lms IS NOT NULL THEN 'high' ELSE 'low' END AS confidence
  FROM ev)""",
]
STACK = f"""
pts AS (
  SELECT c_custkey AS ord, 'HMXB_A' AS cat, {pos('floor(c_custkey / 3.0)', '0.0', '(c_custkey % 3) * 3.0 / 3600.0')} FROM customer
  UNION ALL SELECT 1000000000000 + s_suppkey, 'HMXB_B', {pos('floor(s_suppkey / 3.0)', '2.0 / 3600.0', '(s_suppkey % 3) * 3.0 / 3600.0')} FROM supplier
  UNION ALL SELECT 2000000000000 + p_partkey, 'LMXB_C', {pos('floor(p_partkey / 3.0)', '1.0 / 3600.0', '(p_partkey % 3) * 3.0 / 3600.0')} FROM part)"""

ORACLE = {
    "cone_nearest": with_(
        SRC, PARTS,
        f"""m AS (SELECT s.src, p.row_idx, {sep('s', 'p')} AS sep,
           row_number() OVER (PARTITION BY s.src ORDER BY {sep('s', 'p')}, p.row_idx) AS rn
           FROM src s JOIN parts p ON {sep('s', 'p')} <= 10.0)""",
    ) + f"SELECT s.src, row_idx, {r('sep', 4, 'sep')} FROM src s LEFT JOIN (SELECT * FROM m WHERE rn = 1) m USING (src)",
    "cone_best_catalog": with_(
        SRC, CATS,
        f"""m AS (SELECT s.src, k.cat, k.row_idx, {sep('s', 'k')} AS sep,
           row_number() OVER (PARTITION BY s.src ORDER BY {sep('s', 'k')}, k.priority, k.row_idx) AS rn
           FROM src s JOIN cats k ON {sep('s', 'k')} <= 600.0)""",
    ) + f"SELECT src, cat, row_idx, {r('sep', 4, 'sep')} FROM m WHERE rn = 1",
    "cone_archives": with_(
        PARTS,
        f"obs AS (SELECT {pos('l_partkey', '0.0', 'l_linenumber * 1.5 / 3600.0')}, l_extendedprice AS flux, l_returnflag AS f FROM lineitem)",
        f"""m AS (SELECT p.row_idx, o.f, o.flux FROM parts p JOIN obs o
           ON o.ra = p.ra AND abs(o.dec - p.dec) < 0.01 AND {sep('p', 'o')} <= 5.0)""",
        """g AS (SELECT row_idx, count(*) FILTER (WHERE f = 'A') AS xn, count(*) FILTER (WHERE f = 'N') AS cn,
           count(*) FILTER (WHERE f = 'R') AS sn, max(flux) FILTER (WHERE f = 'A') AS xf, max(flux) FILTER (WHERE f = 'N') AS cf,
           max(flux) FILTER (WHERE f = 'R') AS sf FROM m GROUP BY row_idx)""",
    ) + """SELECT row_idx, coalesce(xn, 0) AS xmm_n, coalesce(cn, 0) AS csc_n, coalesce(sn, 0) AS swift_n,
  coalesce(xn, 0) > 0 AS xmm_detected, coalesce(cn, 0) > 0 AS csc_detected, coalesce(sn, 0) > 0 AS swift_detected,
  xf AS xmm_flux, cf AS csc_flux, sf AS swift_flux,
  coalesce(xn, 0) + coalesce(cn, 0) + coalesce(sn, 0) > 0 AS any_xray FROM parts LEFT JOIN g USING (row_idx)""",
    "positional_dedup": "WITH RECURSIVE " + with_(
        STACK,
        f"nr AS (SELECT a.ord AS i, b.ord AS j, b.cat FROM pts a JOIN pts b ON abs(a.dec - b.dec) < 0.0015 AND {sep('a', 'b')} < 5.0)",
        """st AS (
  SELECT ord, 0 AS status, 0 AS it FROM pts
  UNION ALL
  SELECT s.ord, CASE WHEN s.status <> 0 THEN s.status WHEN coalesce(n.rep, false) THEN 2
                     WHEN coalesce(n.used, true) THEN 1 ELSE 0 END, s.it + 1
  FROM st s LEFT JOIN (
    SELECT nr.i, bool_or(t.status = 1) AS rep, bool_and(t.status = 2) AS used
    FROM nr JOIN st t ON t.ord = nr.j WHERE nr.j < nr.i GROUP BY nr.i) n ON n.i = s.ord
  WHERE EXISTS (SELECT 1 FROM st WHERE status = 0))""",
        "reps AS (SELECT ord FROM st WHERE status = 1 AND it = (SELECT max(it) FROM st))",
        "lb AS (SELECT ord, cat, min(j) AS o, count(*) AS n FROM reps JOIN nr ON nr.i = ord GROUP BY ord, cat)",
    )[len("WITH "):] + "SELECT ord, string_agg(cat, '|' ORDER BY o) AS catalogues, CAST(sum(n) AS BIGINT) AS n_close FROM lb GROUP BY ord",
    "iau_coordinate": with_(NAMES, jpos("names", "query_name", "jp"))
    + f"SELECT src, {r('ra', 6, 'ra')}, {r('dec', 6, 'dec')}, {r('precision', 3, 'precision')} FROM jp",
    "coordinate_candidates": with_(NAMES, ppos("names", "query_name", "pp"))
    + f"SELECT src, CAST(i AS BIGINT) AS i, {r('ra', 6, 'ra')}, {r('dec', 6, 'dec')}, label FROM pp",
    "sexagesimal": with_(SRC) + """
SELECT src, round(CASE WHEN src % 4 = 2 THEN ra ELSE round(ra / 15.0 * 3600.0, 3) / 240.0 END, 7) + 0.0 AS ra,
       round(CASE WHEN src % 4 = 2 THEN dec ELSE sign(dec) * floor(abs(dec) * 3600.0) / 3600.0 END, 6) + 0.0 AS dec
FROM src WHERE src % 4 <> 3""",
    "classify_sources": with_(NAMES, CATS, INDEX, *CLASSIFY) + f"""
SELECT src, query_name, {r('ra', 6, 'resolved_ra')}, {r('dec', 6, 'resolved_dec')}, xrb_type, compact_object, matched_catalog,
       {r('msep', 4, 'match_separation_arcsec')}, otype AS simbad_otype, confidence, coalesce(how, 'unresolved') AS resolution FROM res""",
    "class_summary": with_(NAMES, CATS, INDEX, *CLASSIFY) + """
SELECT 'xrb_type' AS what, xrb_type AS value, count(*) AS n FROM res GROUP BY 2
UNION ALL SELECT 'compact_object', compact_object, count(*) FROM res GROUP BY 2
UNION ALL SELECT 'confidence', confidence, count(*) FROM res GROUP BY 2""",
}
ORACLE["cone_nearest_stored"] = ORACLE["cone_nearest"]
