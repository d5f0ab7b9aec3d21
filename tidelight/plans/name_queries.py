"""File-name parsing, keys, variants, HTML and JSON extraction, first-wins picks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coords, names
from ..functions.expr import rnd
from ..operators.skew import first_per_key
from ..sources import html
from ..sources.tables import table
from .sqltext import with_


def file_names(spark, sf):
    """Eleven naming styles over the part table."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    ra4 = F.lpad((k % 2400).cast("string"), 4, "0")
    d3 = F.lpad(F.col("p_size").cast("string"), 3, "0")
    pm = F.when(k % 2 == 1, "p").otherwise("m")
    style = k % 11
    text = (
        F.when(style == 0, F.concat(F.lit("MAXI_J"), ra4, pm, d3, F.lit("_maxi_lc.csv")))
        .when(style == 1, F.concat(F.lit("4U"), ra4, F.lit("_"), d3, F.lit("_ztf.csv")))
        .when(style == 2, F.concat(F.lit("RJ"), ra4, F.lit(".9+"), d3, F.lit("_maxi")))
        .when(style == 3, F.concat(F.lit("SCO_X-"), k.cast("string"), F.lit("_maxi.csv")))
        .when(style == 4, F.concat(F.lit("LMC_X"), k.cast("string"), F.lit("A_bat_lc.txt")))
        .when(style == 5, F.concat(F.lit("V"), ra4, F.lit("+"), d3, F.lit("_maxi.dat")))
        .when(style == 6, F.concat(F.lit("data/swift_J"), ra4, F.lit("_"), d3, F.lit("_xrt_lc.fits")))
        .when(style == 7, F.concat(F.lit("1RXSJ"), ra4, pm, d3, F.lit("_ATLAS.csv")))
        .when(style == 8, F.concat(F.lit("J"), ra4, pm, d3, F.lit("_gsc_lc.lc")))
        .when(style == 9, F.concat(F.lit("odd_Name"), k.cast("string"), F.lit(".json")))
        .otherwise(F.concat(F.lit("1A"), ra4, F.lit("-"), d3, F.lit("_bat.csv")))
    )
    return p.select(k.alias("row_id"), text.alias("file"))


def parse_name(spark, sf):
    df = names.parse_names(file_names(spark, sf), "file")
    return df.select(
        "row_id", "core_identifier", "query_name", "query_name_alt", "source_key", "band", "instrument",
        "confidence", "sign_ambiguous",
    )


def parse_curve_file(spark, sf):
    df = names.parse_curve_file(file_names(spark, sf), "file")
    return df.select("row_id", "source", "instrument", "file_stem")


def canonical_key(spark, sf):
    n = F.col("file")
    return file_names(spark, sf).select(
        "row_id", names.canonical_key(n).alias("ckey"), names.signed_key(n).alias("skey"),
        names.safe_id(n).alias("safe"), names.safe_id(n, signs=True).alias("safe_signed"),
    )


def name_variants(spark, sf):
    raw = F.concat(F.lit("4U "), F.lpad((F.col("p_partkey") % 2400).cast("string"), 4, "0"),
                   F.when(F.col("p_partkey") % 3 == 0, " +").otherwise("-"),
                   F.when(F.col("p_size") % 2 == 0, F.lpad(F.col("p_size").cast("string"), 2, "0"))
                   .otherwise(F.lpad(F.col("p_size").cast("string"), 3, "0")))
    df = table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), raw.alias("name"))
    df = df.select("row_id", F.posexplode(names.name_variants(F.col("name"))).alias("i", "v"))
    return df.select("row_id", F.col("i").cast("long").alias("i"), F.col("v.name").alias("variant"), F.col("v.wildcard").alias("wildcard"))


def slug_variants(spark, sf):
    n = F.concat(F.when(F.col("p_size") % 2 == 0, "3MAXI ").otherwise("maxi  "), F.lit("J"),
                 F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 5 == 0, " x").otherwise("-05"))
    df = table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), names.url_slug(n).alias("slug"))
    return df.select("row_id", F.posexplode(names.slug_variants(F.col("slug"))).alias("i", "variant")).select(
        "row_id", F.col("i").cast("long").alias("i"), "variant"
    )


def rate_limit_wait(spark, sf):
    k = F.col("o_orderkey")
    msg = (
        F.when(k % 3 == 0, F.concat(F.lit("Request throttled, available in "), (k % 90).cast("string"), F.lit(" seconds")))
        .when(k % 3 == 1, F.concat(F.lit("Expected available in "), (k % 7).cast("string"), F.lit(" minutes")))
        .otherwise("busy")
    )
    return table(spark, sf, "orders").select(k.alias("row_id"), names.wait_seconds(msg).alias("wait"))


def html_links(spark, sf):
    """Anchors with their target's parent folder, ASCII text and name-coded position."""
    df = html.anchors(table(spark, sf, "pages"), "page_id", "html")
    df = df.withColumn("j", coords.short_j_position(F.col("text")))
    return df.select(
        "page_id", F.col("idx").cast("long").alias("idx"), "href", "target", "text",
        F.col("j").isNotNull().alias("has_position"),
    )


def short_positions(spark, sf):
    """Positions that short names give, as columns: hours, minutes and a declination with tenths."""
    k = F.col("p_partkey")
    name = F.concat(
        F.lit("MAXI J"), F.lpad((k % 2500).cast("string"), 4, "0"), F.when(k % 2 == 1, "+").otherwise("-"), F.lpad((k * 7 % 950).cast("string"), 3, "0"))
    df = table(spark, sf, "part").select(k.alias("row_id"), name.alias("name")).withColumn("j", coords.short_j_position(F.col("name")))
    return df.where("j IS NOT NULL").select("row_id", "name", rnd(F.col("j.ra"), 6).alias("ra"), rnd(F.col("j.dec"), 6).alias("dec"))


def html_catalog(spark, sf):
    """First anchor per text over all pages, in page order."""
    df = html.anchors(table(spark, sf, "pages"), "page_id", "html")
    df = df.withColumn("source_id", F.when(F.col("text") != "", F.col("text")).otherwise(F.concat(F.lit("MAXI "), "target")))
    order = F.struct("page_id", "idx")
    return first_per_key(df, ["source_id"], order).select(
        "source_id", "target", "page_id", F.col("idx").cast("long").alias("idx")
    )


def json_field(spark, sf):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf, "events").groupBy(k.alias("k")).agg(
        F.count("*").alias("n"), rnd(F.avg("value"), 6).alias("mean_value")
    )


def first_wins_dedup(spark, sf):
    """First lineitem per (part, supplier) in order key, line order."""
    li = table(spark, sf, "lineitem")
    cols = li.select("l_partkey", "l_suppkey", "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_extendedprice", "l_quantity")
    return first_per_key(
        cols, ["l_partkey", "l_suppkey"], F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    ).select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")


def discovery(spark, sf):
    """One file per source key, the first pattern in a fixed order wins."""
    from ..sources.discovery import OPTICAL_PATTERNS, first_pattern
    k = F.col("p_partkey")
    ends = ["_ztf.csv", "_atlas.csv", "_OPT.csv", "_ztf_lc.csv", "_maxi.csv", "_optical.csv"]
    end = F.element_at(F.array(*[F.lit(e) for e in ends]), (k % 6 + 1).cast("int"))
    path = F.concat(F.lit("in/S"), (k % 97).cast("string"), end)
    files = table(spark, sf, "part").select(path.alias("path")).distinct()
    return first_pattern(files, "path", OPTICAL_PATTERNS)


def label_counts(spark, sf):
    """Free-text class labels normalised and counted."""
    label = F.when(F.col("p_type") == "PROMO", "black hole").when(F.col("p_type") == "ECONOMY", "Neutron star").when(
        F.col("p_type") == "STANDARD", "ns?").otherwise(F.col("p_type"))
    return table(spark, sf, "part").groupBy(names.class_label(label).alias("label")).agg(F.count("*").alias("n"))


QUERIES = {
    "parse_name": parse_name,
    "parse_curve_file": parse_curve_file,
    "canonical_key": canonical_key,
    "name_variants": name_variants,
    "slug_variants": slug_variants,
    "rate_limit_wait": rate_limit_wait,
    "html_links": html_links,
    "short_positions": short_positions,
    "html_catalog": html_catalog,
    "json_field": json_field,
    "first_wins_dedup": first_wins_dedup,
    "discovery": discovery,
    "label_counts": label_counts,
}

RA4, P3 = "lpad(CAST(p_partkey % 2400 AS VARCHAR), 4, '0')", "lpad(CAST(p_size AS VARCHAR), 3, '0')"
PM = "CASE WHEN p_partkey % 2 = 1 THEN 'p' ELSE 'm' END"
FILES = f"""
files AS (
  SELECT p_partkey AS row_id, CASE p_partkey % 11
    WHEN 0 THEN 'MAXI_J' || {RA4} || {PM} || {P3} || '_maxi_lc.csv'
    WHEN 1 THEN '4U' || {RA4} || '_' || {P3} || '_ztf.csv'
    WHEN 2 THEN 'RJ' || {RA4} || '.9+' || {P3} || '_maxi'
    WHEN 3 THEN 'SCO_X-' || p_partkey || '_maxi.csv'
    WHEN 4 THEN 'LMC_X' || p_partkey || 'A_bat_lc.txt'
    WHEN 5 THEN 'V' || {RA4} || '+' || {P3} || '_maxi.dat'
    WHEN 6 THEN 'data/swift_J' || {RA4} || '_' || {P3} || '_xrt_lc.fits'
    WHEN 7 THEN '1RXSJ' || {RA4} || {PM} || {P3} || '_ATLAS.csv'
    WHEN 8 THEN 'J' || {RA4} || {PM} || {P3} || '_gsc_lc.lc'
    WHEN 9 THEN 'odd_Name' || p_partkey || '.json'
    ELSE '1A' || {RA4} || '-' || {P3} || '_bat.csv' END AS file FROM part)"""
SANDWICH = r"regexp_replace(regexp_replace({x}, '(\d)p(\d)', '\1+\2', 'g'), '(\d)m(\d)', '\1-\2', 'g')"
PARSE = r"""
st AS (SELECT row_id, regexp_replace(regexp_extract(file, '([^/]*)$', 1), '\.(csv|txt|dat|fits|lc|json)$', '', 'i') AS s FROM files),
sf AS (SELECT *, lower(regexp_extract(s, '(_maxi_lc|_maxi|_gsc_lc|_bat_lc|_bat|_xrt_lc|_xrt|_ztf_lc|_ztf|_atlas_lc|_atlas)$', 1, 'i')) AS e FROM st),
co AS (SELECT row_id, e, substr(s, 1, length(s) - length(e)) AS core,
         CASE WHEN e = '' THEN 'unknown' WHEN e LIKE '\_ztf%' ESCAPE '\' OR e LIKE '\_atlas%' ESCAPE '\' THEN 'optical' ELSE 'xray' END AS band,
         CASE WHEN e LIKE '%maxi%' OR e LIKE '%gsc%' THEN 'MAXI' WHEN e LIKE '%bat%' THEN 'SwiftBAT' WHEN e LIKE '%xrt%' THEN 'SwiftXRT'
              WHEN e LIKE '%ztf%' THEN 'ZTF' WHEN e LIKE '%atlas%' THEN 'ATLAS' ELSE 'unknown' END AS instrument FROM sf),
pf AS (SELECT *, CASE WHEN starts_with(upper(core), '1RXSJ') THEN '1RXS J' WHEN starts_with(upper(core), 'RJ') THEN 'RX J'
         WHEN contains(core, '_') AND list_contains(ms, upper(split_part(core, '_', 1)))
           THEN CASE WHEN upper(split_part(core, '_', 1)) = 'SWIFT' THEN 'Swift' ELSE upper(split_part(core, '_', 1)) END || ' '
         WHEN list_contains(ms, upper(regexp_extract(core, '^(\d?[A-Za-z]+)(\d.*)$', 1))) THEN upper(regexp_extract(core, '^(\d?[A-Za-z]+)(\d.*)$', 1)) || ' '
         END AS mission,
         CASE WHEN starts_with(upper(core), '1RXSJ') THEN substr(core, 6) WHEN starts_with(upper(core), 'RJ') THEN substr(core, 3)
         WHEN contains(core, '_') AND list_contains(ms, upper(split_part(core, '_', 1))) THEN substr(core, strpos(core, '_') + 1)
         WHEN list_contains(ms, upper(regexp_extract(core, '^(\d?[A-Za-z]+)(\d.*)$', 1))) THEN regexp_extract(core, '^(\d?[A-Za-z]+)(\d.*)$', 2)
         ELSE core END AS rest
       FROM (SELECT *, ['MAXI','XTE','IGR','SWIFT','GRS','GX','SAX','EXO','KS','GS','AX','OAO','MXB','4U','1E','H','A','1A','3A'] AS ms FROM co)),
sg AS (SELECT *, """ + SANDWICH.format(x="rest") + r""" AS c, mission IS NOT NULL OR regexp_matches(core, '^J?\d') AS cl FROM pf),
am AS (SELECT *, cl AND regexp_matches(c, '\d_\d') AS amb, NOT cl AND contains(core, '_') AND upper(core) = core AS prop FROM sg),
fin AS (SELECT *, CASE WHEN cl THEN regexp_replace(c, '(\d)_(\d)', '\1+\2', 'g') ELSE core END AS ident,
         list_aggregate(list_transform(string_split(core, '_'), lambda w: CASE WHEN upper(w) IN ('LMC', 'SMC') THEN upper(w) ELSE
           list_aggregate(list_transform(range(1, length(w) + 1), lambda i: CASE WHEN i = 1 OR NOT regexp_matches(substr(w, i - 1, 1), '[A-Za-z]')
             THEN upper(substr(w, i, 1)) ELSE lower(substr(w, i, 1)) END), 'string_agg', '') END), 'string_agg', ' ') AS ttl FROM am),
qn AS (SELECT *, CASE WHEN cl THEN coalesce(mission, '') || ident WHEN prop THEN ttl ELSE replace(core, '_', ' ') END AS qname FROM fin)"""
CURVE = r"""
cb AS (SELECT row_id, regexp_extract(file, '([^/]*)$', 1) AS b FROM files),
cs AS (SELECT *, CASE WHEN ends_with(lower(b), '_maxi_lc.csv') THEN substr(b, 1, length(b) - 12) WHEN ends_with(lower(b), '_maxi.csv') THEN substr(b, 1, length(b) - 9)
         WHEN ends_with(lower(b), '_ztf.csv') THEN substr(b, 1, length(b) - 8) ELSE regexp_replace(b, '^(.+)\.[^.]*$', '\1') END AS stem,
         CASE WHEN ends_with(lower(b), '_maxi_lc.csv') OR ends_with(lower(b), '_maxi.csv') THEN 'maxi' WHEN ends_with(lower(b), '_ztf.csv') THEN 'ztf' END AS inst FROM cb),
cm AS (SELECT row_id, stem, coalesce(inst, CASE WHEN contains(lower(stem), 'ztf') THEN 'ztf' ELSE 'maxi' END) AS instrument,
         regexp_extract(stem, '^(.*?)(J\d{4,6})([pm])(\d{2,4})', ['a', 'j', 's', 'd'], 'i') AS m FROM cs)"""
# split at the ends of anchors, then read the opening tag of each piece
ANCHOR = r"""
pc AS (SELECT page_id, unnest(range(1, len(s))) AS pos, unnest(s[:-2]) AS piece FROM (
    SELECT page_id, regexp_split_to_array(html, '(?i)</a\s*>') AS s FROM pages)),
op AS (SELECT page_id, pos, regexp_extract(piece, '(?is)<a\s(?:[^>]*?\s)?href\s*=[^>]*>', 0) AS tag,
         regexp_extract(piece, '(?is)<a\s(?:[^>]*?\s)?href\s*=[^>]*>(.*)$', 1) AS inner_html FROM pc),
an AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS idx,
         trim(regexp_extract(tag, '(?is)\shref\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), chr(34) || chr(39)) AS href,
         regexp_replace(inner_html, '<[^>]*>', '', 'g') AS raw FROM op WHERE tag <> ''),
al AS (SELECT page_id, idx, href, trim(regexp_replace(trim(raw), '[^\x00-\x7F]', '', 'g')) AS text,
         list_filter(string_split(href, '/'), lambda x: x <> '') AS p FROM an),
ah AS (SELECT page_id, idx, href, text, coalesce(CASE WHEN len(p) >= 2 THEN p[len(p) - 1] ELSE replace(p[1], '.html', '') END, '') AS target FROM al)"""

ORACLE = {
    "parse_name": with_(FILES, PARSE) + r"""
SELECT row_id, ident AS core_identifier, qname AS query_name,
       CASE WHEN amb THEN coalesce(mission, '') || regexp_replace(c, '(\d)_(\d)', '\1-\2', 'g') END AS query_name_alt,
       replace(replace(qname, ' ', '_'), '/', '-') AS source_key, band, instrument,
       CASE WHEN band = 'unknown' OR amb OR NOT (cl OR prop) THEN 'low' ELSE 'high' END AS confidence, amb AS sign_ambiguous FROM qn""",
    "parse_curve_file": with_(FILES, CURVE) + r"""
SELECT row_id, stem AS file_stem, instrument,
  trim(replace(trim(CASE WHEN m.j <> '' THEN rtrim(m.a, '_') || ' ' || m.j || CASE WHEN lower(m.s) = 'p' THEN '+' ELSE '-' END || m.d ELSE stem END), '_', ' ')) AS source FROM cm""",
    "canonical_key": with_(FILES) + r"SELECT row_id, upper(regexp_replace(" + SANDWICH.format(x="trim(file)")
    + r", '[\s_\-+]+', '', 'g')) AS ckey, upper(regexp_replace(" + SANDWICH.format(x="trim(file)")
    + r""", '[\s_]+', '', 'g')) AS skey, replace(replace(file, ' ', '_'), '/', '-') AS safe,
  replace(replace(replace(trim(file), ' ', '_'), '+', 'p'), '-', 'm') AS safe_signed FROM files""",
    "name_variants": r"""
WITH b AS (SELECT p_partkey AS row_id, '4U ' || lpad(CAST(p_partkey % 2400 AS VARCHAR), 4, '0') AS st,
             CASE WHEN p_partkey % 3 = 0 THEN ' +' ELSE '-' END AS sg,
             CASE WHEN p_size % 2 = 0 THEN lpad(CAST(p_size AS VARCHAR), 2, '0') ELSE lpad(CAST(p_size AS VARCHAR), 3, '0') END AS dd FROM part),
v AS (SELECT row_id, st || sg || dd AS name, st || trim(sg) AS pre, substr(dd, 1, 2) AS d2, dd FROM b),
u AS (SELECT row_id, name, 0 AS k, pre || d2 AS variant, false AS wildcard FROM v
  UNION ALL SELECT row_id, name, 1, pre || d2 || '*', true FROM v
  UNION ALL SELECT row_id, name, 2, pre || CASE WHEN length(dd) = 3 THEN dd ELSE d2 || '0' END, false FROM v
  UNION ALL SELECT row_id, name, 3, pre || d2 || '5', false FROM v WHERE length(dd) = 2)
SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY k) - 1 AS i, variant, wildcard FROM u WHERE wildcard OR variant <> name""",
    "slug_variants": r"""
WITH b AS (SELECT p_partkey AS row_id, CASE WHEN p_size % 2 = 0 THEN '3MAXI ' ELSE 'maxi  ' END || 'J' || p_partkey ||
             CASE WHEN p_size % 5 = 0 THEN ' x' ELSE '-05' END AS n FROM part),
s AS (SELECT row_id, replace(regexp_replace(n, '^(?:\d+)?MAXI\s*', '', 'i'), ' ', '') AS g FROM b),
u AS (SELECT row_id, 0 AS i, g AS variant FROM s
  UNION ALL SELECT row_id, 1, substr(g, 1, length(g) - 1) || (CAST(right(g, 1) AS INT) + 1) % 10 FROM s WHERE regexp_matches(g, '\d$')
  UNION ALL SELECT row_id, 2, substr(g, 1, length(g) - 1) || (CAST(right(g, 1) AS INT) + 9) % 10 FROM s WHERE regexp_matches(g, '\d$'))
SELECT row_id, CAST(i AS BIGINT) AS i, variant FROM u""",
    "rate_limit_wait": """
SELECT o_orderkey AS row_id, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 90 WHEN 1 THEN o_orderkey % 7 * 60 ELSE 10 END AS wait FROM orders""",
    "html_links": with_(ANCHOR) + r"""
SELECT page_id, idx, href, target, text, regexp_matches(text, 'J(\d{2})(\d{2})([+-]\d+)') AS has_position FROM ah""",
    "html_catalog": with_(ANCHOR) + """
SELECT DISTINCT ON (source_id) source_id, target, page_id, idx FROM (
  SELECT *, CASE WHEN text <> '' THEN text ELSE 'MAXI ' || target END AS source_id FROM ah) ORDER BY source_id, page_id, idx""",
    "json_field": """
SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(avg(value), 6) + 0.0 AS mean_value FROM events GROUP BY 1""",
    "first_wins_dedup": """
SELECT DISTINCT ON (l_partkey, l_suppkey) l_partkey, l_suppkey, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber
FROM lineitem ORDER BY l_partkey, l_suppkey, l_orderkey, l_linenumber, l_extendedprice, l_quantity""",
    "discovery": r"""
WITH f AS (SELECT DISTINCT 'in/S' || (p_partkey % 97) || ['_ztf.csv', '_atlas.csv', '_OPT.csv', '_ztf_lc.csv', '_maxi.csv', '_optical.csv'][p_partkey % 6 + 1] AS path FROM part),
b AS (SELECT path, regexp_extract(path, '([^/]*)$', 1) AS base FROM f),
p AS (SELECT path, regexp_replace(base, '(_atlas_lc|_atlas|_ztf_lc|_ztf|_opt_lc|_opt|_optical)\.csv$', '', 'i') AS source_key,
   CASE WHEN base LIKE '%\_atlas\_lc.csv' ESCAPE '\' THEN 0 WHEN base LIKE '%\_atlas.csv' ESCAPE '\' THEN 1 WHEN base LIKE '%\_ztf\_lc.csv' ESCAPE '\' THEN 2
     WHEN base LIKE '%\_ztf.csv' ESCAPE '\' THEN 3 WHEN base LIKE '%\_opt\_lc.csv' ESCAPE '\' THEN 4 WHEN base LIKE '%\_opt.csv' ESCAPE '\' THEN 5
     WHEN base LIKE '%\_optical.csv' ESCAPE '\' THEN 6 END AS pr FROM b)
SELECT DISTINCT ON (source_key) source_key, path, CAST(pr AS BIGINT) AS pattern FROM p WHERE pr IS NOT NULL ORDER BY source_key, pr, path""",
    "label_counts": """
SELECT CASE p_type WHEN 'PROMO' THEN 'BH' WHEN 'ECONOMY' THEN 'NS' WHEN 'STANDARD' THEN 'NS' ELSE 'UNKNOWN' END AS label, count(*) AS n FROM part GROUP BY 1""",
}
ORACLE["short_positions"] = """
WITH n AS (SELECT p_partkey AS row_id, lpad(CAST(p_partkey % 2500 AS VARCHAR), 4, '0') AS t, CASE WHEN p_partkey % 2 = 1 THEN '+' ELSE '-' END AS sg,
             lpad(CAST(p_partkey * 7 % 950 AS VARCHAR), 3, '0') AS d FROM part),
v AS (SELECT row_id, 'MAXI J' || t || sg || d AS name, CAST(substr(t, 1, 2) AS DOUBLE) AS hh, CAST(substr(t, 3, 2) AS DOUBLE) AS mm,
        CAST(sg || substr(d, 1, 2) || '.' || substr(d, 3, 1) AS DOUBLE) AS de FROM n)
SELECT row_id, name, round(((hh + mm / 60.0) * 15.0) % 360.0, 6) + 0.0 AS ra, round(de, 6) + 0.0 AS dec
FROM v WHERE hh <= 24 AND mm <= 60 AND abs(de) <= 90"""
