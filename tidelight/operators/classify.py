"""Name to position to class: cascades as ranked candidates, decisions as CASE chains.

A cascade ("try this, else that") becomes a set of candidate rows with a rank; the best
rank per source is one map-side combined ``min_by``. Only sources that a stage leaves
unresolved enter the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SkyConfig
from ..functions.coords import with_j_position, with_plain_candidates
from ..functions.names import name_variants
from ..session import cut_lineage
from .skew import split_join
from .sky import nearest_in_cone

# ---- Fixed values ----
NO_VALUE = ["", "--", "nan", "none", "masked"]
TRUE_FLAGS = ["1", "true", "y", "yes"]
BURST_WORDS = ["BURST", "ATOLL", "Z SOURCE", "Z-SOURCE"]
BH_CATALOGS = ["watchdog_bhxb", "blackcat_bh"]
LMXB_CATALOG = "lmxb_xrbcats"
HMXB_CATALOG = "hmxb_heasarc"
CATALOG_ORDER = [*BH_CATALOGS, LMXB_CATALOG, HMXB_CATALOG]
FALLBACK = "SIMBAD (fallback)"
# ----------------------


def has_value(text: Column) -> Column:
    return F.coalesce(~F.lower(F.trim(text)).isin(NO_VALUE), F.lit(False))


def _contains_any(text: Column, words: list[str]) -> Column:
    up = F.upper(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for w in words:
        out = out | up.contains(w)
    return out


def _weigh(ns: Column, bh: Column, default: str) -> Column:
    return (
        F.when(ns & ~bh, "NS").when(bh & ~ns, "BH").when(ns & bh, "Unknown").otherwise(default)
    )


def lmxb_object(ppulse: Column, msp: Column, kind: Column, bh_ruled_out: bool = True) -> Column:
    """Compact object of a low-mass system from pulsation, millisecond flag and burst words."""
    flag = F.coalesce(F.lower(F.trim(msp)).isin(TRUE_FLAGS), F.lit(False))
    ns = has_value(ppulse) | flag | _contains_any(kind, BURST_WORDS)
    return _weigh(ns, _contains_any(kind, ["BH"]), "NS" if bh_ruled_out else "Unknown")


def hmxb_object(pulse: Column, kind: Column) -> Column:
    return _weigh(has_value(pulse), _contains_any(kind, ["BH"]), "Unknown")


def _readings(names: DataFrame) -> DataFrame:
    """src, which (0 primary, 1 alternate), name: one row per reading of a source name."""
    both = F.array(
        F.struct(F.lit(0).alias("which"), F.col("query_name").alias("name")),
        F.struct(F.lit(1).alias("which"), F.col("query_name_alt").alias("name")),
    )
    out = names.select("src", F.explode(both).alias("r")).select("src", "r.which", "r.name")
    return out.where(F.col("name").isNotNull())


def resolve_direct(names: DataFrame, catalogs: DataFrame, cfg: SkyConfig = SkyConfig()) -> DataFrame:
    """Positions read from the names themselves: src, r_ra, r_dec, how.

    A precise J-name is taken as it is. Coarse ones, and the readings of catalog names,
    count only if a catalog row lies within the sanity radius, whose position is adopted.
    """
    reads = cut_lineage(with_j_position(_readings(names), "name"))
    precise = F.coalesce(F.col("j.precision") <= cfg.match_radius_arcsec, F.lit(False))
    direct = reads.where(precise).select(
        "src", F.struct("which", F.lit(0).alias("step"), F.lit(0.0).alias("sep"), F.lit(0).alias("i")).alias("rank"),
        F.col("j.ra").alias("r_ra"), F.col("j.dec").alias("r_dec"), F.lit("name").alias("how"),
    )
    coarse = reads.where(F.col("j").isNotNull() & ~precise).select(
        "src", "which", F.lit(1).alias("step"), F.lit(0).alias("i"), F.col("j.ra").alias("ra"),
        F.col("j.dec").alias("dec"), F.lit("name, confirmed").alias("how"),
    )
    plain = with_plain_candidates(reads.where(~precise), "name", "cs").select(
        "src", "which", F.lit(2).alias("step"), F.posexplode("cs").alias("i", "c")
    ).select("src", "which", "step", "i", F.col("c.ra").alias("ra"), F.col("c.dec").alias("dec"), F.col("c.label").alias("how"))
    cand = cut_lineage(coarse.unionByName(plain))
    hits = nearest_in_cone(
        cand, catalogs.select("ra", "dec", "priority", "row_idx"), cfg.sanity_radius_arcsec,
        ["priority", "row_idx"],
    )
    confirmed = split_join(cand, hits, ["ra", "dec"]).select(
        "src",
        F.struct("which", "step", F.when(F.col("step") == 2, F.col("sep")).otherwise(0.0).alias("sep"), "i").alias("rank"),
        F.col("m_ra").alias("r_ra"), F.col("m_dec").alias("r_dec"), "how",
    )
    return _best(direct.unionByName(confirmed))


def _best(cand: DataFrame) -> DataFrame:
    picked = cand.groupBy("src").agg(F.min_by(F.struct("r_ra", "r_dec", "how"), "rank").alias("b"))
    return picked.select("src", "b.r_ra", "b.r_dec", "b.how")


STEM = r"^(.*?\D\d{2}\d{2}(?:\.\d+)?[+-]\d{2})"


def resolve_by_index(names: DataFrame, index: DataFrame, cfg: SkyConfig = SkyConfig()) -> DataFrame:
    """Positions from a name index (name, main_id, ra, dec, pos): exact name, cone around a
    J-name guess, alias spellings, then a wildcard that fits exactly one object."""
    reads = cut_lineage(with_j_position(_readings(names), "name"))
    index = cut_lineage(index)
    entry = index.groupBy("name").agg(F.min_by(F.struct("ra", "dec"), "pos").alias("e"))

    def found(df, step, i, how):
        return df.select(
            "src", F.struct("which", F.lit(step).alias("step"), i.cast("int").alias("i")).alias("rank"),
            F.col("e.ra").alias("r_ra"), F.col("e.dec").alias("r_dec"), F.lit(how).alias("how"),
        )

    exact = found(split_join(reads, entry, ["name"]), 0, F.lit(0), "index, exact")
    hints = reads.where("j IS NOT NULL").select(
        "src", "which", F.col("j.ra").alias("ra"), F.col("j.dec").alias("dec"),
        F.least(
            F.greatest("j.precision", F.lit(cfg.name_index_min_radius_arcsec)), F.lit(cfg.sanity_radius_arcsec)
        ).alias("radius"),
    )
    near = nearest_in_cone(hints, index.select("ra", "dec", "pos"), cfg.sanity_radius_arcsec, ["pos"])
    cone = split_join(hints, near, ["ra", "dec"]).where(F.col("sep") <= F.col("radius"))
    cone = cone.withColumn("e", F.struct(F.col("m_ra").alias("ra"), F.col("m_dec").alias("dec")))
    cone = found(cone, 1, F.lit(0), "index, cone")
    variants = reads.select("src", "which", F.posexplode(name_variants(F.col("name"))).alias("i", "v"))
    alias = variants.where("NOT v.wildcard").select("src", "which", "i", F.col("v.name").alias("name"))
    alias = found(split_join(alias, entry, ["name"]), 2, F.col("i"), "index, alias")
    # a wildcard stem ends after two declination digits, so the index can be keyed by it
    stems = index.withColumn("stem", F.regexp_extract("name", STEM, 1)).where("stem <> ''").groupBy("stem").agg(
        F.countDistinct("main_id").alias("n"), F.min_by(F.struct("ra", "dec"), "pos").alias("e")
    )
    wild = variants.where("v.wildcard").select(
        "src", "which", "i", F.expr("left(v.name, length(v.name) - 1)").alias("stem")
    )
    wild = split_join(wild, stems.where("n = 1"), ["stem"])
    wild = found(wild, 2, F.col("i"), "index, wildcard")
    return _best(exact.unionByName(cone).unionByName(alias).unionByName(wild))


def classify(
    names: DataFrame, catalogs: DataFrame, index: DataFrame, cfg: SkyConfig = SkyConfig()
) -> DataFrame:
    """One row per source: position, type, compact object, matched catalog, confidence.

    ``names``: src, query_name, query_name_alt. ``catalogs``: cat, priority, row_idx, ra,
    dec, type, ppulse, msp, xtype (evidence NULL where a catalog has none). ``index``:
    name, main_id, ra, dec, otype, pos.
    """
    # every stage is read several times by the next one, so each is materialised once
    names = cut_lineage(names)
    direct = cut_lineage(resolve_direct(names, catalogs, cfg))
    rest = split_join(names, direct.select("src"), ["src"], "left_anti")
    placed = cut_lineage(direct.unionByName(resolve_by_index(rest, index, cfg)))
    pts = placed.select(F.col("r_ra").alias("ra"), F.col("r_dec").alias("dec")).distinct()
    hits = nearest_in_cone(
        pts, catalogs.drop("priority"), cfg.match_radius_arcsec, ["row_idx"], by=["cat"]
    )
    cols = ["sep", "m_type", "m_ppulse", "m_msp", "m_xtype"]
    wide = hits.groupBy("ra", "dec").agg(
        *[F.max(F.when(F.col("m_cat") == c, F.struct(*cols))).alias(c) for c in CATALOG_ORDER]
    )
    otypes = nearest_in_cone(pts, index.select("ra", "dec", "pos", "otype"), cfg.match_radius_arcsec, ["pos"])
    near_type = otypes.select("ra", "dec", F.col("m_otype").alias("o_near"))
    by_name = index.groupBy("name").agg(F.min_by("otype", "pos").alias("o_name"))
    placed = placed.withColumnsRenamed({"r_ra": "ra", "r_dec": "dec"})
    df = split_join(placed, wide, ["ra", "dec"], "left")
    df = split_join(df, near_type, ["ra", "dec"], "left")
    df = split_join(names, df, ["src"], "left")
    df = split_join(df.withColumn("name", F.col("query_name")), by_name, ["name"], "left").drop("name")

    wd, bc = (F.col(c) for c in BH_CATALOGS)
    lm, hm = F.col(LMXB_CATALOG), F.col(HMXB_CATALOG)
    bh = F.coalesce(wd, bc)
    bh_cat = F.when(wd.isNotNull(), BH_CATALOGS[0]).when(bc.isNotNull(), BH_CATALOGS[1])
    typed = lm.isNotNull() | hm.isNotNull()
    is_hm = hm.isNotNull() & (lm.isNull() | (hm["sep"] <= lm["sep"]))
    by_type = F.when(
        F.upper(F.coalesce(bh["m_type"], F.lit(""))).contains("HM"), "HMXB"
    ).otherwise("LMXB")
    resolved = F.col("ra").isNotNull()
    matched = typed | bh.isNotNull()
    otype = F.when(resolved & ~matched, F.coalesce("o_near", "o_name"))
    up = F.upper(F.coalesce(otype, F.lit("")))
    weak_type = F.when(up.contains("HXB"), "HMXB").when(up.contains("LXB"), "LMXB").otherwise("Unknown")
    weak_object = (
        F.when(up.contains("PSR") | up.contains("PULSAR"), "NS").when(up.contains("BH"), "BH").otherwise("Unknown")
    )
    lm_obj = lmxb_object(lm["m_ppulse"], lm["m_msp"], lm["m_xtype"])
    hm_obj = hmxb_object(hm["m_ppulse"], hm["m_xtype"])
    obj = (
        F.when(bh.isNotNull(), "BH").when(is_hm, hm_obj).when(lm.isNotNull(), lm_obj).otherwise(weak_object)
    )
    return df.select(
        "src", "query_name", F.col("ra").alias("resolved_ra"), F.col("dec").alias("resolved_dec"),
        F.when(is_hm, "HMXB").when(lm.isNotNull(), "LMXB").when(bh.isNotNull(), by_type)
        .otherwise(weak_type).alias("xrb_type"),
        obj.alias("compact_object"),
        F.when(is_hm, HMXB_CATALOG).when(lm.isNotNull(), LMXB_CATALOG).when(bh.isNotNull(), bh_cat)
        .when(resolved, FALLBACK).otherwise("None").alias("matched_catalog"),
        F.when(is_hm, hm["sep"]).when(lm.isNotNull(), lm["sep"]).when(bh.isNotNull(), bh["sep"])
        .alias("match_separation_arcsec"),
        otype.alias("simbad_otype"),
        F.when(bh.isNotNull(), "high").when(is_hm & (hm_obj == "Unknown"), "medium")
        .when(typed, "high").otherwise("low").alias("confidence"),
        F.coalesce("how", F.lit("unresolved")).alias("resolution"),
    )
