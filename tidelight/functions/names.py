"""Source names: file-name parsing, canonical keys, spelling variants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- Fixed values: results depend on these lists, patterns and their order. ----
FILE_EXTENSION = r"(?i)\.(csv|txt|dat|fits|lc|json)$"
SCAN_EXTENSIONS = ["csv", "txt", "dat", "fits", "lc"]

# suffix, band, instrument; the first that fits is taken
SUFFIXES = [
    ("_maxi_lc", "xray", "MAXI"),
    ("_maxi", "xray", "MAXI"),
    ("_gsc_lc", "xray", "MAXI"),
    ("_bat_lc", "xray", "SwiftBAT"),
    ("_bat", "xray", "SwiftBAT"),
    ("_xrt_lc", "xray", "SwiftXRT"),
    ("_xrt", "xray", "SwiftXRT"),
    ("_ztf_lc", "optical", "ZTF"),
    ("_ztf", "optical", "ZTF"),
    ("_atlas_lc", "optical", "ATLAS"),
    ("_atlas", "optical", "ATLAS"),
]
MISSIONS = [
    "MAXI", "XTE", "IGR", "SWIFT", "GRS", "GX", "SAX", "EXO", "KS", "GS",
    "AX", "OAO", "MXB", "4U", "1E", "H", "A", "1A", "3A",
]
RESPELLED = {"SWIFT": "Swift"}
ROSAT_PREFIXES = [("1RXSJ", "1RXS J"), ("RJ", "RX J")]
ACRONYMS = ["LMC", "SMC"]

# suffixes of the detector's own file-name rule
CURVE_SUFFIXES = {
    "maxi": ["_maxi_lc.csv", "_maxi.csv"],
    "ztf": ["_ztf.csv"],
}
# ---------------------------------------------------------------------------------


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def strip_extension(name: Column) -> Column:
    return F.regexp_replace(name, FILE_EXTENSION, "")


def signed(coord: Column) -> Column:
    """p and m between digits are the file-safe spelling of + and -."""
    plus = F.regexp_replace(coord, r"(?<=\d)p(?=\d)", "+")
    return F.regexp_replace(plus, r"(?<=\d)m(?=\d)", "-")


def unsigned_gap(coord: Column) -> Column:
    """True where a bare underscore stands for a lost declination sign."""
    return coord.rlike(r"(?<=\d)_(?=\d)")


def gap_as(coord: Column, sign: str) -> Column:
    return F.regexp_replace(coord, r"(?<=\d)_(?=\d)", sign)


def title_word(word: Column) -> Column:
    """Capital after every non-letter, lower case after a letter."""
    chars = F.split(F.lower(word), "")
    lifted = F.transform(
        chars,
        lambda c, i: F.when(
            (i == 0) | ~F.coalesce(F.get(chars, i - 1), F.lit("")).rlike("[a-z]"), F.upper(c)
        ).otherwise(c),
    )
    return F.array_join(lifted, "")


def common_name(core: Column) -> Column:
    """SCO_X-1 to Sco X-1; known acronyms stay upper case."""
    words = F.transform(
        F.split(core, "_"),
        lambda w: F.when(F.upper(w).isin(ACRONYMS), F.upper(w)).otherwise(title_word(w)),
    )
    return F.array_join(words, " ")


def canonical_key(name: Column) -> Column:
    """Spelling-free join key. Signs are dropped too: +024 and -024 share a key."""
    return F.upper(F.regexp_replace(signed(F.trim(name)), r"[\s_\-+]+", ""))


def signed_key(name: Column) -> Column:
    """As :func:`canonical_key`, but the declination sign survives."""
    return F.upper(F.regexp_replace(signed(F.trim(name)), r"[\s_]+", ""))


def safe_id(name: Column, signs: bool = False) -> Column:
    """File-safe identifier; ``signs`` spells + and - as p and m instead of escaping /."""
    if signs:
        return F.translate(F.trim(name), " +-", "_pm")
    return F.translate(name, " /", "_-")


def ascii_only(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[^\x00-\x7F]", ""))


def url_slug(name: Column) -> Column:
    """Catalog name without its mission prefix and blanks."""
    return F.replace(
        F.regexp_replace(F.trim(name), r"(?i)^(?:\d+)?MAXI\s*", ""), F.lit(" "), F.lit("")
    )


def slug_variants(slug: Column) -> Column:
    """The slug, then its last digit one up and one down (mod 10)."""
    last = F.right(slug, F.lit(1)).try_cast("int")
    stem = F.left(slug, F.length(slug) - 1)
    up = F.concat(stem, ((last + 1) % 10).cast("string"))
    down = F.concat(stem, ((last + 9) % 10).cast("string"))
    return F.when(slug.rlike(r"\d$"), F.array(slug, up, down)).otherwise(F.array(slug))


def wait_seconds(message: Column) -> Column:
    """Seconds (or minutes) announced by a rate-limit message, 10 if none."""
    sec = F.regexp_extract(message, r"available in (\d+) seconds", 1).try_cast("bigint")
    minutes = F.regexp_extract(message, r"available in (\d+) minutes", 1).try_cast("bigint")
    return F.coalesce(sec, minutes * 60, F.lit(10).cast("bigint"))


def _first(pairs, default):
    """CASE over ordered (condition, value) pairs."""
    return reduce(lambda acc, p: F.when(p[0], p[1]).otherwise(acc), reversed(pairs), default)


def parse_names(df: DataFrame, file_col: str) -> DataFrame:
    """File name to identity: all columns of the parsed-source record, one projection chain."""
    df = df.withColumn("raw_filename", F.col(file_col))
    df = df.withColumn("_stem", strip_extension(base_name(F.col(file_col))))
    hits = [(F.col("_stem").rlike(f"(?i){s}$"), s, b, i) for s, b, i in SUFFIXES]
    df = df.withColumn("band", _first([(c, F.lit(b)) for c, _, b, _ in hits], F.lit("unknown")))
    df = df.withColumn("instrument", _first([(c, F.lit(i)) for c, _, _, i in hits], F.lit("unknown")))
    df = df.withColumn(
        "_core",
        _first(
            [(c, F.regexp_replace("_stem", f"(?i){s}$", "")) for c, s, _, _ in hits], F.col("_stem")
        ),
    )
    core = F.col("_core")
    head = F.upper(F.substring_index(core, "_", 1))
    glued = F.upper(F.regexp_extract(core, r"^(\d?[A-Za-z]+)(\d.*)$", 1))
    spelled = F.create_map(*[F.lit(x) for m in MISSIONS for x in (m, RESPELLED.get(m, m))])
    special = [(F.upper(core).startswith(p), p, text) for p, text in ROSAT_PREFIXES]
    by_head = core.contains("_") & head.isin(MISSIONS)
    by_glue = glued.isin(MISSIONS)
    df = df.withColumn(
        "_mission",
        _first(
            [(c, F.lit(text)) for c, _, text in special]
            + [(by_head, F.concat(spelled[head], F.lit(" "))), (by_glue, F.concat(spelled[glued], F.lit(" ")))],
            F.lit(None).cast("string"),
        ),
    )
    tail = F.substring(core, F.instr(core, F.lit("_")) + 1, F.length(core))
    df = df.withColumn(
        "_rest",
        _first(
            [(c, F.substring(core, len(p) + 1, 1 << 20)) for c, p, _ in special]
            + [(by_head, tail), (by_glue, F.regexp_extract(core, r"^(\d?[A-Za-z]+)(\d.*)$", 2))],
            core,
        ),
    )
    has_mission = F.col("_mission").isNotNull()
    bare = ~has_mission & core.rlike(r"^J?\d")
    proper = ~has_mission & ~bare & core.contains("_") & (F.upper(core) == core)
    coord_like = has_mission | bare
    coord = signed(F.col("_rest"))
    lead = F.coalesce("_mission", F.lit(""))
    df = df.withColumn("_coord", coord).withColumn("sign_ambiguous", coord_like & unsigned_gap(coord))
    df = df.withColumn(
        "core_identifier", F.when(coord_like, gap_as(F.col("_coord"), "+")).otherwise(core)
    )
    df = df.withColumn(
        "query_name",
        F.when(coord_like, F.concat(lead, F.col("core_identifier")))
        .when(proper, common_name(core))
        .otherwise(F.translate(core, "_", " ")),
    )
    df = df.withColumn(
        "query_name_alt", F.when(F.col("sign_ambiguous"), F.concat(lead, gap_as(F.col("_coord"), "-")))
    )
    raw = ~(coord_like | proper)
    unknown = F.col("band") == "unknown"
    df = df.withColumn(
        "confidence",
        F.when(unknown | raw | F.col("sign_ambiguous"), F.lit("low")).otherwise(F.lit("high")),
    )
    df = df.withColumn(
        "notes",
        F.concat_ws(
            " ",
            F.when(unknown, F.lit("Unknown instrument suffix.")),
            F.when(raw, F.lit("Name kept as written.")),
            F.when(
                F.col("sign_ambiguous"),
                F.concat(F.lit("Declination sign lost; other reading: "), "query_name_alt", F.lit(".")),
            ),
        ),
    )
    df = df.withColumn("source_key", safe_id(F.col("query_name")))
    return df.drop("_stem", "_core", "_mission", "_rest", "_coord")


def parse_curve_file(df: DataFrame, file_col: str) -> DataFrame:
    """The detector's own rule: source, instrument and file stem of a light-curve file."""
    base = base_name(F.col(file_col))
    hits = [
        (F.lower(base).endswith(s), inst, len(s)) for inst, ss in CURVE_SUFFIXES.items() for s in ss
    ]
    df = df.withColumn(
        "file_stem",
        _first(
            [(c, F.left(base, F.length(base) - n)) for c, _, n in hits],
            F.regexp_replace(base, r"(?<=.)\.[^.]*$", ""),
        ),
    )
    guess = F.when(F.lower(F.col("file_stem")).contains("ztf"), "ztf").otherwise("maxi")
    df = df.withColumn("instrument", _first([(c, F.lit(i)) for c, i, _ in hits], guess))
    pat = r"(?i)^(.*?)(J\d{4,6})([pm])(\d{2,4})"
    sign = F.when(F.lower(F.regexp_extract("file_stem", pat, 3)) == "p", "+").otherwise("-")
    named = F.concat(
        F.rtrim(F.regexp_extract("file_stem", pat, 1), F.lit("_")), F.lit(" "),
        F.regexp_extract("file_stem", pat, 2), sign, F.regexp_extract("file_stem", pat, 4),
    )
    plain = F.col("file_stem")
    source = F.when(F.col("file_stem").rlike(pat), named).otherwise(plain)
    return df.withColumn("source", F.trim(F.translate(F.trim(source), "_", " ")))


VARIANT = r"^(.*?\D)(\d{2})(\d{2}(?:\.\d+)?)\s*([+-])(\d{2,3}(?:\.\d+)?)\s*$"


def name_variants(name: Column) -> Column:
    """Ordered alias spellings as an array of (name, wildcard); empty if none apply."""
    text = F.trim(name)
    part = lambda i: F.regexp_extract(text, VARIANT, i)
    stem = F.concat(part(1), part(2), part(3), part(4))
    digits = F.substring_index(part(5), ".", 1)
    whole = F.left(digits, F.lit(2))
    exact = lambda d: F.struct(F.concat(stem, d).alias("name"), F.lit(False).alias("wildcard"))
    wild = F.struct(F.concat(stem, whole, F.lit("*")).alias("name"), F.lit(True).alias("wildcard"))
    all_ = F.when(
        F.length(digits) == 3, F.array(exact(whole), wild, exact(digits))
    ).otherwise(
        F.array(exact(whole), wild, exact(F.concat(whole, F.lit("0"))), exact(F.concat(whole, F.lit("5"))))
    )
    kept = F.filter(F.array_distinct(all_), lambda v: v["wildcard"] | (v["name"] != name))
    return F.when(text.rlike(VARIANT), kept).otherwise(F.filter(all_, lambda v: F.lit(False)))


def class_label(text: Column) -> Column:
    """Free-text compact-object label to BH, NS or UNKNOWN."""
    t = F.upper(text)
    return (
        F.when(t.contains("BH") | t.contains("BLACK"), "BH")
        .when(t.contains("NS") | t.contains("NEUTRON"), "NS")
        .otherwise("UNKNOWN")
    )
