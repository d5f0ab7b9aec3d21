"""URL lists behind a blocked Bloom filter.

Two kinds of entries are listed: rules (a host with all its subdomains, and a start of the path)
and single canonical URLs. Each entry is a key string. The filter has blocks of 512 bits; a key
picks one block and sets one bit in each of its eight words, so a probe reads one row. Blocks
are made by ``bit_or`` of grouped keys, about 16 bits for each key, and joined to the keys of
the pages by block number. A URL probes its canonical form and, for each depth of host and
length of path that some rule has, the matching end of its host and start of its path. Possible
hits go to an exact join on the key, which removes the false positives.

Distinct URLs are judged, then joined to the pages, so a hot URL is probed once. The filter
and the list are broadcast only below a counted number of rows.

Longest rule wins, by characters of host and path. A URL that no rule fits gets the verdict of
its canonical URL if that is listed, else ``default``.

Defined cases: a null URL or one without ``://`` has an empty host and path and fits nothing;
equal ids and repeated rows each get their row; empty pages give no rows, an empty list gives
the default; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, col, join_counted, stage

#: Fixed rules of the registered query, as (rule, verdict).
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
WORDS = 8
KEYS_PER_BLOCK = 32


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.`` and path without a closing slash; null without a host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", "")))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(F.lit(1), key)
    place = lambda i: F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
    return [F.call_function("shiftleft", F.lit(1).cast("long"), place(i)) for i in range(WORDS)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(2), key), F.lit(blocks))


def build_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """block, w0..w7 over the column ``key``; blocks without a key are left out."""
    bits = _bits(F.col("key"))
    rows = keys.select(_block(F.col("key"), blocks).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(bits)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def passing(probes: DataFrame, blooms: DataFrame, blocks: int) -> DataFrame:
    """Rows of ``probes`` (with a column ``key``) that the filter lets through."""
    joined = join_counted(probes.withColumn("block", _block(F.col("key"), blocks)), blooms, ["block"])
    for i, bit in enumerate(_bits(F.col("key"))):
        joined = joined.where(F.col(f"w{i}").bitwiseAND(bit) != 0)
    return joined.select(*probes.columns)


def entries(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """key, rule, verdict, depth, span of all entries. ``rules``: rule, verdict; ``listed``: url, verdict."""
    slash = F.instr("rule", "/")
    host = F.when(slash > 0, F.substring("rule", F.lit(1), slash - 1)).otherwise(F.col("rule"))
    host, path = ascii_lower(host), F.when(slash > 0, F.substring("rule", slash, F.length("rule"))).otherwise("")
    ruled = rules.where(F.length(host) > 0).select(
        F.concat(F.lit("p"), host, path).alias("key"), F.concat(host, path).alias("rule"), "verdict",
        _labels(host).alias("depth"), F.length(path).alias("span"))
    url = canonical(host_of(F.col("url")), path_of(F.col("url")))
    single = listed.where(url.isNotNull()).select(
        F.concat(F.lit("x"), url).alias("key"), F.lit(None).cast("string").alias("rule"), "verdict",
        F.lit(0).alias("depth"), F.lit(0).alias("span"))
    both = ruled.unionByName(single)
    # an entry listed twice: block wins
    return both.groupBy("key", "rule", "depth", "span").agg(F.max("verdict").alias("verdict"))


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col="page_id", url_col="url", default="allow") -> DataFrame:
    """page_id, host, path, rule, verdict and listed (does the canonical URL decide) of each page."""
    listing = stage(entries(rules, listed))
    blocks = max(1, -(-listing.count() // KEYS_PER_BLOCK))
    blooms = stage(build_filter(listing, blocks))
    # shapes of rules, at most labels of a host times characters of a path
    shapes = [tuple(r) for r in listing.where("depth > 0").select("depth", "span").distinct().collect()]

    rows = pages.select(col(id_col).alias("page_id"), F.coalesce(col(url_col), F.lit("")).alias("url"))
    urls = rows.select("url").distinct().withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    host, path = F.col("host"), F.col("path")
    keys = [F.concat(F.lit("x"), canonical(host, path))]
    for depth, span in shapes:
        fits = (host != "") & (_labels(host) >= depth) & (F.length(path) >= span)
        keys.append(F.when(fits, F.concat(F.lit("p"), F.substring_index(host, ".", -depth), F.substring(path, 1, span))))
    urls = stage(urls.withColumn("keys", F.array_compact(F.array(*keys))))
    probes = urls.select("url", F.explode("keys").alias("key"))
    hits = join_counted(passing(probes, blooms, blocks), listing, ["key"])
    # a rule comes before a listed URL, then the longest
    best = F.max(F.struct(F.col("rule").isNotNull().alias("by_rule"), F.length("rule").alias("n"), "rule", "verdict"))
    found = hits.groupBy("url").agg(best.alias("b"))
    judged = urls.drop("keys").join(found, "url", "left").select(
        "url", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"),
        (F.coalesce(~F.col("b.by_rule"), F.lit(False))).alias("listed"))
    return rows.join(judged, "url").select("page_id", "host", "path", "rule", "verdict", "listed")


def repeated_urls(pages: DataFrame, url_col="url") -> DataFrame:
    """url, verdict: canonical URLs that more than one page has, to be blocked."""
    rows = pages.select(col(url_col).alias("url"))
    name = canonical(host_of(F.col("url")), path_of(F.col("url")))
    return rows.groupBy(name.alias("c")).agg(F.count("*").alias("n"), F.min("url").alias("url")).where(
        "n > 1 AND c IS NOT NULL").select("url", F.lit("block").alias("verdict"))


ORACLE = r"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS r FROM pages),
q AS (SELECT page_id, coalesce(translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') END AS name FROM q),
twice AS (SELECT name FROM c WHERE name IS NOT NULL GROUP BY name HAVING count(*) > 1),
rules(h, p, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                                ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fit AS (SELECT c.*, h || p AS rule, verdict FROM c LEFT JOIN rules
        ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
best AS (SELECT * FROM fit QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1)
SELECT page_id, host, path, rule,
  coalesce(verdict, CASE WHEN name IN (SELECT name FROM twice) THEN 'block' ELSE 'allow' END) AS verdict
FROM best
"""
