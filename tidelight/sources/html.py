"""Catalog links out of raw HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import ascii_only

# href quoted either way or bare; the text may hold markup
ANCHOR = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))[^>]*>(.*?)</a\s*>"""


def anchors(pages: DataFrame, page: str, html: str) -> DataFrame:
    """One row per anchor: page, ordinal, href, target folder and ASCII text.

    Markup inside an anchor's text is dropped. The target is the last but one path segment, or the file name without .html where the
    path has only one.
    """
    found = F.arrays_zip(
        *[F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(i + 1)).alias(n) for i, n in enumerate(("h2", "h1", "h0", "t"))]
    )
    df = pages.select(F.col(page).alias("page_id"), F.posexplode(found).alias("i", "a"))
    href = F.concat("a.h2", "a.h1", "a.h0")  # two of the three are empty
    text = F.regexp_replace("a.t", "<[^>]*>", "")
    parts = F.filter(F.split(href, "/"), lambda s: s != "")
    last = F.replace(F.get(parts, F.lit(0)), F.lit(".html"), F.lit(""))
    target = F.when(F.size(parts) >= 2, F.get(parts, F.size(parts) - 2)).otherwise(last)
    return df.select(
        "page_id", (F.col("i") + 1).alias("idx"), href.alias("href"),
        F.coalesce(target, F.lit("")).alias("target"), ascii_only(F.trim(text)).alias("text"),
    )
