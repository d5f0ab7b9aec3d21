"""Column resolution at plan-build time: four rules, no data is read."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- Fixed values ----
SPAN_START = ["span_start_mjd", "t_start", "start_mjd", "mjd_start"]
SPAN_END = ["span_end_mjd", "t_end", "end_mjd", "mjd_end"]
MAG_KEYWORDS = {
    "mjd": ["mjd", "time", "jd"],
    "mag": ["magpsf", "mag", "m_app", "magnitude"],
    "magerr": ["sigmapsf", "magerr", "dmag", "err_mag", "err"],
    "filter": ["filter", "fid", "band", "flt", "passband", "f"],
}
BAND_COLUMN_ALTERNATIVES = ["energy_band", "e_band", "passband"]
FILTER_COLUMNS = ["filtercode", "filt", "filter", "band", "F"]
MISSION_NAMES = "xmm|csc|swift|chandra"
FLUX_NAMES = "flux|rate"
# ----------------------


def by_name(columns: Iterable[str], candidates: Sequence[str]) -> str | None:
    """Exact but case-insensitive; the earliest candidate wins."""
    index = {c.lower(): c for c in columns}
    return next((index[c.lower()] for c in candidates if c.lower() in index), None)


def by_keyword(columns: Iterable[str], keywords: Sequence[str]) -> str | None:
    """A keyword contained in the column name; keywords before columns."""
    cols = list(columns)
    return next((c for k in keywords for c in cols if k in c.lower()), None)


def by_both(columns: Iterable[str], first: str, second: str) -> str | None:
    """Both fragments contained, e.g. flux and 2_20; err also fits error."""
    return next((c for c in columns if first in c.lower() and second in c.lower()), None)


def tidy_header(df: DataFrame, case: str | None = "lower") -> DataFrame:
    """Trim names, drop leading # and force their case."""
    def clean(c: str) -> str:
        c = c.strip().lstrip("#")
        return c.lower() if case == "lower" else c.upper() if case == "upper" else c
    return df.toDF(*[clean(c) for c in df.columns])


def need(df: DataFrame, candidates: Sequence[str], what: str) -> str:
    found = by_name(df.columns, candidates)
    if found is None:
        raise ValueError(f"no {what} column among {df.columns}")
    return found


def standard_energy_band(df: DataFrame, tag: str = "2_20") -> DataFrame:
    """Adds flux_<tag> and err_<tag> under their canonical names."""
    for kind in ("flux", "err"):
        col = by_both(df.columns, kind, tag)
        if col is None:
            raise KeyError(f"no {kind} column for band {tag} among {df.columns}")
        if col != f"{kind}_{tag}":
            df = df.withColumn(f"{kind}_{tag}", F.col(col))
    return df
