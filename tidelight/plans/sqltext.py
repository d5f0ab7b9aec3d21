"""SQL fragments shared by the DuckDB counterparts of the registered queries."""

LC = """lc AS (
  SELECT user_id AS source, event_type AS band,
         epoch_us(ts) / 8.64e10 + 40587.0 AS mjd,
         value AS val, value * 0.1 + 0.5 AS err, event_id AS row_id
  FROM events)"""

OPT = """opt AS (
  SELECT user_id AS source, epoch_us(ts) / 8.64e10 + 40587.0 AS mjd,
         14.0 + value / 50.0 AS mag, 0.02 + value / 5000.0 AS magerr,
         CASE event_id % 3 WHEN 0 THEN 'zg' WHEN 1 THEN 'zr' ELSE 'zi' END AS filtercode,
         CASE WHEN event_id % 11 = 0 THEN 32768 WHEN event_id % 7 = 0 THEN 4 ELSE 0 END AS catflags,
         event_id AS row_id
  FROM events WHERE event_type = 'click')"""

XRAY = """xr AS (
  SELECT source, mjd, val AS xf, err AS xe, row_id FROM lc WHERE band = 'view')"""

MULTI = """mb AS (
  SELECT source, floor(mjd) + 0.5 AS mjd,
         avg(val) FILTER (WHERE band = 'view') AS flux_2_4,
         avg(err) FILTER (WHERE band = 'view') AS err_2_4,
         avg(val) FILTER (WHERE band = 'click') AS flux_4_10,
         avg(err) FILTER (WHERE band = 'click') AS err_4_10,
         avg(val) FILTER (WHERE band = 'purchase') AS flux_10_20,
         avg(err) FILTER (WHERE band = 'purchase') AS err_10_20,
         avg(val) AS flux_2_20, avg(err) AS err_2_20
  FROM lc GROUP BY 1, 2)"""


def rebinned(name: str, src: str, keys: str) -> str:
    """Daily bins where the median gap is below half a day, else exact merge."""
    return f"""
{name}_g AS (
  SELECT *, mjd - lag(mjd) OVER (PARTITION BY {keys} ORDER BY mjd) AS gap FROM {src}),
{name}_s AS (SELECT {keys}, median(gap) AS med FROM {name}_g GROUP BY {keys}),
{name}_b AS (
  SELECT {', '.join('l.' + k.strip() for k in keys.split(','))},
         CASE WHEN s.med < 0.5 THEN floor(l.mjd) + 0.5 ELSE l.mjd END AS mjd,
         l.val, 1.0 / (greatest(l.err, 1e-8) ** 2) AS w
  FROM {src} l JOIN {name}_s s USING ({keys})),
{name} AS (
  SELECT {keys}, mjd, sum(w * val) / sum(w) AS val, sqrt(1.0 / sum(w)) AS err,
         count(*) AS n_raw
  FROM {name}_b GROUP BY {keys}, mjd)"""


def based(name: str, src: str, keys: str, n_iter: int = 5) -> str:
    """Iterative one-sided clip, unrolled. Adds base, sigma, quiet."""
    parts = [
        f"""{name}_0 AS (
  SELECT *, true AS mask, false AS stop, count(*) OVER (PARTITION BY {keys}) AS cnt FROM {src})"""
    ]
    def centre(prev: str, out: str) -> list[str]:
        return [
            f"""{out}_m AS (SELECT *, median(val) FILTER (WHERE mask) OVER (PARTITION BY {keys}) AS med FROM {prev})""",
            f"""{out}_c AS (
  SELECT *, greatest(1.4826 * median(abs(val - med)) FILTER (WHERE mask) OVER (PARTITION BY {keys}),
                     median(err) FILTER (WHERE mask) OVER (PARTITION BY {keys})) AS scat FROM {out}_m)""",
        ]
    for i in range(n_iter):
        prev, out = f"{name}_{i}", f"{name}_{i + 1}"
        parts += centre(prev, out)
        parts.append(
            f"""{out}_n AS (
  SELECT * EXCLUDE (med, scat), CASE WHEN stop OR cnt < 5 THEN mask
         ELSE abs(val - med) <= 3.0 * scat OR val < med END AS nmask FROM {out}_c)"""
        )
        parts.append(
            f"""{out}_k AS (SELECT *, sum(nmask::INT) OVER (PARTITION BY {keys}) AS ncnt FROM {out}_n)"""
        )
        parts.append(
            f"""{out} AS (
  SELECT * EXCLUDE (mask, stop, cnt, nmask, ncnt), nmask AS mask,
         stop OR cnt < 5 OR ncnt = cnt AS stop, ncnt AS cnt FROM {out}_k)"""
        )
    last = f"{name}_{n_iter}"
    parts += centre(last, f"{name}_f")
    parts.append(
        f"""{name} AS (
  SELECT * EXCLUDE (mask, stop, cnt, med, scat), med AS base, scat AS sigma, mask AS quiet FROM {name}_f_c)"""
    )
    return ",\n".join(parts)


def gated(name: str, src: str, keys: str, n: int = 10) -> str:
    return f"""{name} AS (
  SELECT * EXCLUDE (sz) FROM (SELECT *, count(*) OVER (PARTITION BY {keys}) AS sz FROM {src})
  WHERE sz >= {n})"""


def events_of(
    name: str, src: str, keys: str, enter: float = 5.0, exit_: float = 2.5, ratio: float = 1.5, gap: float = 4.0, dur: float = 1.0, factor: float = 3.0
) -> str:
    """Hysteresis islands, gates and event aggregates of a series with base and sigma."""
    return f"""
{name}_g AS (SELECT *, mjd - lag(mjd) OVER (PARTITION BY {keys} ORDER BY mjd) AS gap FROM {src}),
{name}_c AS (SELECT *, coalesce(median(gap) OVER (PARTITION BY {keys}), 1.0) AS cadence,
                    min(sigma) OVER (PARTITION BY {keys}) > 0 AS usable FROM {name}_g),
{name}_z AS (
  SELECT *, (val - base) / sigma AS z,
         usable AND CASE WHEN base > 0 THEN val > {ratio} * base ELSE val - base > {ratio} * sigma END AS tall,
         greatest(5.0 * cadence, {gap}) AS max_gap, greatest({dur}, {factor} * cadence) AS min_dur
  FROM {name}_c),
{name}_w AS (
  SELECT *, z > {enter} AS seed,
         CASE WHEN mjd - lag(mjd) OVER (PARTITION BY {keys} ORDER BY mjd) > max_gap THEN 1 ELSE 0 END AS cut
  FROM {name}_z WHERE tall AND z > {exit_}),
{name}_r AS (SELECT *, sum(cut) OVER (PARTITION BY {keys} ORDER BY mjd) AS run FROM {name}_w),
{name}_a AS (
  SELECT {keys}, run, min(mjd) AS mjd_start, max(mjd) AS mjd_end, max(mjd) - min(mjd) AS duration_days,
         count(*) AS n_points, sum(seed::INT) AS n_seed, max(val) AS peak_value,
         arg_max(mjd, val ORDER BY mjd) AS peak_mjd, avg(base) AS baseline_value,
         max(z) AS significance_sigma, avg(z) AS mean_significance_sigma, max(min_dur) AS min_dur,
         (sum(val / greatest(err, 1e-8) ** 2) / sum(1.0 / greatest(err, 1e-8) ** 2) - avg(base))
           / sqrt(1.0 / sum(1.0 / greatest(err, 1e-8) ** 2) + median(sigma) ** 2) AS block_z
  FROM {name}_r GROUP BY {keys}, run),
{name} AS (
  SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY mjd_start) AS outburst_id,
         mjd_start, mjd_end, duration_days, n_points, peak_value, peak_mjd, baseline_value,
         significance_sigma, mean_significance_sigma, block_z
  FROM {name}_a
  WHERE n_seed >= 2 AND n_points >= 4 AND duration_days >= min_dur AND block_z > {exit_})"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def r(expr: str, digits: int, alias: str) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {alias}"
