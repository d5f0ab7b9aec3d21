"""Whole runs, dense time slices."""

import numpy as np
import pytest

from tidelight import runs
from tidelight.operators import timejoin
from tidelight.sources import sinks


def curve(rng, days, burst):
    t = 58000.0 + np.arange(days)
    v = 1 + 0.05 * rng.normal(size=days)
    v[burst : burst + 12] += 4
    return t, v


def test_folder_to_event_file(spark, tmp_path):
    rng = np.random.default_rng(2)
    for name in ("SCO_X-1", "VELA_X-1"):
        t, v = curve(rng, 200, 80)
        rows = "\n".join(f"{a},{b:.5f},0.05" for a, b in zip(t, v))
        (tmp_path / f"{name}_maxi_lc.csv").write_text("mjd,flux_2_20,err_2_20\n" + rows + "\n")
    t, v = curve(rng, 150, 40)
    rows = "\n".join(f"{a},{15 - 2.5 * np.log10(b):.5f},0.02,zg,0" for a, b in zip(t, v))
    (tmp_path / "GX_ztf.csv").write_text("mjd,mag,magerr,filtercode,catflags\n" + rows + "\n")
    out = str(tmp_path / "out")
    runs.main([str(tmp_path), out, "--n-bootstrap", "5", "--nsigma-enter", "5.0"])
    got = spark.read.option("header", True).csv(out)
    assert got.columns == sinks.OUTBURST_COLUMNS
    rows = {r.file_stem: r for r in got.collect()}
    assert len(rows) == 3 == got.count()
    for r in rows.values():
        assert 11 <= float(r.duration_days) <= 12 and int(r.n_points) >= 11
        assert (r.fap_empirical is None) == (r.band == "zg")
    args = vars(runs.parser().parse_args(["a", "b", "--skip-fap", "--rolling-baseline-days", "30"]))
    assert args["skip_fap"] is True and args["rolling_baseline_days"] == 30.0 and args["min_points"] == 4
    with pytest.raises(ValueError, match="no files"):
        runs.detect_folder(spark, str(tmp_path), xray_files="*.none", optical_files="*.none")


def test_dense_slices(spark):
    """A crowded day is cut finer, with the same pairs."""
    rng = np.random.default_rng(3)
    left = [("a", float(t), i) for i, t in enumerate(np.sort(np.concatenate([rng.uniform(3.2, 3.6, 300), rng.uniform(0, 20, 40)])))]
    right = [("a", float(t), i, float(i)) for i, t in enumerate(np.concatenate([rng.uniform(3.1, 3.7, 250), rng.uniform(0, 20, 30), [3.3, 3.3]]))]
    lf = spark.createDataFrame(left, "source string, mjd double, row_id long")
    rf = spark.createDataFrame(right, "source string, mjd double, row_id long, xf double")
    found = [sorted((r.row_id, r.r_row_id, r.dt) for r in timejoin.nearest_in_time(lf, rf, ["source"], 0.5, "row_id", slice_rows=n).collect()) for n in (100_000, 20)]
    assert found[0] == found[1] and len(found[0]) > 300
    times = np.array([r[1] for r in right])
    for row, other, dt in found[0]:
        gap = np.abs(times - left[row][1])
        assert dt == gap.min() and other == int(np.flatnonzero(gap == gap.min())[0])
