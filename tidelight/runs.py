"""One call from a folder of light curves to the file of events.

    spark-submit --py-files tidelight.zip run.py ...   or   python -m tidelight.runs FOLDER OUT --nsigma-enter 5
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DetectorConfig, PeriodConfig
from .operators import detect, report, segments
from .session import cut_lineage
from .sources import headed, readers, sinks

XRAY_FILES, OPTICAL_FILES = "*_maxi*", "*_ztf*"


def detect_folder(
    spark: SparkSession, folder: str, cfg: DetectorConfig = DetectorConfig(), period_cfg: PeriodConfig = PeriodConfig(),
    xray_files: str = XRAY_FILES, optical_files: str = OPTICAL_FILES,
) -> DataFrame:
    """Event records of all curves of a folder.

    X-ray curves are binned daily where dense; optical bands are merged exactly and may be of any length, so they
    have a global level only and no resampled false-alarm probability. Kinds without a file are left out;
    a folder without any is an error.
    """
    keys, parts = readers.KEYS, []
    if headed.headers(spark, folder, xray_files):
        based = cut_lineage(detect.with_baseline(readers.load_xray(spark, folder, xray_files), keys, cfg))
        parts.append(report.event_records(cut_lineage(detect.detect_events(based, keys, cfg)), based, keys, cfg, period_cfg))
    if headed.headers(spark, folder, optical_files):
        curves = cut_lineage(readers.load_optical_bands(spark, folder, optical_files))
        events = cut_lineage(segments.detect_long_events(curves, keys, cfg))
        paced = segments.median_gap(curves, keys)
        parts.append(report.event_records(events, curves, keys, cfg, period_cfg, paced))
    if not parts:
        raise ValueError(f"no files like {xray_files} or {optical_files} in {folder}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*sinks.OUTBURST_COLUMNS)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Detect outbursts in a folder of light curves.")
    p.add_argument("folder")
    p.add_argument("out")
    for name, field in DetectorConfig.__dataclass_fields__.items():
        flag, default = "--" + name.replace("_", "-"), field.default
        if isinstance(default, bool):
            p.add_argument(flag, action="store_true")
        else:
            p.add_argument(flag, type=int if isinstance(default, int) else float, default=default)
    p.add_argument("--fap-threshold", type=float, default=PeriodConfig().fap_threshold)
    return p


def main(argv: Sequence[str] | None = None) -> None:
    args = vars(parser().parse_args(argv))
    folder, out, threshold = args.pop("folder"), args.pop("out"), args.pop("fap_threshold")
    spark = SparkSession.builder.appName("tidelight").getOrCreate()
    events = cut_lineage(detect_folder(spark, folder, DetectorConfig(**args), PeriodConfig(fap_threshold=threshold)))
    sinks.write_outbursts(events, out)
    n, series = events.agg(F.count("*"), F.countDistinct("file_stem", "band")).first()
    print(f"{n} events in {series} curves written to {out}")


if __name__ == "__main__":
    main()
