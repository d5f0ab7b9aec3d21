"""Magnitudes, fluxes, ratios and pulse formulas as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
AB_ZERO_JY = 3631.0
MAG_ERR_FACTOR = 1.0857
CRAB_COUNTS = 3.3
CRAB_CGS = 2.4e-8
RISE, DECAY = "rise", "decay"


def relative_flux(mag: Column) -> Column:
    return F.pow(F.lit(10.0), -0.4 * mag)


def relative_flux_err(mag: Column, magerr: Column) -> Column:
    return relative_flux(mag) * F.lit(math.log(10.0) * 0.4) * magerr


def flux_mjy(mag: Column) -> Column:
    return AB_ZERO_JY * relative_flux(mag) * 1000.0


def flux_mjy_err(mag: Column, magerr: Column) -> Column:
    return flux_mjy(mag) * magerr / MAG_ERR_FACTOR


def counts_to_cgs(counts: Column) -> Column:
    return counts * F.lit(CRAB_CGS / CRAB_COUNTS)


def hardness(f1: Column, f2: Column, e1: Column, e2: Column) -> list[Column]:
    """Ratio f2/f1 and its propagated error."""
    hr = F.try_divide(f2, f1)
    rel = F.sqrt(F.pow(F.try_divide(e2, f2), 2.0) + F.pow(F.try_divide(e1, f1), 2.0))
    return [hr, hr * rel]


def reprocessed(x: Column, beta: Column) -> Column:
    return F.pow(F.greatest(x, F.lit(0.0)), beta)


def unit_power(x: Column, beta: Column, floor: float = 1e-30) -> Column:
    return F.pow(F.greatest(x, F.lit(floor)), beta)


def snr_weight(snr: Column, floor: float, width: float) -> Column:
    return 1.0 / (1.0 + F.exp(-(snr - floor) / width))


def norris(t: Column, a: Column, t0: Column, tau1: Column, tau2: Column) -> Column:
    dt = t - t0
    pulse = a * F.exp(-F.try_divide(tau1, dt) - dt / tau2)
    return F.when(dt > 0, pulse).otherwise(0.0)


def aic(chi2: Column, k: Column, n: Column) -> Column:
    """Small-sample corrected information criterion."""
    return chi2 + 2 * k + (2 * k * (k + 1)) / F.greatest(n - k - 1, F.lit(1))


def reduced_chi2(chi2: Column, dof: Column) -> Column:
    return F.when(dof > 0, chi2 / dof).otherwise(F.lit(float("inf")))


def log_sigma(err: Column, flux: Column) -> Column:
    """Fractional flux error in dex."""
    return F.try_divide(err, flux) / F.lit(math.log(10.0))
