"""Model functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def line(x, m=1.0, c=0.0) -> Column:
    return _c(m) * _c(x) + _c(c)


def line_inv(y, m=1.0, c=0.0) -> Column:
    return (_c(y) - _c(c)) / _c(m)


def exp_decay(t, k=1.0) -> Column:
    return F.exp(-_c(k) * _c(t))


def exp_decay_log(t, k=1.0) -> Column:
    return -_c(k) * _c(t)


def kww(t, tau=1.0, beta=1.0) -> Column:
    """Stretched exponential."""
    return F.exp(-F.pow(_c(t) / _c(tau), _c(beta)))


def burr12_sf(t, tau=1.0, beta=1.0, delta=1.0) -> Column:
    """Survival function of the Burr XII distribution."""
    return 1 / F.pow(1 + F.pow(_c(t) / _c(tau), _c(beta)), _c(delta))


def burr12_sf_alt(t, tau=1.0, beta=1.0, d=1.0) -> Column:
    """The same with delta = d / beta."""
    return 1 / F.pow(1 + F.pow(_c(t) / _c(tau), _c(beta)), _c(d) / _c(beta))


def power_law(x, a=1.0, b=1.0) -> Column:
    return _c(a) * F.pow(_c(x), _c(b))


def msd(t, D, d: int = 3) -> Column:
    """Einstein's relation."""
    return 2 * d * _c(D) * _c(t)


def msd_non_diffusive(t, a, x) -> Column:
    return _c(a) * F.pow(_c(t), _c(x))


def gaussian(x, mu=0.0, sigma=1.0) -> Column:
    s = _c(sigma)
    return F.exp(-0.5 * F.pow((_c(x) - _c(mu)) / s, F.lit(2.0))) / (F.sqrt(F.lit(2 * math.pi)) * s)


def exp_dist(x, rate=1.0) -> Column:
    return _c(rate) * F.exp(-_c(rate) * _c(x))


def exp_dist_log(x, rate) -> Column:
    return F.log(_c(rate)) - _c(rate) * _c(x)


#: Boltzmann's constant in J / K.
BOLTZMANN = 1.380649e-23


def mb_dist(v, var=None, temp: float | None = None, mass: float | None = None, drift=0.0, d: int = 3) -> Column:
    """Maxwell-Boltzmann speed distribution in d dimensions; var is kT/m, else made of temp (K) and mass (kg)."""
    if (var is None) == (temp is None or mass is None):
        raise ValueError("give either var, or temp and mass")
    s2 = _c(var) if var is not None else F.lit(BOLTZMANN * temp / mass)
    speed = _c(v) - _c(drift)
    area = 2 * math.pi ** (d / 2) / math.gamma(d / 2)
    return area * F.pow(2 * math.pi * s2, F.lit(-d / 2)) * F.pow(speed, F.lit(float(d - 1))) * F.exp(-speed * speed / (2 * s2))


def ekin_dist(ekin, kt, d: int = 3) -> Column:
    """Distribution of kinetic energies in d dimensions at thermal energy kt (the same unit)."""
    e, k = _c(ekin), _c(kt)
    return F.pow(k, F.lit(-d / 2)) / math.gamma(d / 2) * F.pow(e, F.lit(d / 2 - 1)) * F.exp(-e / k)


def gamma(x) -> Column:
    """The gamma function for x > 0, by Stirling's series shifted by 7."""
    x = _c(x)
    z = x + 7
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3.0))) + 1 / (1260 * F.pow(z, F.lit(5.0)))
    shifted = F.exp((z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series)
    down = F.lit(1.0)
    for k in range(7):
        down = down * (x + k)
    return shifted / down


def kww_mean(tau, beta) -> Column:
    """tau / beta * Gamma(1 / beta), the mean of a stretched exponential."""
    return _c(tau) / _c(beta) * gamma(1 / _c(beta))


def burr12_mean(tau, beta, delta) -> Column:
    """tau * Gamma(delta - 1 / beta) * Gamma(1 + 1 / beta) / Gamma(delta), null unless beta * delta > 1."""
    shape = 1 / _c(beta)
    return F.when(_c(beta) * _c(delta) > 1, _c(tau) * gamma(_c(delta) - shape) * gamma(1 + shape) / gamma(_c(delta)))


def skewness(mu2, mu3) -> Column:
    return _c(mu3) / F.pow(_c(mu2), F.lit(1.5))


def kurtosis(mu2, mu4) -> Column:
    return _c(mu4) / (_c(mu2) * _c(mu2)) - 3


def fourier_to_rb(f: list[Column]) -> list[Column]:
    """Six Ryckaert-Bellemans coefficients of four Fourier ones."""
    if len(f) != 4:
        raise ValueError("four coefficients are needed")
    c0, c1, c2, c3 = f
    return [c1 + 0.5 * (c0 + c2), 0.5 * (3 * c2 - c0), -c1 + 4 * c3, -2 * c2, -4 * c3, F.lit(0.0)]


def rb_to_fourier(r: list[Column], tolerance: float = 1e-5) -> list[Column]:
    """The inverse; null where the six do not come from four."""
    if len(r) != 6:
        raise ValueError("six coefficients are needed")
    fits = F.abs(sum(r[1:5], r[0])) <= tolerance
    out = [-2 * r[1] - 1.5 * r[3], -r[2] - r[4], -0.5 * r[3], -0.25 * r[4]]
    return [F.when(fits, x) for x in out]
