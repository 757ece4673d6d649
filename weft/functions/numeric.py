"""Functions of numbers under NumPy's names, as column expressions; SciPy's by Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def exp2(x: Column) -> Column: return F.pow(F.lit(2.0), x)
def deg2rad(x: Column) -> Column: return F.radians(x)
def rad2deg(x: Column) -> Column: return F.degrees(x)
def arccosh(x: Column) -> Column: return F.acosh(x)
def fix(x: Column) -> Column: return F.signum(x) * F.floor(F.abs(x))
def copysign(x: Column, y: Column) -> Column: return F.when(signbit(y), -F.abs(x)).otherwise(F.abs(x))
def signbit(x: Column) -> Column: return (x < 0) | x.cast("string").startswith("-")
def fmax(x: Column, y: Column) -> Column: return F.greatest(x, y)
def fmin(x: Column, y: Column) -> Column: return F.least(x, y)
def fmod(x: Column, y: Column) -> Column: return F.try_mod(x, y)
def isclose(x: Column, y: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column: return F.abs(x - y) <= atol + rtol * F.abs(y)
def isfinite(x: Column) -> Column: return ~F.isnan(x) & (F.abs(x) != float("inf"))
def isinf(x: Column) -> Column: return F.abs(x) == float("inf")
def isnan(x: Column) -> Column: return F.isnan(x)
def nan_to_num(x: Column, nan: float = 0.0) -> Column: return F.when(x.isNull() | F.isnan(x), nan).when(x == float("inf"), 1.7976931348623157e308).when(x == float("-inf"), -1.7976931348623157e308).otherwise(x)
def ldexp(x: Column, e: Column) -> Column: return x * F.pow(F.lit(2.0), e)
def frexp(x: Column) -> Column:
    """struct<mantissa, exponent>: the mantissa is in [0.5, 1)."""
    e = F.when(x == 0, 0).otherwise(F.floor(F.log2(F.abs(x))) + 1).cast("int")
    return F.struct((x / F.pow(F.lit(2.0), e)).alias("mantissa"), e.alias("exponent"))


def modf(x: Column) -> Column: return F.struct((x - fix(x)).alias("fraction"), fix(x).cast("double").alias("whole"))
def logaddexp(x: Column, y: Column) -> Column: return F.greatest(x, y) + F.log1p(F.exp(-F.abs(x - y)))
def logaddexp2(x: Column, y: Column) -> Column: return F.greatest(x, y) + F.log1p(F.pow(F.lit(2.0), -F.abs(x - y))) / math.log(2)
def sinc(x: Column) -> Column: return F.when(x == 0, 1.0).otherwise(F.sin(math.pi * x) / (math.pi * x))
def lshift(x: Column, n: int) -> Column: return F.shiftleft(x, n)
def rshift(x: Column, n: int) -> Column: return F.shiftright(x, n)
def float_power(x: Column, y: Column) -> Column: return F.pow(x.cast("double"), y.cast("double"))


# complex numbers: struct<re, im>
def complex_(re: Column, im: Column) -> Column: return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))
def real(z: Column) -> Column: return z["re"]
def imag(z: Column) -> Column: return z["im"]
def conj(z: Column) -> Column: return complex_(z["re"], -z["im"])
def angle(z: Column) -> Column: return F.atan2(z["im"], z["re"])
def absolute(z: Column) -> Column: return F.hypot(z["re"], z["im"])


# special functions with a closed form
def expit(x: Column) -> Column: return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))
def logit(x: Column) -> Column: return F.log(F.try_divide(x, 1 - x))
def log_expit(x: Column) -> Column: return -softplus(-x)
def softplus(x: Column) -> Column: return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
def xlogy(x: Column, y: Column) -> Column: return F.when(x == 0, 0.0).otherwise(x * F.log(y))
def entr(x: Column) -> Column: return F.when(x == 0, 0.0).when(x > 0, -x * F.log(x)).otherwise(float("-inf"))
def rel_entr(x: Column, y: Column) -> Column: return F.when((x > 0) & (y > 0), x * F.log(x / y)).when((x == 0) & (y >= 0), 0.0).otherwise(float("inf"))
def kl_div(x: Column, y: Column) -> Column: return F.when((x > 0) & (y > 0), x * F.log(x / y) - x + y).when((x == 0) & (y >= 0), y.cast("double")).otherwise(float("inf"))
def poch(x: Column, n: int) -> Column:
    out = F.lit(1.0)
    for k in range(n):
        out = out * (x + k)
    return out


def softmax(v: Column) -> Column:
    """Of a row's array."""
    v = F.transform(v, lambda x: x.cast("double"))
    top = F.array_max(v)
    made = F.transform(v, lambda x: F.exp(x - top))
    total = F.aggregate(made, F.lit(0.0), lambda s, x: s + x)
    return F.transform(made, lambda x: x / total)


def _batches(f):
    def make(*columns: Column) -> Column:
        @F.pandas_udf("double")
        def run(rows: pd.DataFrame) -> pd.Series:
            return pd.Series(f(*[rows[c].to_numpy(float) for c in rows.columns]))

        return run(F.struct(*[c.cast("double").alias(f"c{k}") for k, c in enumerate(columns)]))

    return make


def special(name: str):
    """A function by SciPy's name: Python's own where it has it, else SciPy's where that is installed."""
    known = {"erf": math.erf, "erfc": math.erfc, "gamma": math.gamma, "gammaln": math.lgamma, "loggamma": math.lgamma}
    if name in known:
        return _batches(np.vectorize(known[name], otypes=[float]))
    if name == "rgamma":
        return _batches(np.vectorize(lambda x: 1 / math.gamma(x), otypes=[float]))
    if name in ("beta", "betaln"):
        log = np.vectorize(lambda a, b: math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b), otypes=[float])
        return _batches(log if name == "betaln" else lambda a, b: np.exp(log(a, b)))
    if name in ("psi", "digamma"):
        return _batches(_digamma)
    if name in _SERIES:
        return _batches(_SERIES[name])
    try:
        import scipy.special
    except ImportError as e:
        raise ImportError(f"{name} needs SciPy") from e
    return _batches(getattr(scipy.special, name))


def positive(x: Column) -> Column: return x
def fabs(x: Column) -> Column: return F.abs(x.cast("double"))
def around(x: Column, digits: int = 0) -> Column: return F.bround(x, digits)
def nextafter(x: Column, y: Column) -> Column: return _batches(np.nextafter)(x, y)
def spacing(x: Column) -> Column: return _batches(np.spacing)(x)
def i0(x: Column) -> Column: return _batches(np.i0)(x)
def isreal(z: Column) -> Column: return z["im"] == 0
def iscomplex(z: Column) -> Column: return z["im"] != 0
def set_real(z: Column, re: Column) -> Column: return complex_(re, z["im"])
def set_imag(z: Column, im: Column) -> Column: return complex_(z["re"], im)
def tree_add(*columns: Column) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def tree_multiply(*columns: Column) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out * c
    return out


# special functions by integrals, series and fractions, a batch at a time
_NODES = np.linspace(0.0, math.pi, 401)
_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erf = np.vectorize(math.erf, otypes=[float])


def _over_angles(make, *args: np.ndarray) -> np.ndarray:
    """Mean over half a turn of a smooth periodic function, by trapezoids."""
    y = make(_NODES[None, :], *[a[:, None] for a in args])
    return (y[:, 1:-1].sum(1) + (y[:, 0] + y[:, -1]) / 2) / (len(_NODES) - 1)


def _jv(n: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bessel's function of the first kind, of whole order."""
    return _over_angles(lambda t, n, x: np.cos(n * t - x * np.sin(t)), n, x)


def _iv(n: np.ndarray, x: np.ndarray) -> np.ndarray: return _over_angles(lambda t, n, x: np.exp(x * np.cos(t)) * np.cos(n * t), n, x)
def _kv(v: np.ndarray, x: np.ndarray) -> np.ndarray:
    t = np.linspace(0.0, 12.0, 2401)[None, :]
    with np.errstate(over="ignore"):
        y = np.exp(np.minimum(v[:, None] * t, 700) - x[:, None] * np.cosh(t)) + np.exp(-v[:, None] * t - x[:, None] * np.cosh(t))
    return (y[:, 1:].sum(1) + y[:, 0] / 2) * 0.005 / 2


def _agm(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Complete elliptic integrals of the first and second kind by the arithmetic-geometric mean; m is below 1."""
    a, b, s, w = np.ones_like(m), np.sqrt(1 - m), m / 2, 0.5
    for _ in range(40):
        c, a, b = (a - b) / 2, (a + b) / 2, np.sqrt(a * b)
        w *= 2
        s = s + w * c * c
    k = math.pi / (2 * a)
    return k, k * (1 - s)


def _gammainc(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The lower incomplete gamma function over the whole: a series below a + 1, a continued fraction above."""
    front = np.exp(a * np.log(np.maximum(x, 1e-300)) - x - _lgamma(a))
    term, total = 1 / a, 1 / a
    for k in range(1, 600):
        term = term * x / (a + k)
        total = total + term
    b, c = x + 1 - a, np.full_like(x, 1e300)
    d = 1 / np.where(b == 0, 1e-300, b)
    h = d
    for k in range(1, 600):
        n = -k * (k - a)
        b = b + 2
        d = 1 / (n * d + b)
        c = b + n / c
        h = h * d * c
    return np.where(x <= 0, 0.0, np.where(x < a + 1, front * total, 1 - front * h))


def _betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The incomplete beta function over the whole, by a continued fraction on the side where it converges."""
    turn = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(np.maximum(z, 1e-300)) + q * np.log1p(-np.minimum(z, 1 - 1e-16))) / p
    c, d = np.ones_like(z), 1 / (1 - (p + q) * z / (p + 1))
    h = d
    for m in range(1, 300):
        for n in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 / (1 + n * d), 1 + n / c
            h = h * d * c
    made = np.where(z <= 0, 0.0, front * h)
    return np.where(turn, 1 - made, made)


def _erfinv(y: np.ndarray) -> np.ndarray:
    """Newton's steps from an estimate by logarithms."""
    w = np.log(np.maximum(1 - y * y, 1e-300))
    t = 2 / (math.pi * 0.147) + w / 2
    x = np.sign(y) * np.sqrt(np.sqrt(t * t - w / 0.147) - t)
    for _ in range(4):
        x = x - (_erf(x) - y) * math.sqrt(math.pi) / 2 * np.exp(np.minimum(x * x, 700))
    return np.where(np.abs(y) >= 1, np.sign(y) * np.inf, x)


def _dawsn(x: np.ndarray) -> np.ndarray:
    """Dawson's integral by Rybicki's sum of exponentials."""
    h = 0.2
    n = np.arange(-61, 62, 2)[None, :]
    even = 2 * np.round(x / (2 * h))[:, None]
    return (np.exp(-((x[:, None] - (even + n) * h) ** 2)) / (even + n)).sum(1) / math.sqrt(math.pi)


def _hyper(top: list[np.ndarray], bottom: list[np.ndarray], z: np.ndarray) -> np.ndarray:
    """A hypergeometric series: where it converges, 600 terms."""
    term = total = np.ones_like(z)
    for k in range(600):
        for a in top:
            term = term * (a + k)
        for b in bottom:
            term = term / (b + k)
        term = term * z / (k + 1)
        total = total + term
    return total


def _polygamma(n: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sums up to 20, then the rest by Euler and Maclaurin."""
    out, at = np.zeros_like(x), x.copy()
    for _ in range(20):
        out = out + at ** -(n + 1)
        at = at + 1
    rest = at**-n / n + at ** -(n + 1) / 2 + (n + 1) * at ** -(n + 2) / 12 - (n + 1) * (n + 2) * (n + 3) * at ** -(n + 4) / 720 + (n + 1) * (n + 2) * (n + 3) * (n + 4) * (n + 5) * at ** -(n + 6) / 30240
    made = np.where(n % 2 == 1, 1.0, -1.0) * np.exp(_lgamma(n + 1)) * (out + rest)
    return np.where(n == 0, _digamma(x), made)


_SERIES = {
    "jv": _jv, "iv": _iv, "kv": _kv, "kn": _kv, "jve": _jv,
    "ive": lambda n, x: _iv(n, x) * np.exp(-np.abs(x)), "kve": lambda v, x: _kv(v, x) * np.exp(x),
    "ellipk": lambda m: _agm(m)[0], "ellipkm1": lambda p: _agm(1 - p)[0], "ellipe": lambda m: _agm(m)[1],
    "gammainc": _gammainc, "gammaincc": lambda a, x: 1 - _gammainc(a, x), "gammasgn": lambda x: np.where((x > 0) | (np.floor(x) % 2 == 0), 1.0, -1.0),
    "betainc": _betainc, "erfinv": _erfinv, "erfcinv": lambda y: _erfinv(1 - y), "erfcx": lambda x: np.exp(x * x) * (1 - _erf(x)) if not (x > 5).any() else np.where(x > 5, _kummer_erfcx(np.maximum(x, 5.0)), np.exp(np.minimum(x, 5.0) ** 2) * (1 - _erf(np.minimum(x, 5.0)))),
    "dawsn": _dawsn, "erfi": lambda x: 2 / math.sqrt(math.pi) * np.exp(x * x) * _dawsn(x),
    "polygamma": _polygamma, "multigammaln": lambda a, d: np.array([p * (p - 1) / 4 * math.log(math.pi) + sum(math.lgamma(x - j / 2) for j in range(int(p))) for x, p in zip(a, d)]),
    "hyp0f1": lambda b, z: _hyper([], [b], z), "hyp1f1": lambda a, b, z: _hyper([a], [b], z), "hyp2f1": lambda a, b, c, z: _hyper([a, b], [c], z),
}


def _kummer_erfcx(x: np.ndarray) -> np.ndarray:
    """exp(x * x) erfc(x) for large x, by a continued fraction from its end."""
    f = x
    for k in range(60, 0, -1):
        f = x + k / 2 / f
    return 1 / (f * math.sqrt(math.pi))


def _digamma(x: np.ndarray) -> np.ndarray:
    """Recurrence up to 10, then the asymptotic series; for positive values."""
    x, out = x.astype(float).copy(), np.zeros(len(x))
    while (low := x < 10).any():
        out[low] -= 1 / x[low]
        x[low] += 1
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))
