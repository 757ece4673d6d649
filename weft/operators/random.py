"""Seeded random columns.  Values come from a hash of a row's keys, so they don't depend on partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

_UNIT = float(1 << 53)


def uniform(keys: list[str], seed: int = 0, low: float = 0.0, high: float = 1.0) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)), 11)
    return F.lit(low) + (bits + 0.5) / _UNIT * (high - low)


def normal(keys: list[str], seed: int = 0, mean: float = 0.0, std: float = 1.0) -> Column:
    """Box and Muller's transform of two uniform values."""
    u, v = uniform(keys, 2 * seed), uniform(keys, 2 * seed + 1)
    return F.lit(mean) + std * F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def exponential(keys: list[str], seed: int = 0, scale: float = 1.0) -> Column: return -scale * F.log(uniform(keys, seed))
def laplace(keys: list[str], seed: int = 0, loc: float = 0.0, scale: float = 1.0) -> Column:
    u = uniform(keys, seed) - 0.5
    return F.lit(loc) - scale * F.signum(u) * F.log(1 - 2 * F.abs(u))


def logistic(keys: list[str], seed: int = 0, loc: float = 0.0, scale: float = 1.0) -> Column:
    u = uniform(keys, seed)
    return F.lit(loc) + scale * F.log(u / (1 - u))


def gumbel(keys: list[str], seed: int = 0, loc: float = 0.0, scale: float = 1.0) -> Column: return F.lit(loc) - scale * F.log(-F.log(uniform(keys, seed)))
def pareto(keys: list[str], seed: int = 0, a: float = 1.0) -> Column: return F.pow(uniform(keys, seed), -1 / a) - 1
def power(keys: list[str], seed: int = 0, a: float = 1.0) -> Column: return F.pow(uniform(keys, seed), F.lit(1 / a))
def rayleigh(keys: list[str], seed: int = 0, scale: float = 1.0) -> Column: return scale * F.sqrt(-2 * F.log(uniform(keys, seed)))
def weibull(keys: list[str], seed: int = 0, a: float = 1.0) -> Column: return F.pow(-F.log(uniform(keys, seed)), F.lit(1 / a))
def cauchy(keys: list[str], seed: int = 0) -> Column: return F.tan(math.pi * (uniform(keys, seed) - 0.5))
def lognormal(keys: list[str], seed: int = 0, mean: float = 0.0, sigma: float = 1.0) -> Column: return F.exp(normal(keys, seed, mean, sigma))
def triangular(keys: list[str], left: float, mode: float, right: float, seed: int = 0) -> Column:
    u, c = uniform(keys, seed), (mode - left) / (right - left)
    return F.when(u < c, left + F.sqrt(u * (right - left) * (mode - left))).otherwise(right - F.sqrt((1 - u) * (right - left) * (right - mode)))


def integers(keys: list[str], low: int, high: int, seed: int = 0) -> Column: return F.floor(uniform(keys, seed, low, high)).cast("bigint")
def bernoulli(keys: list[str], p: float, seed: int = 0) -> Column: return (uniform(keys, seed) < p).cast("int")
def geometric(keys: list[str], p: float, seed: int = 0) -> Column: return F.ceil(F.log(uniform(keys, seed)) / math.log(1 - p)).cast("bigint")
def binomial(keys: list[str], n: int, p: float, seed: int = 0) -> Column:
    """Sum of ``n`` trials, each with its own hash."""
    out = F.lit(0)
    for k in range(n):
        out = out + bernoulli(keys, p, seed * 1000 + k)
    return out


def choice(keys: list[str], values: list, seed: int = 0) -> Column: return F.element_at(F.array(*[F.lit(v) for v in values]), F.floor(uniform(keys, seed) * len(values)).cast("int") + 1)
def permutation(keys: list[str], seed: int = 0) -> Column:
    """A key to sort by."""
    return F.xxhash64(*[F.col(k) for k in keys], F.lit(seed))


# ---- from several uniform values of a row
def random_sample(keys: list[str], seed: int = 0) -> Column: return uniform(keys, seed)
def standard_exponential(keys: list[str], seed: int = 0) -> Column: return exponential(keys, seed)
def standard_cauchy(keys: list[str], seed: int = 0) -> Column: return cauchy(keys, seed)
def gamma(keys: list[str], shape: float, scale: float = 1.0, seed: int = 0) -> Column:
    """Marsaglia and Tsang's squeeze: the first of 12 trials that is accepted (all fail once in 1e15 rows, which then get a middle value)."""
    a = shape if shape >= 1 else shape + 1
    d = a - 1 / 3
    c = 1 / math.sqrt(9 * d)
    tries = []
    for k in range(12):
        x, u = normal(keys, 1000 * seed + 3 * k + 1), uniform(keys, 1000 * seed + 3 * k + 500_000_000)
        v = F.pow(1 + c * x, F.lit(3.0))
        tries.append(F.when((v > 0) & (F.log(u) < 0.5 * x * x + d - d * v + d * F.log(v)), d * v))
    made = F.coalesce(*tries, F.lit(d))
    if shape < 1:
        made = made * F.pow(uniform(keys, 1000 * seed + 999), F.lit(1 / shape))
    return scale * made


def standard_gamma(keys: list[str], shape: float, seed: int = 0) -> Column: return gamma(keys, shape, 1.0, seed)
def chisquare(keys: list[str], df: float, seed: int = 0) -> Column: return gamma(keys, df / 2, 2.0, seed)
def beta(keys: list[str], a: float, b: float, seed: int = 0) -> Column:
    x, y = gamma(keys, a, 1.0, 2 * seed), gamma(keys, b, 1.0, 2 * seed + 1)
    return x / (x + y)


def dirichlet(keys: list[str], alpha: list[float], seed: int = 0) -> Column:
    parts = F.array(*[gamma(keys, a, 1.0, len(alpha) * seed + k) for k, a in enumerate(alpha)])
    return F.transform(parts, lambda x: x / F.aggregate(parts, F.lit(0.0), lambda s, y: s + y))


def f(keys: list[str], dfnum: float, dfden: float, seed: int = 0) -> Column: return (chisquare(keys, dfnum, 2 * seed) / dfnum) / (chisquare(keys, dfden, 2 * seed + 1) / dfden)
def standard_t(keys: list[str], df: float, seed: int = 0) -> Column: return normal(keys, seed) / F.sqrt(chisquare(keys, df, seed + 7) / df)
def noncentral_chisquare(keys: list[str], df: float, nonc: float, seed: int = 0) -> Column:
    """Of more than one degree of freedom: one shifted square and the rest."""
    shifted = F.pow(normal(keys, seed) + math.sqrt(nonc), F.lit(2.0))
    return shifted + chisquare(keys, df - 1, seed + 7) if df > 1 else shifted


def noncentral_f(keys: list[str], dfnum: float, dfden: float, nonc: float, seed: int = 0) -> Column: return (noncentral_chisquare(keys, dfnum, nonc, 2 * seed) / dfnum) / (chisquare(keys, dfden, 2 * seed + 101) / dfden)
def wald(keys: list[str], mean: float, scale: float, seed: int = 0) -> Column:
    y = F.pow(normal(keys, seed), F.lit(2.0))
    x = mean + mean * mean * y / (2 * scale) - mean / (2 * scale) * F.sqrt(4 * mean * scale * y + mean * mean * y * y)
    return F.when(uniform(keys, seed + 7) <= mean / (mean + x), x).otherwise(mean * mean / x)


def vonmises(keys: list[str], mu: float, kappa: float, seed: int = 0) -> Column:
    """Best and Fisher's rejection: the first of 32 trials that is accepted."""
    tau = 1 + math.sqrt(1 + 4 * kappa * kappa)
    rho = (tau - math.sqrt(2 * tau)) / (2 * kappa)
    r = (1 + rho * rho) / (2 * rho)
    tries = []
    for k in range(32):
        z = F.cos(math.pi * uniform(keys, 1000 * seed + 3 * k))
        w = (1 + r * z) / (r + z)
        c, u = kappa * (r - w), uniform(keys, 1000 * seed + 3 * k + 1)
        tries.append(F.when((c * (2 - c) - u > 0) | (F.log(c / u) + 1 - c >= 0), F.signum(uniform(keys, 1000 * seed + 3 * k + 2) - 0.5) * F.acos(w)))
    turned = F.coalesce(*tries, F.lit(0.0)) + mu + math.pi
    return turned - 2 * math.pi * F.floor(turned / (2 * math.pi)) - math.pi


def multivariate_normal(keys: list[str], mean: list[float], cov: list[list[float]], seed: int = 0) -> Column:
    import numpy as np

    root = np.linalg.cholesky(np.array(cov, float))
    z = [normal(keys, len(mean) * seed + k + 11) for k in range(len(mean))]
    rows = []
    for m, w in zip(mean, root.tolist()):
        x = F.lit(float(m))
        for a, b in zip(w, z):
            x = x + F.lit(float(a)) * b
        rows.append(x)
    return F.array(*rows)


# ---- whole numbers: the place of a uniform value among cumulated probabilities
def _discrete(keys: list[str], chances: list[float], seed: int, first: int = 0) -> Column:
    """``first`` + k with chance ``chances[k]``; they end where the rest is below 1e-15."""
    total, edges = 0.0, []
    for p in chances:
        total += p
        edges.append(total)
    u = uniform(keys, seed)
    return (F.lit(first) + F.size(F.filter(F.array(*[F.lit(e) for e in edges[:-1]]), lambda e: e < u))).cast("bigint")


def _until(chance, most: int = 20_000) -> list[float]:
    """Chances of 0, 1, 2, ... until nothing is left that matters."""
    out, total = [], 0.0
    for k in range(most):
        out.append(chance(k))
        total += out[-1]
        if total > 1 - 1e-15 or (total > 0.999 and out[-1] < 1e-18):
            return out
    raise ValueError("spreads too far for a table of chances")


def poisson(keys: list[str], lam: float, seed: int = 0) -> Column: return _discrete(keys, _until(lambda k: math.exp(k * math.log(lam) - lam - math.lgamma(k + 1))), seed)
def negative_binomial(keys: list[str], n: float, p: float, seed: int = 0) -> Column: return _discrete(keys, _until(lambda k: math.exp(math.lgamma(n + k) - math.lgamma(n) - math.lgamma(k + 1) + n * math.log(p) + k * math.log1p(-p))), seed)
def hypergeometric(keys: list[str], good: int, bad: int, sample: int, seed: int = 0) -> Column: return _discrete(keys, [math.comb(good, k) * math.comb(bad, sample - k) / math.comb(good + bad, sample) if sample - k >= 0 else 0.0 for k in range(min(good, sample) + 1)], seed)
def logseries(keys: list[str], p: float, seed: int = 0) -> Column: return _discrete(keys, _until(lambda k: -(p ** (k + 1)) / ((k + 1) * math.log1p(-p))), seed, 1)
def zipf(keys: list[str], a: float, seed: int = 0) -> Column:
    """Devroye's rejection: the first of 32 trials that is accepted."""
    b = 2 ** (a - 1)
    tries = []
    for k in range(32):
        u, v = uniform(keys, 1000 * seed + 2 * k), uniform(keys, 1000 * seed + 2 * k + 1)
        x = F.floor(F.least(F.pow(u, F.lit(-1 / (a - 1))), F.lit(9e18)))
        t = F.pow(1 + 1 / x, F.lit(a - 1.0))
        tries.append(F.when(v * x * (t - 1) / (b - 1) <= t / b, x))
    return F.coalesce(*tries, F.lit(1)).cast("bigint")


def multinomial(keys: list[str], n: int, chances: list[float], seed: int = 0) -> Column:
    """How many of ``n`` draws fell on each."""
    draws = F.array(*[_discrete(keys, chances, 1000 * seed + k) for k in range(n)])
    return F.array(*[F.size(draws) - F.size(F.array_remove(draws, j)) for j in range(len(chances))])


def random_bytes(keys: list[str], length: int, seed: int = 0) -> Column:
    parts = [F.unhex(F.sha2(F.concat_ws(",", *[F.col(k).cast("string") for k in keys], F.lit(f"{seed}:{i}")).cast("binary"), 256)) for i in range(-(-length // 32))]
    return F.substring(F.concat(*parts), 1, length)
