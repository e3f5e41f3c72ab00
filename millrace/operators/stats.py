"""Small models: standardising, ridge regression, and generalised linear models.

Every fit is a sum over rows (a Gram matrix and right-hand sides), so one aggregation
a step goes over the data and the driver solves a system of as many unknowns as
there are predictors. Nothing else leaves the executors.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.ranking import ranges
from millrace.session import staged


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replaces columns by (x - mean) / population deviation; a deviation of 0 counts as 1."""
    moments = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.crossJoin(F.broadcast(moments))  # one row
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in columns}
    return out.withColumns(scaled).select(*df.columns)


def medians(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The exact median of each group, however many rows it has: by, n and median (the mean of the two middle values).

    Rows are cut into ranges in the order of group and value; the sizes of a group's ranges, summed
    up, say in which ranges its middle rows are, and only there rows are counted off. No task
    holds a group, and no buffer all its values. Nulls are left out.
    """
    placed = ranges(df.select(*by, value).where(F.col(value).isNotNull()), by, value)
    here, group = ["_range", *by], Window.partitionBy(*by)
    sizes = placed.groupBy(*here).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = sizes.withColumns({"_before": before, "n": F.sum("_n").over(group)})
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    wanted = marked.where((F.col("_before") <= high) & (F.col("_before") + F.col("_n") > low)).select(*[F.col(c).alias(f"_w{i}") for i, c in enumerate(here)], "n", (low - F.col("_before")).alias("_low"), (high - F.col("_before")).alias("_high"))
    met = placed.join(wanted, [F.col(c).eqNullSafe(F.col(f"_w{i}")) for i, c in enumerate(here)])  # two ranges a group at most
    counted = met.withColumn("_at", F.row_number().over(Window.partitionBy(*here).orderBy(value)) - 1)
    return counted.where((F.col("_at") == F.col("_low")) | (F.col("_at") == F.col("_high"))).groupBy(*by).agg(F.max("n").alias("n"), F.avg(value).alias("median"))


def gram(df: DataFrame, terms: list[Column], target: Column, weight: Column | None = None, more: dict[str, Column] | None = None):
    """Weighted X'X, X'y and further sums of rows, by one aggregation."""
    w = F.lit(1.0) if weight is None else weight
    p = len(terms)
    sums = [F.sum(w * terms[i] * terms[j]).alias(f"a{i}_{j}") for i in range(p) for j in range(i, p)]
    sums += [F.sum(w * terms[i] * target).alias(f"b{i}") for i in range(p)]
    sums += [F.sum(c).alias(k) for k, c in (more or {}).items()]
    row = df.agg(*sums).first()
    a = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            a[i, j] = a[j, i] = row[f"a{i}_{j}"] or 0.0
    return a, np.array([row[f"b{i}"] or 0.0 for i in range(p)]), {k: row[k] for k in more or {}}


class Ridge:
    """Weights on standardised predictors and an intercept that is not penalised."""

    def __init__(self, columns: list[str], means: np.ndarray, scales: np.ndarray, weights: np.ndarray, intercept: float):
        self.columns, self.means, self.scales, self.weights, self.intercept = columns, means, scales, weights, intercept

    def score(self) -> Column:
        z = F.lit(float(self.intercept))
        for c, m, s, w in zip(self.columns, self.means, self.scales, self.weights, strict=True):
            z = z + (F.col(c).cast("double") - float(m)) / float(s) * float(w)
        return z


def fit_ridge(df: DataFrame, columns: list[str], target: str, alpha: float) -> Ridge:
    """Least squares plus alpha times the squared weights of population-standardised predictors."""
    x = [F.col(c).cast("double") for c in columns]
    a, b, s = gram(df, [F.lit(1.0), *x], F.col(target).cast("double"))
    n = a[0, 0]
    if not n:
        return Ridge(columns, np.zeros(len(columns)), np.ones(len(columns)), np.zeros(len(columns)), 0.0)
    means = a[0, 1:] / n
    centred = a[1:, 1:] - n * np.outer(means, means)
    scales = np.sqrt(np.maximum(np.diag(centred), 0) / n)
    scales[scales == 0] = 1.0
    right = (b[1:] - means * b[0]) / scales
    system = centred / np.outer(scales, scales) + alpha * np.eye(len(columns))
    return Ridge(columns, means, scales, np.linalg.solve(system, right), b[0] / n)


def _linear(columns: list[str], beta: np.ndarray) -> Column:
    z = F.lit(float(beta[0]))
    for c, w in zip(columns, beta[1:], strict=True):
        z = z + F.col(c) * float(w)
    return z


#: Of a standard normal distribution, 97.5 % are below.
_BOUND = 1.959963984540054


class NotConverged(ValueError):
    """A fit that has not reached its optimum, or that has none."""


def _table(df: DataFrame, names: list[str], beta: np.ndarray, errors: np.ndarray, facts: dict[str, float]) -> DataFrame:
    """Estimates with robust errors, two-sided p-values and limits of 95 % by the normal distribution; then facts of the fit."""
    rows = []
    for k, b, e in zip(names, beta, errors, strict=True):
        b, e = float(b), float(e)
        rows.append((k, b, e, math.erfc(abs(b / e) / math.sqrt(2)) if e else 0.0, b - _BOUND * e, b + _BOUND * e))
    rows += [(k, float(v), None, None, None, None) for k, v in facts.items()]
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, robust_error double, p_value double, confidence_low double, confidence_high double")


def _sandwich(df: DataFrame, terms: list[Column], hessian: np.ndarray, residual: Column) -> np.ndarray:
    """Robust (HC0) standard errors: the inverse Hessian around the squared scores."""
    meat, _, _ = gram(df, terms, F.lit(0.0), residual * residual)
    bread = np.linalg.inv(hessian)
    return np.sqrt(np.diag(bread @ meat @ bread))


def _rates(df: DataFrame, rate: Column) -> dict[str, float]:
    """The number of rows and the range of predicted rates."""
    row = df.agg(F.count("*").alias("n"), F.min(rate).alias("a"), F.max(rate).alias("b")).first()
    return {"observations": row["n"], "predicted_rate_min": row["a"], "predicted_rate_max": row["b"]}


def _solved(hessian: np.ndarray, score: np.ndarray, what: str) -> np.ndarray:
    try:
        step = np.linalg.solve(hessian, score)
    except np.linalg.LinAlgError:
        raise NotConverged(f"{what}: the predictors are not independent") from None
    if not np.isfinite(step).all():
        raise NotConverged(f"{what}: a step is not finite")
    return step


def log_rising(x: Column | float, y: Column) -> Column:
    """ln(gamma(x + y) / gamma(x)) for x > 0 and y >= 0: Stirling's series from x + 10 on, and ten steps down from there."""
    x = F.lit(x) if isinstance(x, float) else x
    z = x + 10.0
    series = lambda v: 1 / (12 * v) - 1 / (360 * v * v * v) + 1 / (1260 * v * v * v * v * v)
    steps = y / x + 1.0
    for i in range(1, 10):
        steps = steps * (y / (x + float(i)) + 1.0)
    return (z - 0.5) * F.log1p(y / z) + y * F.ln(z + y) - y + series(z + y) - series(z) - F.ln(steps)


#: How far up arguments are taken before the series below are used, whose next terms are then under 1e-15.
_SHIFT = 10
#: The coefficients, by powers of 1 / z squared, of the asymptotic series of digamma (after ln z - 1 / (2 z)).
_DIGAMMA = (-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132)


def _tail(z: Column) -> Column:
    """digamma(z) - ln(z) for z of 10 or more."""
    w = 1 / (z * z)
    series = F.lit(0.0)
    for c in reversed(_DIGAMMA):
        series = (series + c) * w
    return series - 0.5 / z


def _tail_slope(z: Column) -> Column:
    """trigamma(z) for z of 10 or more: the same series, term by term."""
    w = 1 / (z * z)
    series = F.lit(0.0)
    for i, c in reversed(list(enumerate(_DIGAMMA, 1))):
        series = (series - 2 * i * c) * w
    return (1 + series) / z + 0.5 * w


def digamma_rise(x: Column, y: Column) -> Column:
    """digamma(x + y) - digamma(x) for x > 0 and y >= 0, as a sum of small terms and not as a difference of large ones."""
    z = x + float(_SHIFT)
    steps = F.lit(0.0)
    for i in range(_SHIFT):
        steps = steps + y / ((x + float(i)) * (x + y + float(i)))
    return F.log1p(y / z) + _tail(z + y) - _tail(z) + steps


def trigamma_rise(x: Column, y: Column) -> Column:
    """trigamma(x + y) - trigamma(x)."""
    z = x + float(_SHIFT)
    steps = F.lit(0.0)
    for i in range(_SHIFT):
        u = x + float(i)
        steps = steps + y * (2 * u + y) / (u * u * (u + y) * (u + y))
    return _tail_slope(z + y) - _tail_slope(z) - steps


def _log1p_rest(u: Column) -> Column:
    """log1p(u) - u for u > -1; near 0 by a series in u / (2 + u), since the difference would keep few digits."""
    r = u / (u + 2.0)
    w = r * r
    series = F.lit(0.0)
    for i in range(10, 0, -1):
        series = (series + 2.0 / (2 * i + 1)) * w
    return F.when(F.abs(u) < 0.25, r * (series - u)).otherwise(F.log1p(u) - u)


def _stirling(z: Column) -> Column:
    """ln(gamma(z)) less (z - 1/2) ln(z) - z + ln(2 pi) / 2, for z of 10 or more."""
    w = 1 / (z * z)
    return (((F.lit(1 / 1188) * w - 1 / 1680) * w + 1 / 1260) * w - 1 / 360) * w / z + 1 / (12 * z)


def _nb2_terms(theta: float, y: Column, mu: Column) -> tuple[Column, Column, Column]:
    """A count's log likelihood under variance mu + mu^2 / theta, with its slope and curvature in theta.

    Sums of terms that are small themselves: with counts of millions the terms of the usual
    formulas cancel but for their last digits, and what is left is their rounding. So they serve
    small thetas only, and the likelihood of small counts.
    """
    t, u = F.lit(theta), (y - mu) / (mu + theta)
    plain = log_rising(t, y) - log_rising(1.0, y) - y * F.log1p(theta / mu) - theta * F.log1p(mu / theta)
    if theta < _SHIFT:
        first = digamma_rise(t, y) - F.log1p(mu / theta) - u
        second = trigamma_rise(t, y) + mu / (theta * (mu + theta)) + u / (mu + theta)
        return plain, first, second
    # The saddle point: two deviances, and what Stirling's formula leaves.
    deviance = lambda x, own: own * (x * F.log1p(x) + _log1p_rest(x))
    saddle = deviance(u, mu + theta) - deviance((y - mu) / mu, mu) - 0.5 * F.ln(2 * math.pi * y * (y / theta + 1.0)) + _stirling(y + theta) - _stirling(t) - _stirling(y)
    first = _log1p_rest(u) + _tail(y + theta) - _tail(t)
    second = u * u / (y + theta) + (_tail_slope(y + theta) - 1 / (y + theta)) - (_tail_slope(t) - 1 / theta)
    return F.when(y < _SHIFT, plain).otherwise(saddle), first, second


def poisson_glm(df: DataFrame, y: str, exposure: str, columns: list[str], steps: int = 50) -> DataFrame:
    """Log-linear counts with log(exposure) as offset: estimates, robust errors, limits, dispersion and AIC."""
    df = staged(df.select(y, exposure, *columns), "glm")
    beta, hessian = _poisson_weights(df, y, exposure, columns, steps)
    terms = [F.lit(1.0), *[F.col(c) for c in columns]]
    rate = F.exp(_linear(columns, beta))
    mu = F.col(exposure) * rate
    factorial = log_rising(1.0, F.col(y).cast("double"))  # ln y!
    facts = df.agg(F.sum(F.pow(F.col(y) - mu, 2) / mu).alias("pearson"), F.sum(F.col(y) * F.ln(mu) - mu - factorial).alias("ll"), F.count("*").alias("n")).first()
    errors = _sandwich(df, terms, hessian, F.col(y) - mu)
    return _table(df, ["intercept", *columns], beta, errors, {
        "pearson_dispersion": facts["pearson"] / max(facts["n"] - len(beta), 1), "log_likelihood": facts["ll"], "aic": 2 * len(beta) - 2 * facts["ll"], **_rates(df, rate),
    })


def _poisson_weights(df: DataFrame, y: str, exposure: str, columns: list[str], steps: int) -> tuple[np.ndarray, np.ndarray]:
    """The weights of a log-linear model of counts, and the Hessian there."""
    terms = [F.lit(1.0), *[F.col(c) for c in columns]]
    offset = F.ln(F.col(exposure))
    total = df.agg(F.sum(y), F.sum(exposure)).first()
    if not total[0] or not total[1]:
        raise NotConverged("poisson: no counts")
    beta = np.array([math.log(total[0] / total[1]), *[0.0] * len(columns)])
    for _ in range(steps):
        mu = F.exp(offset + _linear(columns, beta))
        hessian, score, _ = gram(df, terms, (F.col(y) - mu) / mu, mu)
        step = _solved(hessian, score, "poisson")
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            return beta, hessian
    raise NotConverged(f"poisson: {steps} steps were not enough")


def nb2_glm(df: DataFrame, y: str, exposure: str, columns: list[str], steps: int = 60) -> DataFrame:
    """Counts with variance mu + alpha mu^2 by maximum likelihood: estimates with robust errors, for alpha too.

    Newton's method for the weights and ln(alpha) together, from the Poisson weights and a
    moment estimate of alpha: a step is one aggregation for the likelihood, its slopes and
    curvatures, and is halved while the likelihood falls by more than rounding. Ends when no step is above 1e-10;
    data that vary less than Poisson counts have no such optimum and are refused.
    """
    df = staged(df.select(F.col(y).cast("double").alias(y), F.col(exposure).cast("double").alias(exposure), *columns), "glm")
    terms = [F.lit(1.0), *[F.col(c) for c in columns]]
    names = ["intercept", *columns]
    p = len(terms)
    beta, _ = _poisson_weights(df, y, exposure, columns, 50)
    mu = F.col(exposure) * F.exp(_linear(columns, beta))
    moment, rows, least = df.agg(F.sum(F.pow(F.col(y) - mu, 2) - mu) / F.sum(mu * mu), F.count("*"), -18 - F.ln(F.greatest(F.avg(mu), F.lit(1.0)))).first()
    at = np.append(beta, math.log(min(max(moment, 1e-3), 10.0)))

    def slopes(x: np.ndarray) -> tuple[Column, Column, Column, Column, Column, Column, Column]:
        """By row: likelihood, its slope and curvature in the linear term, both mixed, slope and curvature in ln(alpha), and mu."""
        alpha = math.exp(x[p])
        theta, n = 1 / alpha, F.col(y)
        mu = F.col(exposure) * F.exp(_linear(columns, x[:p]))
        some = 1 + alpha * mu
        value, first, second = _nb2_terms(theta, n, mu)
        return value, (n - mu) / some, -mu * (1 + alpha * n) / (some * some), -(n - mu) * mu * alpha / (some * some), -theta * first, theta * first + theta * theta * second, mu

    def totals(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        value, s, c, mixed, sa, ca, _ = slopes(x)
        rows = {f"a{i}_{j}": F.sum(c * terms[i] * terms[j]) for i in range(p) for j in range(i, p)}
        rows |= {f"s{i}": F.sum(s * terms[i]) for i in range(p)} | {f"m{i}": F.sum(mixed * terms[i]) for i in range(p)}
        got = df.agg(*[f.alias(k) for k, f in rows.items()], F.sum(value).alias("v"), F.sum(sa).alias("sa"), F.sum(ca).alias("ca")).first()
        hessian = np.empty((p + 1, p + 1))
        for i in range(p):
            for j in range(i, p):
                hessian[i, j] = hessian[j, i] = got[f"a{i}_{j}"]
            hessian[i, p] = hessian[p, i] = got[f"m{i}"]
        hessian[p, p] = got["ca"]
        return got["v"], np.array([*(got[f"s{i}"] for i in range(p)), got["sa"]]), hessian

    value, score, hessian = totals(at)
    for _ in range(steps):
        curved = hessian.copy()
        if np.linalg.eigvalsh(curved).max() >= 0:  # not yet near the top: up the slope of ln(alpha), the weights as if it were fixed
            curved[p, :p] = curved[:p, p] = 0.0
            curved[p, p] = -max(abs(hessian[p, p]), abs(score[p]))
        step = -_solved(curved, score, "nb2")
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))
        if at[p] < least or at[p] > 12:  # counts of millions may vary more than Poisson's with a dispersion far below theirs
            raise NotConverged("nb2: the dispersion has no optimum above 0")
        if np.abs(step).max() < 1e-10:
            break
        share = 1.0
        while True:
            tried = at + share * step
            new, new_score, new_hessian = totals(tried)
            if new >= value - 1e-10 * (abs(value) + rows) or share < 1e-6:  # what rounding may take away is no fall
                break
            share /= 2
        at, value, score, hessian = tried, new, new_score, new_hessian
    else:
        raise NotConverged(f"nb2: {steps} steps were not enough")

    # Robust errors in the weights and alpha itself; at the optimum slopes are zero, so the change of variable only scales.
    alpha = math.exp(at[p])
    scale = np.append(np.ones(p), 1 / alpha)
    _, s, _, _, sa, _, mu = slopes(at)
    meat, _, _ = gram(df, [*[t * s for t in terms], sa / alpha], F.lit(0.0))
    bread = np.linalg.inv(hessian * np.outer(scale, scale))
    errors = np.sqrt(np.diag(bread @ meat @ bread))
    return _table(df, [*names, "alpha"], np.append(at[:p], alpha), errors, {
        "log_likelihood": value, "aic": 2 * (p + 1) - 2 * value, **_rates(df, mu / F.col(exposure)),
    })


def binomial_glm(df: DataFrame, successes: str, trials: str, columns: list[str], steps: int = 50) -> DataFrame:
    """Logistic regression of a proportion, each row weighted by its trials: estimates, robust errors and limits."""
    df = staged(df.select(successes, trials, *columns), "glm")
    terms = [F.lit(1.0), *[F.col(c) for c in columns]]
    beta = np.zeros(len(terms))
    y, n = F.col(successes), F.col(trials)
    for _ in range(steps):
        p = 1 / (1 + F.exp(-_linear(columns, beta)))
        hessian, score, _ = gram(df, terms, (y - n * p) / (n * p * (1 - p)), n * p * (1 - p))
        step = _solved(hessian, score, "binomial")
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    else:
        raise NotConverged(f"binomial: {steps} steps were not enough; the outcome may be certain for some rows")
    p = 1 / (1 + F.exp(-_linear(columns, beta)))
    value = df.agg(F.sum(y * F.ln(p) + (n - y) * F.log1p(-p)).alias("v")).first()["v"]
    return _table(df, ["intercept", *columns], beta, _sandwich(df, terms, hessian, y - n * p), {
        "log_likelihood": value, "aic": 2 * len(beta) - 2 * value, **_rates(df, p),
    })
