"""SQL that fits the small models of the registered queries step by step, with systems of two or three unknowns solved by determinants."""

from __future__ import annotations

STEPS = 14
_BOUND = 1.959963984540054


def _minor(m: list[list[str]], i: int, j: int) -> list[list[str]]:
    return [[x for b, x in enumerate(row) if b != j] for a, row in enumerate(m) if a != i]


def _determinant(m: list[list[str]]) -> str:
    if len(m) == 1:
        return f"({m[0][0]})"
    return "(" + " ".join(f"{'-' if j % 2 else '+'} ({m[0][j]}) * {_determinant(_minor(m, 0, j))}" for j in range(len(m))) + ")"


def inverse(m: list[list[str]]) -> list[list[str]]:
    """Expressions of the inverse of a matrix of expressions."""
    n = len(m)
    return [[f"({'-' if (i + j) % 2 else ''}{_determinant(_minor(m, j, i)) if n > 1 else '1'} / {_determinant(m)})" for j in range(n)] for i in range(n)]


def _symmetric(name: str, n: int) -> list[list[str]]:
    return [[f"{name}{min(i, j)}{max(i, j)}" for j in range(n)] for i in range(n)]


def glm(frame: str, columns: list[str], start: str, mean: str, weight: str, residual: str, facts: dict[str, str]) -> str:
    """Newton's method in one CTE a step over a CTE `frame`; `mean` is by the linear term eta, `weight` and `residual` by mu."""
    n = len(columns) + 1
    x = ["1", *columns]
    eta = " + ".join(f"b{i} * {c}" for i, c in enumerate(x))
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    h = inverse(_symmetric("h", n))
    parts = [f"z0 AS ({start})"]
    for k in range(STEPS):
        parts.append(f"m{k} AS (SELECT f.*, z.*, {mean.format(eta=eta)} AS mu FROM {frame} f CROSS JOIN z{k} z)")
        sums = [f"sum({weight} * {x[i]} * {x[j]}) AS h{i}{j}" for i, j in pairs] + [f"sum(({residual}) * {c}) AS g{i}" for i, c in enumerate(x)]
        parts.append(f"s{k} AS MATERIALIZED (SELECT {', '.join(f'any_value(b{i}) AS b{i}' for i in range(n))}, {', '.join(sums)} FROM m{k})")
        moved = [f"b{i} + " + " + ".join(f"{h[i][j]} * g{j}" for j in range(n)) + f" AS b{i}" for i in range(n)]
        parts.append(f"z{k + 1} AS MATERIALIZED (SELECT {', '.join(moved)} FROM s{k})")
    last = STEPS
    parts.append(f"m{last} AS (SELECT f.*, z.*, {mean.format(eta=eta)} AS mu FROM {frame} f CROSS JOIN z{last} z)")
    sums = [f"sum({weight} * {x[i]} * {x[j]}) AS h{i}{j}, sum(({residual}) * ({residual}) * {x[i]} * {x[j]}) AS v{i}{j}" for i, j in pairs]
    parts.append(f"last AS MATERIALIZED (SELECT {', '.join(f'any_value(b{i}) AS b{i}' for i in range(n))}, {', '.join(sums)}, {', '.join(f'{e} AS {k}' for k, e in facts.items())} FROM m{last})")
    v = _symmetric("v", n)
    rows = []
    for i, name in enumerate(["intercept", *columns]):
        error = "sqrt(" + " + ".join(f"{h[i][a]} * {v[a][b]} * {h[b][i]}" for a in range(n) for b in range(n)) + ")"
        rows.append(f"SELECT '{name}' AS term, b{i} AS e, {error} AS r FROM last")
    rows += [f"SELECT '{k}', {k}, NULL FROM last" for k in facts]
    return f"""{', '.join(parts)}, said AS ({' UNION ALL '.join(rows)})
        SELECT term, round(e, 5) AS estimate, round(r, 5) AS robust_error, round(e - {_BOUND}::DOUBLE * r, 5) AS confidence_low, round(e + {_BOUND}::DOUBLE * r, 5) AS confidence_high FROM said"""


def poisson(frame: str, y: str, exposure: str, columns: list[str]) -> str:
    n = len(columns) + 1
    start = f"SELECT ln(CAST(sum({y}) AS DOUBLE) / sum({exposure})) AS b0, " + ", ".join(f"0::DOUBLE AS b{i}" for i in range(1, n)) + f" FROM {frame}"
    value = f"sum({y} * ln(mu) - mu - lgamma({y} + 1))"
    facts = {
        "pearson_dispersion": f"sum(({y} - mu) * ({y} - mu) / mu) / greatest(count(*) - {n}, 1)", "log_likelihood": value, "aic": f"2 * {n} - 2 * {value}",
        "observations": "CAST(count(*) AS DOUBLE)", "predicted_rate_min": f"min(mu / {exposure})", "predicted_rate_max": f"max(mu / {exposure})",
    }
    return glm(frame, columns, start, f"{exposure} * exp({{eta}})", "mu", f"{y} - mu", facts)


def binomial(frame: str, y: str, trials: str, columns: list[str]) -> str:
    n = len(columns) + 1
    start = "SELECT " + ", ".join(f"0::DOUBLE AS b{i}" for i in range(n))
    value = f"sum({y} * ln(mu) + ({trials} - {y}) * ln(1 - mu))"
    facts = {"log_likelihood": value, "aic": f"2 * {n} - 2 * {value}", "observations": "CAST(count(*) AS DOUBLE)", "predicted_rate_min": "min(mu)", "predicted_rate_max": "max(mu)"}
    return glm(frame, columns, start, "1 / (1 + exp(-({eta})))", f"{trials} * mu * (1 - mu)", f"{y} - {trials} * mu", facts)


def ridge(frame: str, columns: list[str], y: str, alpha: float) -> str:
    """Weights of population-standardised predictors with a penalty, and the mean as intercept, over a table expression."""
    n = len(columns)
    moments = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS d{i}" for i, c in enumerate(columns))
    z = ", ".join(f"({c} - m{i}) / CASE WHEN d{i} > 0 THEN d{i} ELSE 1 END AS z{i}" for i, c in enumerate(columns))
    sums = ", ".join(f"sum(z{i} * z{j}){f' + {alpha}::DOUBLE' if i == j else ''} AS h{i}{j}" for i in range(n) for j in range(i, n))
    right = ", ".join(f"sum(z{i} * y) AS g{i}" for i in range(n))
    h = inverse(_symmetric("h", n))
    rows = ["SELECT 'intercept' AS term, round(mean, 6) AS weight FROM sums"]
    rows += [f"SELECT '{c}', round({' + '.join(f'{h[i][j]} * g{j}' for j in range(n))}, 6) FROM sums" for i, c in enumerate(columns)]
    return f"""
        WITH frame AS ({frame}), moments AS (SELECT {moments} FROM frame),
        scaled AS (SELECT {z}, CAST({y} AS DOUBLE) AS y FROM frame CROSS JOIN moments),
        sums AS MATERIALIZED (SELECT avg(y) AS mean, {sums}, {right} FROM scaled)
        {' UNION ALL '.join(rows)}"""


def nb2(frame: str, y: str, exposure: str, columns: list[str], rounds: int = 24) -> str:
    """Counts with variance mu + alpha mu^2: in turn a scoring step for the weights and a Newton step for ln(alpha), by finite sums."""
    n = len(columns) + 1
    x = ["1", *columns]
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    own = ", ".join(f"b{i}" for i in range(n))
    eta = " + ".join(f"b{i} * {c}" for i, c in enumerate(x))
    rise = f"coalesce(list_sum(list_transform(range({y}), lambda k: 1 / (1 / a + k))), 0)"
    bend = f"coalesce(list_sum(list_transform(range({y}), lambda k: -1 / ((1 / a + k) * (1 / a + k)))), 0)"
    first = f"({rise} - ln(1 + a * mu) + (mu - {y}) / (1 / a + mu))"  # slope in theta = 1 / alpha
    second = f"({bend} + mu * a / (1 / a + mu) - (mu - {y}) / ((1 / a + mu) * (1 / a + mu)))"
    h = inverse(_symmetric("h", n))
    parts = [f"z0 AS (SELECT ln(CAST(sum({y}) AS DOUBLE) / sum({exposure})) AS b0, {', '.join(f'0::DOUBLE AS b{i}' for i in range(1, n))}, 0.1::DOUBLE AS a FROM {frame})"]
    for k in range(rounds):
        parts.append(f"m{k} AS (SELECT f.*, z.*, {exposure} * exp({eta}) AS mu FROM {frame} f CROSS JOIN z{k} z)")
        sums = [f"sum(mu / (1 + a * mu) * {x[i]} * {x[j]}) AS h{i}{j}" for i, j in pairs] + [f"sum(({y} - mu) / (1 + a * mu) * {c}) AS g{i}" for i, c in enumerate(x)]
        parts.append(f"s{k} AS MATERIALIZED (SELECT {', '.join(f'any_value(b{i}) AS b{i}' for i in range(n))}, any_value(a) AS a, {', '.join(sums)} FROM m{k})")
        moved = [f"b{i} + " + " + ".join(f"{h[i][j]} * g{j}" for j in range(n)) + f" AS b{i}" for i in range(n)]
        parts.append(f"y{k} AS MATERIALIZED (SELECT {', '.join(moved)}, a FROM s{k})")
        parts.append(f"n{k} AS (SELECT f.*, z.*, {exposure} * exp({eta}) AS mu FROM {frame} f CROSS JOIN y{k} z)")
        parts.append(f"t{k} AS MATERIALIZED (SELECT {', '.join(f'any_value(b{i}) AS b{i}' for i in range(n))}, any_value(a) AS a, sum(-{first} / a) AS u, sum({first} / a + {second} / (a * a)) AS v FROM n{k})")
        parts.append(f"z{k + 1} AS MATERIALIZED (SELECT {own}, a * exp(greatest(-1, least(1, -u / (CASE WHEN v < 0 THEN v ELSE -abs(u) - 1e-9 END)))) AS a FROM t{k})")
    parts.append(f"m{rounds} AS (SELECT f.*, z.*, {exposure} * exp({eta}) AS mu FROM {frame} f CROSS JOIN z{rounds} z)")
    parts.append(f"d AS (SELECT *, ({y} - mu) / (1 + a * mu) AS s, -{first} / (a * a) AS sa, ({second} / (a * a) + 2 * {first} / a) / (a * a) AS ca FROM m{rounds})")
    score = [*(f"s * {c}" for c in x), "sa"]
    curved = {(i, j): f"sum(-mu * (1 + a * {y}) / ((1 + a * mu) * (1 + a * mu)) * {x[i]} * {x[j]})" for i, j in pairs}
    curved |= {(i, n): f"sum(-({y} - mu) * mu / ((1 + a * mu) * (1 + a * mu)) * {x[i]})" for i in range(n)} | {(n, n): "sum(ca)"}
    value = f"sum(lgamma({y} + 1 / a) - lgamma(1 / a) - lgamma({y} + 1) - ({y} + 1 / a) * ln(1 + a * mu) + {y} * (ln(mu) + ln(a)))"
    facts = {"log_likelihood": value, "aic": f"2 * {n + 1} - 2 * {value}", "observations": "CAST(count(*) AS DOUBLE)", "predicted_rate_min": f"min(mu / {exposure})", "predicted_rate_max": f"max(mu / {exposure})"}
    every = [(i, j) for i in range(n + 1) for j in range(i, n + 1)]
    parts.append(
        f"last AS MATERIALIZED (SELECT {', '.join(f'any_value(b{i}) AS b{i}' for i in range(n))}, any_value(a) AS b{n}, {', '.join(f'{curved[p]} AS h{p[0]}{p[1]}' for p in every)}, "
        f"{', '.join(f'sum(({score[i]}) * ({score[j]})) AS v{i}{j}' for i, j in every)}, {', '.join(f'{e} AS {k}' for k, e in facts.items())} FROM d)"
    )
    h, v = inverse(_symmetric("h", n + 1)), _symmetric("v", n + 1)
    parts.append(f"inv AS MATERIALIZED (SELECT *, {', '.join(f'{h[i][j]} AS i{i}{j}' for i, j in every)} FROM last)")
    g = _symmetric("i", n + 1)
    rows = []
    for i, name in enumerate(["intercept", *columns, "alpha"]):
        error = "sqrt(" + " + ".join(f"{g[i][a]} * {v[a][b]} * {g[b][i]}" for a in range(n + 1) for b in range(n + 1)) + ")"
        rows.append(f"SELECT '{name}' AS term, b{i} AS e, {error} AS r FROM inv")
    rows += [f"SELECT '{k}', {k}, NULL FROM inv" for k in facts]
    return f"""{', '.join(parts)}, said AS ({' UNION ALL '.join(rows)})
        SELECT term, round(e, 5) AS estimate, round(r, 5) AS robust_error, round(e - {_BOUND}::DOUBLE * r, 5) AS confidence_low, round(e + {_BOUND}::DOUBLE * r, 5) AS confidence_high FROM said"""
