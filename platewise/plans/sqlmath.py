"""Distribution functions as SQL expressions, for the SQL of queries that return p-values.

Each takes SQL expressions and gives one. They are sums of lists, so they need no functions beyond the engine's own.
"""

from __future__ import annotations


def norm_sf(z: str) -> str:
    """Upper tail of the normal distribution: 1/2 - density * sum of z^(2k+1) / (2k+1)!!."""
    a = f"least(abs({z}), 9.0)"
    series = f"list_sum(list_transform(range(0, 160), lambda k: exp(k * ln(greatest({a} * {a}, 1e-300)) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi()))))"
    half = f"({a} * exp(-0.5 * {a} * {a}) / sqrt(2 * pi()) * {series})"
    return f"(CASE WHEN {z} IS NULL THEN NULL WHEN {z} >= 0 THEN 0.5 - {half} ELSE 0.5 + {half} END)"


def norm_quantile(p: str) -> str:
    """Inverse of the normal distribution: a published rational start (fixed values), then three Newton steps."""
    tail = f"least({p}, 1 - ({p}))"
    t = f"sqrt(-2 * ln({tail}))"
    start = f"({t} - (2.515517 + {t} * (0.802853 + {t} * 0.010328)) / (1 + {t} * (1.432788 + {t} * (0.189269 + {t} * 0.001308))))"
    step = f"x + ({norm_sf('x')} - g) / (exp(-0.5 * x * x) / sqrt(2 * pi()))"
    body = f"list_reduce([{start}, g, g, g, g], lambda x, g: {step})".replace("[" + start + ", g, g, g, g]", f"[{start}, {tail}, {tail}, {tail}, {tail}]")
    return f"(CASE WHEN {p} IS NULL THEN NULL WHEN {p} < 0.5 THEN -{body} ELSE {body} END)"


def chi2_sf_even(x: str, df: str) -> str:
    """Upper tail of chi-square with an even number of degrees of freedom."""
    return f"least(1.0, exp(-({x}) / 2) * list_sum(list_transform(range(0, ({df}) // 2), lambda k: exp(k * ln(greatest(({x}) / 2, 1e-300)) - lgamma(k + 1)))))"


def t_sf2(t: str, df: str) -> str:
    """Two-sided tail of Student's t with a whole number of degrees of freedom."""
    theta, cos2 = f"atan(abs({t}) / sqrt({df}))", f"({df}) / (({df}) + ({t}) * ({t}))"
    even = f"sin({theta}) * list_sum(list_transform(range(0, CAST({df} AS BIGINT) // 2), lambda j: exp(lgamma(j + 0.5) - 0.5 * ln(pi()) - lgamma(j + 1) + j * ln({cos2}))))"
    odd = f"2 / pi() * ({theta} + sin({theta}) * coalesce(list_sum(list_transform(range(0, (CAST({df} AS BIGINT) - 1) // 2), lambda j: exp(0.5 * ln(pi()) + lgamma(j + 1) - ln(2) - lgamma(j + 1.5) + (j + 0.5) * ln({cos2})))), 0))"
    return f"(CASE WHEN {t} IS NULL OR {df} IS NULL THEN NULL WHEN CAST({df} AS BIGINT) % 2 = 0 THEN 1 - {even} ELSE 1 - {odd} END)"


def f_sf_even(f: str, d1: str, d2: str) -> str:
    """Upper tail of F with an even number of degrees of freedom above."""
    x = f"(({d2}) / (({d2}) + ({d1}) * ({f})))"
    terms = f"list_sum(list_transform(range(0, CAST({d1} AS BIGINT) // 2), lambda j: exp(lgamma(({d2}) / 2.0 + j) - lgamma(({d2}) / 2.0) - lgamma(j + 1) + j * ln(greatest(1 - {x}, 1e-300)))))"
    return f"(CASE WHEN {f} IS NULL THEN NULL ELSE least(1.0, pow({x}, ({d2}) / 2.0) * {terms}) END)"


def _choose(n: str, k: str) -> str:
    return f"(lgamma(({n}) + 1) - lgamma(({k}) + 1) - lgamma(({n}) - ({k}) + 1))"


def hypergeom_sf(k: str, total: str, marked: str, drawn: str) -> str:
    """P(X > k) of marked ones among the drawn."""
    most, least = f"least({marked}, {drawn})", f"greatest(({k}) + 1, ({drawn}) + ({marked}) - ({total}), 0)"
    term = f"exp({_choose(marked, 'x')} + {_choose(f'({total}) - ({marked})', f'({drawn}) - x')} - {_choose(total, drawn)})"
    return f"coalesce(list_sum(list_transform(range(CAST({least} AS BIGINT), CAST({most} AS BIGINT) + 1), lambda x: {term})), 0.0)"


def fisher(a: str, b: str, c: str, d: str) -> str:
    """Two-sided exact test of a 2 x 2 table: all tables that are as unlikely."""
    total, row, col = f"({a} + {b} + {c} + {d})", f"({a} + {b})", f"({a} + {c})"
    p = lambda x: f"exp({_choose(row, x)} + {_choose(f'{total} - {row}', f'{col} - {x}')} - {_choose(total, col)})"
    every = f"list_transform(range(CAST(greatest(0, {row} + {col} - {total}) AS BIGINT), CAST(least({row}, {col}) AS BIGINT) + 1), lambda x: {p('x')})"
    return f"least(1.0, list_sum(list_filter({every}, lambda y: y <= {p(a)} * (1 + 1e-7))))"


def bh(rows: str, by: str, tie: str, out: str = "qvalue", p: str = "pvalue") -> str:
    """SELECT of `rows` (a table or bracketed query) with the adjusted p-value of each family."""
    part = f"PARTITION BY {by + ', ' if by else ''}{p} IS NULL"
    step = f"SELECT *, least(1.0, {p} * count(*) OVER ({part}) / row_number() OVER ({part} ORDER BY {p}, {tie})) AS bh_step FROM {rows}"
    return f"SELECT * EXCLUDE (bh_step), CASE WHEN {p} IS NOT NULL THEN min(bh_step) OVER ({part} ORDER BY {p}, {tie} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS {out} FROM ({step})"
