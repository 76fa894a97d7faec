"""Student t quantiles as Spark column expressions.

``t975`` is the usual 0.975 quantile at whole degrees of freedom, ``t_quantile`` any upper
quantile at any real degrees of freedom.

``t975``: up to ``TABLE_DF`` degrees of freedom the quantile is looked up in an array
literal that is solved once on the driver from the closed-form distribution for
whole degrees of freedom; above it the asymptotic expansion in 1/df is exact to
about 1e-9 and needs no table.
"""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

from .sql import literal, literals

TABLE_DF = 60

# Fixed value: 0.975 quantile of the standard normal distribution.
Z975 = 1.959963984540054


def central_probability(t: float, df: int) -> float:
    """P(-t < T < t) for whole ``df``, by the finite trigonometric series."""
    angle = math.atan(t / math.sqrt(df))
    c2 = math.cos(angle) ** 2
    odd = df % 2
    term = math.cos(angle) if odd else 1.0
    total = 0.0
    for k in range(1 + odd, df, 2):
        total += term
        term *= c2 * k / (k + 1)
    total *= math.sin(angle)
    return (angle + total) * 2 / math.pi if odd else total


@lru_cache(maxsize=None)
def quantile(df: int) -> float:
    """0.975 quantile for one whole number of degrees of freedom."""
    if df > TABLE_DF:
        return Z975 + sum(g / df**k for k, g in enumerate(expansion_terms(), 1))
    lo, hi = 0.0, 16.0
    for _ in range(80):
        mid = (lo + hi) / 2
        if central_probability(mid, df) < 0.95:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def expansion_terms(z: float = Z975) -> tuple[float, float, float, float]:
    """Coefficients of 1/df .. 1/df^4 in the expansion around the normal."""
    return (
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )


def t975(df: str) -> str:
    """0.975 quantile of Student t; NULL below one degree of freedom."""
    table = literals(quantile(i) for i in range(1, TABLE_DF + 1))
    tail = " + ".join([literal(Z975), *[f"{literal(g)} / power({df}, {k})" for k, g in enumerate(expansion_terms(), 1)]])
    return f"CASE WHEN {df} > {TABLE_DF} THEN {tail} WHEN {df} >= 1 THEN get(array({table}), CAST({df} AS INT) - 1) END"


# ---- any level, any degrees of freedom ----

TERMS = 120
STEPS = 30
SHIFT = 32
# The expansion of gamma(z + 1/2) / (gamma(z) sqrt(z)) in 1 / z.
GAMMA_RATIO = (1.0, -1 / 8, 1 / 128, 5 / 1024, -21 / 32768, -399 / 262144, 869 / 4194304)


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` for ``value``, which is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _gamma_ratio(z: str) -> str:
    """gamma(z + 1/2) / gamma(z) for z > 0: the expansion at z + SHIFT, brought back by the recurrence."""
    far = f"({z} + {SHIFT}D)"
    series = " + ".join(f"{literal(c)} / power({far}, {k})" for k, c in enumerate(GAMMA_RATIO))
    back = f"aggregate(sequence(0, {SHIFT - 1}), 1D, (p, k) -> p * ({z} + k) / ({z} + k + 0.5D))"
    return f"(sqrt({far}) * ({series}) * {back})"


def _series(first: str, second: str, x: str) -> str:
    """1 + first / second * x + first (first + 1) / (second (second + 1)) * x^2 + ..."""
    state = "named_struct('c', 1D, 's', 1D)"
    term = f"acc.c * ({first} + k) / ({second} + k) * {x}"
    step = _let("c", term, "named_struct('c', c, 's', acc.s + c)")
    return f"aggregate(sequence(0, {TERMS - 1}), {state}, (acc, k) -> {step}, acc -> acc.s)"


def upper_tail(t: str, df: str, ratio: str) -> str:
    """P(T > t) for t > 0, by the incomplete beta series on the side where its argument is at most one half.

    ``ratio`` is gamma((df + 1) / 2) / gamma(df / 2).
    """
    x, y = f"({df} / ({df} + {t} * {t}))", f"({t} * {t} / ({df} + {t} * {t}))"
    # x^(df / 2) sqrt(1 - x) / B(df / 2, 1 / 2)
    front = f"(exp(-{df} / 2 * log1p({t} * {t} / {df})) * sqrt({y}) * {ratio} / sqrt(pi()))"
    near = f"0.5D - {front} * {_series(f'({df} / 2 + 0.5D)', '1.5D', y)}"
    far = f"{front} / {df} * {_series(f'({df} / 2 + 0.5D)', f'({df} / 2 + 1D)', x)}"
    return f"CASE WHEN {x} <= 0.5D THEN {far} ELSE {near} END"


def t_quantile(p: float, df: str) -> str:
    """Quantile ``p`` (0.5 < p < 1) of Student t at any real ``df`` > 0; NULL otherwise.

    The logarithm of the tail falls ever faster in log t, so Newton steps from a start above
    the quantile come down to it without a bracket. Meant for summaries: a row costs some
    thousand operations.
    """
    if not 0.5 < p < 1:
        raise ValueError("p must lie between 0.5 and 1")
    z, target = NormalDist().inv_cdf(p), literal(math.log1p(-p))
    start = f"0.5D * (ln(d) + ln(expm1(power({literal(z)} * (8 * d + 3) / (8 * d + 1), 2) / d)))"
    slope = "t * ratio / sqrt(d * pi()) * exp(-(d + 1) / 2 * log1p(t * t / d))"
    step = _let("t", "exp(u)", _let("tail", upper_tail("t", "d", "ratio"), f"u + (ln(tail) - {target}) * tail / ({slope})"))
    solved = f"exp(aggregate(sequence(1, {STEPS}), {start}, (u, i) -> {step}))"
    found = _let("d", f"CAST({df} AS DOUBLE)", _let("ratio", _gamma_ratio("d / 2"), solved))
    return f"CASE WHEN {df} > 0 THEN {found} END"
