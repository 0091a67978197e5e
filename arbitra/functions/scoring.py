"""Numeric expressions: points, recency, thresholds, BM25, cosine, calibration, cost."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The date ages are counted from, and the year used by the year-based dialect.
REFERENCE_DATE = "2022-01-01"
REFERENCE_YEAR = 2022

# Price for a model without a price row, USD per million tokens (input, output).
DEFAULT_PRICE = (1.0, 3.0)

BM25_K1, BM25_B = 1.5, 0.75


def day(date: Column) -> Column:
    """First ten characters as a date, null when they are not one."""
    return F.try_to_date(F.substring(date, 1, 10), "yyyy-MM-dd")


def age_years(date: Column, reference: str = REFERENCE_DATE) -> Column:
    """Whole days before the reference date over 365.25."""
    return F.datediff(F.lit(reference).cast("date"), day(date)) / F.lit(365.25)


def text_weight(weight: str) -> float:
    """Weight named in a rule text."""
    w = weight.lower()
    if "quarter" in w or "0.25" in w:
        return 0.25
    return 0.5 if "half" in w or "0.5" in w else 1.0


def recency_from_text(date: Column, rules: Sequence[Mapping]) -> Column:
    """The wordings "within 1/2 year", "1-2", "2-3", "over 2/3 year"; else weight 1.

    ``rules`` are mappings with ``age`` and ``weight`` texts.  Other wordings are ignored.
    """
    age = age_years(date)
    out = F.when(age.isNull(), F.lit(1.0))
    for rule in rules:
        text = rule["age"].lower()
        cond = None
        if "within" in text:
            cond = age <= 1 if "1 year" in text else age <= 2 if "2 year" in text else None
        elif "1-2" in text or "1 to 2" in text:
            cond = (age > 1) & (age <= 2)
        elif "2-3" in text or "2 to 3" in text:
            cond = (age > 2) & (age <= 3)
        elif "over" in text:
            cond = age > 2 if "2 year" in text else age > 3 if "3 year" in text else None
        if cond is not None:
            out = out.when(cond, F.lit(text_weight(rule["weight"])))
    return out.otherwise(F.lit(1.0))


def recency_by_max_age(age: Column, rules: Sequence[Mapping], beyond: float = 0.25) -> Column:
    """First rule, by ascending ``max_age_years``, that the age does not exceed."""
    if not rules:
        return F.lit(1.0)
    ordered = sorted(rules, key=lambda r: r.get("max_age_years", 999))
    out = F.when(age.isNull(), F.lit(1.0))
    for rule in ordered:
        weight = rule.get("weight_multiplier", rule.get("weight", 1.0))
        out = out.when(age <= F.lit(float(rule.get("max_age_years", 999))), F.lit(float(weight)))
    return out.otherwise(F.lit(beyond))


def recency_by_year(date: Column, rules: Sequence[tuple[str, int, int, float]]) -> Column:
    """Calendar-year ages.  Rules are (kind, low, high, weight), kind one of
    ``within`` (age <= high), ``older`` (age > low), ``range``.  A bad date counts as 2 years."""
    year = F.coalesce(F.substring(date, 1, 4).try_cast("int"), F.lit(REFERENCE_YEAR - 2))
    age = F.lit(REFERENCE_YEAR) - year
    out = None
    for kind, low, high, weight in rules:
        cond = {
            "within": age <= high, "older": age > low, "range": (age >= low) & (age <= high),
        }[kind]
        out = F.when(cond, F.lit(weight)) if out is None else out.when(cond, F.lit(weight))
    return out.otherwise(F.lit(1.0)) if out is not None else F.lit(1.0)


def points_for(label: str, table: Sequence[tuple[str, int]]) -> int:
    """Points of the first table label that contains the label, else 0."""
    return next((pts for name, pts in table if label.lower() in name.lower()), 0)


def by_k(base: float | None, overrides: Mapping | None, k: Column) -> Column:
    """The value for this K if there is one, else the base value."""
    out = None
    for key, value in (overrides or {}).items():
        hit = k == int(key)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    plain = F.lit(base) if base is not None else F.lit(None).cast("int")
    return plain if out is None else out.otherwise(plain)


def verdict_for_score(
    score: Column, thresholds: Sequence[Mapping], k: Column, default: str
) -> Column:
    """Highest minimum reached; failing that, lowest maximum not exceeded; else default.

    Thresholds carry ``verdict`` and ``min_score`` and/or ``max_score``, with ``*_by_k`` maps.
    """
    def reached(kind: str) -> list[Column]:
        out = []
        for t in thresholds:
            if t.get(kind) is None and not t.get(f"{kind}_by_k"):
                continue
            bound = by_k(t.get(kind), t.get(f"{kind}_by_k"), k)
            ok = score >= bound if kind == "min_score" else score <= bound
            out.append(F.when(ok, F.struct(bound.alias("bound"), F.lit(t["verdict"]).alias("v"))))
        return out

    mins, maxs = reached("min_score"), reached("max_score")
    picks = []
    # greatest/least skip nulls, so a bound that is not reached drops out.
    if mins:
        picks.append((F.greatest(*mins) if len(mins) > 1 else mins[0])["v"])
    if maxs:
        picks.append((F.least(*maxs) if len(maxs) > 1 else maxs[0])["v"])
    return F.coalesce(*picks, F.lit(default))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters."""
    return F.floor(F.length(text) / 4)


def cost_usd(prompt: Column, completion: Column, price_in: Column, price_out: Column) -> Column:
    """Token cost; a model without a price row has the default price."""
    million = F.lit(1_000_000)
    return prompt / million * F.coalesce(price_in, F.lit(DEFAULT_PRICE[0])) + completion / million * F.coalesce(
        price_out, F.lit(DEFAULT_PRICE[1])
    )


def idf(n_docs: Column, df: Column) -> Column:
    """X22."""
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def bm25_weight(tf: Column, doc_len: Column, avg_len: Column, k1=BM25_K1, b=BM25_B) -> Column:
    """Saturation of a term frequency by document length."""
    norm = k1 * (1 - b + b * (doc_len / (avg_len + 1e-9)))
    return tf * (k1 + 1) / (tf + norm + 1e-9)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column, epsilon: float = 0.0) -> Column:
    """Cosine of two vectors; 0 for a missing or zero vector.

    ``epsilon`` is added to each norm (the gate form); without it a zero norm gives 0.
    """
    norm_a, norm_b = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    scale = (norm_a + epsilon) * (norm_b + epsilon)
    return F.coalesce(F.when(scale > 0, dot(a, b) / scale), F.lit(0.0))


def variance_drop(alpha: Column, beta: Column) -> Column:
    """Expected fall of a Beta variance after one more observation, not below 0."""
    n = alpha + beta
    now = alpha * beta / (n * n * (n + 1))
    after = (n + 1) * (n + 1) * (n + 2)
    theta = alpha / n
    expected = theta * ((alpha + 1) * beta / after) + (1 - theta) * (alpha * (beta + 1) / after)
    return F.greatest(F.lit(0.0), now - expected)


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function over arrays, by its continued fraction.

    Every row takes as many terms as it needs, whatever rows stand beside it.
    """
    x, a, b = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (x, a, b)))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    y = np.clip(y, 1e-300, 1.0)
    front = np.exp(p * np.log(y) + q * np.log1p(-np.minimum(y, 1 - 1e-16)) - _log_beta(p, q)) / p
    value = np.clip(front * _beta_fraction(p, q, y), 0.0, 1.0)
    return np.where(flip, 1 - value, value)


def _log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    from math import lgamma

    each = np.vectorize(lgamma, otypes=[float])
    return each(a) + each(b) - each(a + b)


def _beta_fraction(p: np.ndarray, q: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The continued fraction from its near end; a row leaves when a pair of terms changes nothing.

    Each pair of terms multiplies the value by the ratio of two tails, which are kept away from 0.
    """
    shape, (p, q, y) = p.shape, (v.ravel() for v in (p, q, y))
    out = np.full(p.shape, np.nan)
    open_rows = np.flatnonzero(np.isfinite(p) & np.isfinite(q) & np.isfinite(y) & (p > 0) & (q > 0))
    p, q, y = p[open_rows], q[open_rows], y[open_rows]
    away = lambda v: np.where(np.abs(v) < 1e-300, 1e-300, v)
    upper, lower = np.ones_like(p), 1 / away(1 - (p + q) * y / (p + 1))
    value, m = lower.copy(), 0
    while open_rows.size:
        m += 1
        before = value
        for term in (
            m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)),
            -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1)),
        ):
            lower = 1 / away(1 + term * lower)
            upper = away(1 + term / upper)
            value = value * upper * lower
        done = ~(np.abs(value - before) > 4e-16 * np.abs(value))
        if done.any():
            out[open_rows[done]] = value[done]
            open_rows, p, q, y, upper, lower, value = (
                v[~done] for v in (open_rows, p, q, y, upper, lower, value)
            )
    return out.reshape(shape)


def beta_quantiles(a: np.ndarray, b: np.ndarray, q: float) -> np.ndarray:
    """Newton steps from the normal approximation, held inside a shrinking bracket.

    A step that leaves the bracket, or is not half of the one before, is a bisection instead.  Rows
    converge by themselves; a null or a parameter that is not positive gives NaN.
    """
    from statistics import NormalDist

    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    good = np.isfinite(a) & np.isfinite(b) & (a > 0) & (b > 0)
    out = np.full(a.shape, np.nan)
    if q <= 0 or q >= 1:
        out[good] = min(max(q, 0.0), 1.0)
        return out
    rows = np.flatnonzero(good)
    a, b = a[rows], b[rows]
    mean, n = a / (a + b), a + b
    sd = np.sqrt(mean * (1 - mean) / (n + 1))
    lo, hi = np.zeros_like(a), np.ones_like(a)
    x = np.clip(mean + NormalDist().inv_cdf(q) * sd, mean * 1e-3, 1 - (1 - mean) * 1e-3)
    last = np.ones_like(a)
    scale = _log_beta(a, b)
    while rows.size:
        gap = beta_cdf(x, a, b) - q
        lo, hi = np.where(gap < 0, x, lo), np.where(gap < 0, hi, x)
        with np.errstate(all="ignore"):
            step = gap / np.exp((a - 1) * np.log(x) + (b - 1) * np.log1p(-x) - scale)
        newton = x - step
        inside = (newton > lo) & (newton < hi) & (2 * np.abs(step) <= last)
        new = np.where(inside, newton, (lo + hi) / 2)
        last = np.abs(new - x)
        done = (gap == 0) | (last <= 1e-15 * x + 1e-18)
        out[rows[done]] = np.where(gap == 0, x, new)[done]
        rows, a, b, lo, hi, x, last, scale = (v[~done] for v in (rows, a, b, lo, hi, new, last, scale))
    return out


def beta_upper(alpha: Column, beta: Column, delta: float) -> Column:
    """The (1 - delta) quantile of Beta(alpha, beta); one Arrow batch per call."""

    @F.pandas_udf("double")
    def quantile(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(beta_quantiles(a.to_numpy(), b.to_numpy(), 1.0 - delta))

    return quantile(alpha.cast("double"), beta.cast("double"))
