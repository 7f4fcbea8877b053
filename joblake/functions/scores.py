"""Score arithmetic and display labels as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from joblake.schemas import LEVEL_WEIGHT, STATE_RANK


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decimal_round(x, digits: int) -> Column:
    """Half-up rounding of the decimal value of a double, as a SQL store does
    after casting float to numeric: first to 10 places (drops binary noise
    such as 1.8499999999999999), then to ``digits``."""
    return F.round(F.round(_c(x), 10), digits)


def match_score(qualification, fit, beta: float) -> Column:
    """Combined tier-3 score: ((1-beta) + beta*fit/100) * (qualification/100) * 100,
    rounded to one decimal. NULL when an input is NULL."""
    q, f = _c(qualification).cast("double"), _c(fit).cast("double")
    return decimal_round(((F.lit(float(1 - beta)) + F.lit(float(beta)) * f / 100) * (q / 100)) * 100, 1)


def level_weight(level) -> Column:
    """User level → improvement multiplier; unknown or NULL counts as the lowest level."""
    expr = F.when(F.lit(False), F.lit(0))
    for name, w in LEVEL_WEIGHT.items():
        expr = expr.when(_c(level) == name, F.lit(w))
    return expr.otherwise(F.lit(LEVEL_WEIGHT["Unskilled"]))


def state_rank(state) -> Column:
    expr = F.when(F.lit(False), F.lit(0))
    for name, r in STATE_RANK.items():
        expr = expr.when(_c(state) == name, F.lit(r))
    return expr.otherwise(F.lit(4))


def route_status(t2_score, threshold: float = 50) -> Column:
    """'bad_fit' below the threshold; NULL score counts as passing."""
    return F.when(_c(t2_score) < threshold, F.lit("bad_fit")).otherwise(F.lit("active"))


def score_band(score, high: float = 75, mid: float = 50) -> Column:
    """'high' / 'mid' / 'low' band of a 0-100 score, 'none' when NULL.
    Qualification uses 70/50, fit 70/40."""
    s = _c(score)
    return (F.when(s.isNull(), "none").when(s >= high, "high")
            .when(s >= mid, "mid").otherwise("low"))


def salary_label(salary_min, salary_max) -> Column:
    """'$Ak–$Bk', 'up to $Bk', 'from $Ak' or '—', floor thousands."""
    lo, hi = _c(salary_min), _c(salary_max)
    k_lo = F.concat(F.lit("$"), F.floor(lo / 1000).cast("bigint").cast("string"), F.lit("k"))
    k_hi = F.concat(F.lit("$"), F.floor(hi / 1000).cast("bigint").cast("string"), F.lit("k"))
    truthy_lo = lo.isNotNull() & (lo != 0)
    truthy_hi = hi.isNotNull() & (hi != 0)
    return (F.when(truthy_lo & truthy_hi, F.concat(k_lo, F.lit("–"), k_hi))
            .when(truthy_hi, F.concat(F.lit("up to "), k_hi))
            .when(truthy_lo, F.concat(F.lit("from "), k_lo))
            .otherwise(F.lit("—")))


def age_label(ts, now) -> Column:
    """'never', 'Xm ago' (at least 1), 'Xh ago' or 'Xd ago'."""
    secs = F.unix_timestamp(_c(now)) - F.unix_timestamp(_c(ts))
    return (F.when(_c(ts).isNull(), F.lit("never"))
            .when(secs < 3600, F.concat(F.greatest(F.floor(secs / 60), F.lit(1)).cast("string"), F.lit("m ago")))
            .when(secs < 86400, F.concat(F.floor(secs / 3600).cast("string"), F.lit("h ago")))
            .otherwise(F.concat(F.floor(secs / 86400).cast("string"), F.lit("d ago"))))
