"""Scores of forecasts. Comparisons with a missing value are false; ratios without a denominator are 0 or null as named."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def below(c: Column | str, threshold: float) -> Column:
    """c < threshold, false where c is missing."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c) < threshold, F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def guarded(a: Column, b: Column, least: float = 1e-12) -> Column:
    """a / b, null where b is next to nothing."""
    return F.when(F.abs(b) >= least, a / b)


def finite(c: Column) -> Column:
    """c where it is a finite number, else null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def weighted_mean(x: Column, w: Column) -> Column:
    """Mean of the present values by weight; null without any."""
    return F.sum(x * w) / F.sum(F.when(x.isNotNull(), w))


def mae(y: str = "y", p: str = "p") -> Column:
    return F.avg(F.abs(F.col(y) - F.col(p)))


def rmse(y: str = "y", p: str = "p") -> Column:
    return F.sqrt(F.avg(F.pow(F.col(y) - F.col(p), 2)))


def skill(error: Column, baseline: Column) -> Column:
    """1 - error / baseline, 0 where the baseline is missing or 0."""
    return F.when(baseline.isNull() | F.isnan(baseline) | (baseline == 0), 0.0).otherwise(1 - error / baseline)


def confusion(truth: Column, alert: Column) -> dict[str, Column]:
    """Counts of the four outcomes of two boolean columns."""
    return {
        "tp": F.count_if(truth & alert),
        "fp": F.count_if(~truth & alert),
        "fn": F.count_if(truth & ~alert),
        "tn": F.count_if(~truth & ~alert),
    }


def binary_metrics() -> dict[str, Column]:
    """Rates from columns tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {
        "precision": precision,
        "recall": recall,
        "f1": ratio(2 * precision * recall, precision + recall),
        "specificity": ratio(tn, tn + fp),
        "prevalence": ratio(tp + fn, n),
        "alert_rate": ratio(tp + fp, n),
    }


def brier(y: Column, p: Column) -> Column:
    return F.avg(F.pow(p - y, 2))


def log_loss(y: Column, p: Column, eps: float = 1e-15) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -F.avg(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def pinball(y: Column, p: Column, q: float) -> Column:
    d = y - p
    return F.avg(F.greatest(q * d, (q - 1) * d))


def coverage(y: Column, low: Column, high: Column) -> Column:
    return F.avg(y.between(low, high).cast("double"))


def cost_loss_expense(alert: Column, event: Column, alpha: float | Column) -> Column:
    """Mean expense of acting on alerts at cost alpha against losses of 1."""
    a = alpha if isinstance(alpha, Column) else F.lit(alpha)
    return F.avg(F.when(alert, a).when(event, F.lit(1.0)).otherwise(0.0))


def economic_value(alert: Column, event: Column, alpha: float | Column) -> Column:
    """(climate - expense) / (climate - perfect); null where no rule can be better than always or never acting."""
    a = alpha if isinstance(alpha, Column) else F.lit(alpha)
    rate = F.avg(event.cast("double"))
    climate, perfect = F.least(a, rate), rate * a
    return F.when(climate - perfect > 1e-12, (climate - cost_loss_expense(alert, event, a)) / (climate - perfect))
