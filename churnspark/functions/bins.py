"""Binning as native ``CASE WHEN`` chains.

The reference bins with right-closed intervals ``(a, b]`` (values on a lower edge
and below the first edge fall out as null).  ``ml.feature.Bucketizer`` and
``width_bucket`` are left-closed, so neither is used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bin edges and labels used by the reference's reports.
TENURE_EDGES = [0, 12, 24, 36, 48, 60]  # last bin is (60, inf)
TENURE_MONTH_LABELS = ["0-12 months", "13-24 months", "25-36 months", "37-48 months", "49-60 months", "60+ months"]
TENURE_YEAR_LABELS = ["0-1 year", "1-2 years", "2-3 years", "3-4 years", "4-5 years", "5+ years"]
TENURE_BOUNDED_EDGES = [0, 12, 24, 36, 48, 60, 72]
TENURE_BOUNDED_LABELS = ["0-1 year", "1-2 years", "2-3 years", "3-4 years", "4-5 years", "5-6 years"]
REFERRAL_EDGES = [-1, 0, 1, 2, 3]  # last bin is (3, inf)
REFERRAL_LABELS = ["0", "1", "2", "3", "4+"]
RISK_EDGES = [0.0, 0.25, 0.5, 0.75, 1.0]
RISK_LABELS = ["Low Risk", "Medium-Low Risk", "Medium-High Risk", "High Risk"]
QUARTILE_LABELS = ["Low", "Medium-Low", "Medium-High", "High"]
POPULATION_LABELS = ["Low Population", "Medium-Low Population", "Medium-High Population", "High Population"]


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def right_closed(c: str | Column, edges: Sequence, labels: Sequence | None = None,
                 open_top: bool = False, include_lowest: bool = False) -> Column:
    """``pd.cut(x, edges, labels, right=True)``.

    ``edges`` may be literals or columns.  With ``open_top`` the last label covers
    ``(edges[-1], inf)``; ``labels=None`` yields the 0-based bin code.
    """
    x = _c(c)
    n_bins = len(edges) - 1 + (1 if open_top else 0)
    labs = list(labels) if labels is not None else list(range(n_bins))
    lo = F.lit(edges[0]) if not isinstance(edges[0], Column) else edges[0]
    expr = F.when(x.isNull(), F.lit(None))
    expr = expr.when((x < lo) if include_lowest else (x <= lo), F.lit(None))
    for i in range(1, len(edges)):
        e = edges[i] if isinstance(edges[i], Column) else F.lit(edges[i])
        expr = expr.when(x <= e, F.lit(labs[i - 1]))
    if open_top:
        return expr.otherwise(F.lit(labs[-1]))
    return expr.otherwise(F.lit(None))


def tenure_code(c: str | Column = "tenure") -> Column:
    """(0,12] → 0 … (60,inf) → 5; tenure 0 (or below) → null."""
    return right_closed(c, TENURE_EDGES, open_top=True)


def tenure_label(c: str | Column = "tenure") -> Column:
    return right_closed(c, TENURE_EDGES, TENURE_MONTH_LABELS, open_top=True)


def tenure_year_label(code: str | Column = "tenure_group") -> Column:
    """Code 0..5 → "0-1 year" … "5+ years"; any other code → "Group <code>"."""
    x = _c(code)
    expr = F.when(x.isNull(), F.lit(None))
    for i, lab in enumerate(TENURE_YEAR_LABELS):
        expr = expr.when(x == i, F.lit(lab))
    return expr.otherwise(F.concat(F.lit("Group "), x.cast("string")))


def tenure_bounded_label(c: str | Column = "tenure") -> Column:
    """Bins up to (60,72]; tenure above 72 → null."""
    return right_closed(c, TENURE_BOUNDED_EDGES, TENURE_BOUNDED_LABELS)


def referral_bin(c: str | Column = "number_of_referrals") -> Column:
    return right_closed(c, REFERRAL_EDGES, REFERRAL_LABELS, open_top=True)


def risk_segment(c: str | Column = "churn_probability") -> Column:
    """(0,.25] Low … (.75,1] High Risk; 0 and values outside (0,1] → null."""
    return right_closed(c, RISK_EDGES, RISK_LABELS)


def risk_category_point(c: str | Column = "churn_probability") -> Column:
    """Left-closed variant used when one customer is scored: never null."""
    x = _c(c)
    return (F.when(x < 0.25, "Low Risk").when(x < 0.5, "Medium-Low Risk")
             .when(x < 0.75, "Medium-High Risk").otherwise("High Risk"))


def risk_order(c: str | Column = "risk_segment") -> Column:
    """Sort key of the risk labels (Low = 0 … High = 3)."""
    x = _c(c)
    expr = F.when(x.isNull(), F.lit(None))
    for i, lab in enumerate(RISK_LABELS):
        expr = expr.when(x == lab, F.lit(i))
    return expr
