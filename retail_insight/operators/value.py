"""Customer value and churn: P(alive), churn tiers, horizon forecasts.

Everything per customer is a closed-form expression of recency, frequency,
tenure and order value (no model fit, no UDF), so it fuses into the scan
stage of the customer table. Thresholds apply to the *rounded* P(alive).
The watchlist's median is an exact order statistic from
:func:`exact_quantile` (counts and sketches, no sort), used as a literal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_insight.functions.numeric import half_even
from retail_insight.operators.ranking import exact_quantile

# Fixed values of the value model and churn tiers.
PRIOR_ORDERS = 1.2
PRIOR_DAYS = 60.0
MIN_CADENCE_DAYS = 7.0
MISSED_WEIGHT, MISSED_CENTER = 1.4, 1.8
INACTIVE_WEIGHT, INACTIVE_CENTER = 1.2, 0.4
HAZARD_CLIP = 10.0
P_FLOOR, P_CEIL = 0.02, 0.99
TIER_LOW = "🟢 Low Churn Risk"
TIER_MODERATE = "🟡 Moderate Watch"
TIER_HIGH = "🔴 High Churn Risk"
TIERS = (TIER_LOW, TIER_MODERATE, TIER_HIGH)
LOW_RISK_MIN_P = 0.75
MODERATE_MIN_P = 0.45


def p_alive(r="Recency", f="Frequency", t="Tenure") -> tuple[Column, Column]:
    """(unrounded P(alive), purchase rate per day)."""
    r = F.col(r).cast("double")
    f = F.col(f).cast("double")
    t = F.col(t).cast("double")
    rate = (f + F.lit(PRIOR_ORDERS)) / (t + F.lit(PRIOR_DAYS))
    cadence = F.greatest(t / F.greatest(f, F.lit(1.0)), F.lit(MIN_CADENCE_DAYS))
    missed = r / cadence
    inactive = r / F.greatest(t, F.lit(1.0))
    hazard = (F.lit(MISSED_WEIGHT) * (missed - F.lit(MISSED_CENTER))
              + F.lit(INACTIVE_WEIGHT) * (inactive - F.lit(INACTIVE_CENTER)))
    clipped = F.least(F.greatest(hazard, F.lit(-HAZARD_CLIP)), F.lit(HAZARD_CLIP))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(clipped))
    return F.least(F.greatest(p, F.lit(P_FLOOR)), F.lit(P_CEIL)), rate


def churn_tier(p_rounded: Column) -> Column:
    return (F.when(p_rounded >= LOW_RISK_MIN_P, TIER_LOW)
            .when(p_rounded >= MODERATE_MIN_P, TIER_MODERATE)
            .otherwise(TIER_HIGH))


def estimate_value(customers: DataFrame, prediction_horizon_days: int = 90,
                   gross_margin: float = 0.35) -> DataFrame:
    """Add P_Alive (4 dp), P_Alive_Pct, Churn_Risk_Pct (1 dp), Churn_Risk_Tier,
    Expected_Orders_90d, Predicted_Spend_90d, Predictive_CLV_90d (2 dp).

    The ``_90d`` names stay for any horizon; each output is rounded from
    the unrounded chain (P -> orders -> spend -> margin)."""
    p, rate = p_alive()
    orders = p * rate * F.lit(float(prediction_horizon_days))
    spend = orders * F.col("AvgOrderValue").cast("double")
    out = customers.withColumns({
        "P_Alive": half_even(p, 4),
        "P_Alive_Pct": half_even(p * F.lit(100.0), 1),
        "Churn_Risk_Pct": half_even((F.lit(1.0) - p) * F.lit(100.0), 1),
    })
    return out.withColumns({
        "Churn_Risk_Tier": churn_tier(F.col("P_Alive")),
        "Expected_Orders_90d": half_even(orders, 2),
        "Predicted_Spend_90d": half_even(spend, 2),
        "Predictive_CLV_90d": half_even(spend * F.lit(float(gross_margin)), 2),
    })


def churn_watchlist(valued: DataFrame, p_alive_threshold: float = 0.45,
                    spend_quantile: float = 0.5, id_col: str = "CustomerID") -> DataFrame:
    """Customers with rounded P_Alive below the threshold and Monetary at or
    above the exact ``spend_quantile`` of all customers (default: median),
    highest Monetary first (ties by id)."""
    cut = exact_quantile(valued, "Monetary", spend_quantile, id_col)
    return (valued.where((F.col("P_Alive") < F.lit(p_alive_threshold)) & (F.col("Monetary") >= cut))
            .orderBy(F.col("Monetary").desc(), F.col(id_col).asc()))


def growth_targets(valued: DataFrame, top_n: int = 10, id_col: str = "CustomerID") -> DataFrame:
    """Top-N customers by forecast spend (per-partition top-N, then merge)."""
    return valued.orderBy(F.col("Predicted_Spend_90d").desc(), F.col(id_col).asc()).limit(top_n)
