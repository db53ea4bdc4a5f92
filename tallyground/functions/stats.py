"""Small numeric rules used by the forecasting operators."""

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the smallest denominator of a percentage error.
MACHINE_EPS = 2.220446049250313e-16


def cap_value(y: Column, mean: Column, std: Column, threshold: float) -> Column:
    """Clamp to mean ± threshold·std. A value on the limit, or an unknown std, leaves ``y`` as it is."""
    limit = threshold * std
    return F.when(y - mean > limit, mean + limit).when(mean - y > limit, mean - limit).otherwise(y)


def is_outlier(y: Column, mean: Column, std: Column, threshold: float) -> Column:
    return F.coalesce(F.abs(y - mean) > threshold * std, F.lit(False))


def improvement_pct(naive: Column, mae: Column) -> Column:
    """Gain over the naive forecast in percent; NULL when the naive error is zero."""
    return F.try_divide(naive - mae, naive) * 100


def quality_flag(improvement: Column) -> Column:
    return F.when(improvement > 0, "improves").when(improvement.isNotNull(), "warning")


def ratio_days(total_days: Column, ratio: float) -> Column:
    """Whole days of a share of the range, rounded down."""
    return F.floor(total_days * F.lit(float(ratio))).cast("int")


def interval_factor(width: float) -> float:
    """Half width of a central normal interval in standard deviations."""
    return NormalDist().inv_cdf((1 + width) / 2)
