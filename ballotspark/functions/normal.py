"""Quantiles of the normal distribution, as a column expression."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: coefficients of Acklam's rational approximation (relative error under 1.15e-9) --------------------
A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01]
C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]
LOW = 0.02425
# --------------------------------------------------------------------------------------------------------------------


def _horner(coefficients: list[float], x: Column) -> Column:
    return reduce(lambda acc, k: acc * x + k, coefficients[1:], F.lit(coefficients[0]))


def normal_quantile(p: Column) -> Column:
    """For p between 0 and 1, exclusive."""
    tail = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    outer = _horner(C, tail) / _horner([*D, 1.0], tail)
    q = p - 0.5
    inner = _horner(A, q * q) * q / _horner([*B, 1.0], q * q)
    return F.when(p < LOW, outer).when(p > 1 - LOW, -outer).otherwise(inner)
