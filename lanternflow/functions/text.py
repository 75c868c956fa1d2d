"""Numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column | str, digits: int) -> Column:
    """A number below 2^20 with so many digits, rounded by its exact binary value, halves to even, as C and Python print it.

    The JVM's own format rounds the shortest decimal form instead.  x is cut
    in two so that twice its scaled value less an odd number is exact.
    """
    x = F.col(x) if isinstance(x, str) else x
    scale = float(10**digits)
    high = F.floor(x * F.lit(float(1 << 20))) / F.lit(float(1 << 20))
    k = F.floor(x * F.lit(scale))
    over = (F.lit(2 * scale) * high - (2 * k + 1)) + F.lit(2 * scale) * (x - high)
    up = F.when((over > 0) | ((over == 0) & (k % 2 != 0)), 1).otherwise(0)
    return F.format_string(f"%.{digits}f", (k + up) / F.lit(scale))
