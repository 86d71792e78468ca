"""Rounding of the binary value, ties to even, as the sizes of documents are rounded: 0.35 is a little less and becomes 0.3.

The JVM rounds the shortest decimal text instead, so tenths are found from the exact product by ten: 8 v + 2 v, both exact, as a
sum and its error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tenth(value: Column | str) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    big, small = v * 8.0, v * 2.0
    total = big + small
    error = (big - total) + small
    whole = F.rint(total)  # halves to even
    off = total - whole
    # a sum that is a half exactly was rounded to even; its error says on which side of the half the product lies
    up, down = (off == 0.5) & (error > 0), (off == -0.5) & (error < 0)
    return (whole + F.when(up, 1.0).when(down, -1.0).otherwise(0.0)) / 10.0
