"""Exact decimal ratios.

``avg(decimal)`` and plain decimal division round at an intermediate scale
chosen by the type rules and a later cast rounds again; two roundings can
disagree with one exact rounding.  Widening the numerator to scale 18 makes
the division round once, HALF_UP, at 18 digits, far past the output scale.
"""

from __future__ import annotations

from pyspark.sql import Column

RATIO_TYPE = "decimal(18,6)"


def exact_ratio(num: Column, den: Column, out: str = RATIO_TYPE) -> Column:
    """num / den rounded HALF_UP to ``out``; NULL when den is 0 or NULL."""
    return (num.cast("decimal(38,18)") / den).cast(out)
