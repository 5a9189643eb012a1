"""Dollar amounts: decimals inside, text only at the report edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def parse_usd(value: Column) -> Column:
    """``"$1,234.50"`` to a decimal; blank is 0, unreadable text is NULL."""
    digits = F.regexp_replace(value, r"[$,\s]", "")
    return F.when(digits == "", F.lit(0).cast(MONEY)).otherwise(digits.try_cast(MONEY))


def format_usd(value: Column) -> Column:
    return F.concat(F.lit("$"), value.cast(MONEY).cast("string"))
