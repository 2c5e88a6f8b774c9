"""Dutch numbers, short numbers and percents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dutch_number(value: Column, decimals: int = 0) -> Column:
    """Points between thousands, a comma before at most ``decimals`` decimals (half up, zeros at the end left out); null stays null."""
    rounded = F.round(value.cast("decimal(38,10)"), decimals)
    plain = F.translate(F.format_number(rounded, decimals), ",.", ".,")
    trimmed = F.regexp_replace(F.regexp_replace(plain, r"(,\d*?)0+$", "$1"), ",$", "") if decimals else plain
    return F.regexp_replace(trimmed, "^-(0)$", "$1")


# Units of short numbers.
_UNITS = ((10**9, " mld."), (10**6, " mln."), (10**3, "K"))


def dutch_compact(value: Column) -> Column:
    """`1,2K`, `3,4 mln.`, `5,6 mld.`; numbers under a thousand with one decimal at most."""
    out = dutch_number(value, 1)
    for size, unit in reversed(_UNITS):
        # what rounds to the next unit is written in it
        out = F.when(F.abs(value) >= size - (size // 20000 if size > 1000 else 0.05), F.concat(dutch_number(value / size, 1), F.lit(unit))).otherwise(out)
    return out


def percent(value: Column, total: Column) -> Column:
    """Whole percents, half up; `0%` of nothing."""
    return F.when(F.coalesce(total, F.lit(0)) == 0, F.lit("0%")).otherwise(F.concat(F.floor(value / total * 100 + 0.5).cast("string"), F.lit("%")))
