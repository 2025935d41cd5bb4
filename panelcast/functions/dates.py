"""Date parsing and calendar features."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from panelcast import config


def parse_date(c: Column) -> Column:
    """Strict day-first text, then a lenient second pass, else null."""
    text = F.trim(c)
    tries = [config.DATE_FORMAT, *config.LENIENT_DATE_FORMATS]
    return F.coalesce(*[F.to_date(F.try_to_timestamp(text, F.lit(fmt))) for fmt in tries])


def parse_two_digit_year(c: Column, pivot: int = config.YEAR_PIVOT) -> Column:
    """``d/m/yy hh:mm:ss`` text: years from the pivot on are 19yy, the rest 20yy; the time is dropped."""
    parts = F.split(c, "/")
    yy = F.split(F.element_at(parts, -1), " ")[0].cast("int")
    year = F.when(yy >= pivot, yy + 1900).otherwise(yy + 2000)
    return F.make_date(year, parts[1].cast("int"), parts[0].cast("int"))


def week_start(ts: Column) -> Column:
    """Monday of the week."""
    return F.to_date(F.date_trunc("week", ts))


def calendar(date: Column) -> dict[str, Column]:
    """ISO week, year, month, day of year and the two season flags."""
    month = F.month(date)
    return {
        "week_of_year": F.weekofyear(date),
        "year": F.year(date),
        "month": month,
        "day_of_year": F.dayofyear(date),
        "is_summer": month.between(6, 9).cast("int"),
        "is_winter": ((month >= 12) | (month <= 2)).cast("int"),
    }


def cyclic(date: Column) -> dict[str, Column]:
    """Week and month placed on the unit circle."""
    week = F.weekofyear(date) * F.lit(2 * math.pi) / F.lit(52.0)
    month = (F.month(date) - 1) * F.lit(2 * math.pi) / F.lit(12.0)
    return {"week_sin": F.sin(week), "week_cos": F.cos(week), "month_sin": F.sin(month), "month_cos": F.cos(month)}
