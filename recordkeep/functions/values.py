"""Numbers, dates and id lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def positive_int(c: Column) -> Column:
    """A positive integer, or null."""
    value = c.try_cast("bigint")
    return F.when(value > 0, value)


def nonnegative_int(c: Column) -> Column:
    """A non-negative integer, or null."""
    value = c.try_cast("bigint")
    return F.when(value >= 0, value)


def valid_date(c: Column) -> Column:
    """A real date written ``YYYY-MM-DD``: it must read back as the same text."""
    return F.coalesce(F.date_format(F.try_to_date(c, "yyyy-MM-dd"), "yyyy-MM-dd") == c, F.lit(False))


def normalize_date(c: Column) -> Column:
    """The first date with ``-`` or ``/`` in a text as ``YYYY-MM-DD``, else the trimmed text."""
    # Fixed value: how sources write dates, years 1900 to 2099.
    pattern = r"\b((?:19|20)[0-9]{2})[/-]([0-9]{1,2})[/-]([0-9]{1,2})\b"
    y, m, d = (F.regexp_extract(c, pattern, i) for i in (1, 2, 3))
    return F.when(y != "", F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))).otherwise(F.trim(c))


def valid_instant(c: Column) -> Column:
    """A UTC timestamp that ends in ``Z``."""
    shape = c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?Z$")
    return F.coalesce(shape & F.try_to_timestamp(c).isNotNull(), F.lit(False))


def clean_ids(ids: Column) -> Column:
    """Positive ids, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.filter(ids, lambda x: x > 0)))


def in_scope(number: Column, date: Column, number_from: int | None = None, number_to: int | None = None, date_from: str | None = None, date_to: str | None = None) -> Column:
    """Inclusive bounds; a null fails any bound that is set."""
    out = F.lit(True)
    for bound, test in ((number_from, lambda b: number >= b), (number_to, lambda b: number <= b), (date_from, lambda b: date >= b), (date_to, lambda b: date <= b)):
        if bound is not None:
            out = out & F.coalesce(test(bound), F.lit(False))
    return out


def metadata_view(df: DataFrame) -> DataFrame:
    """Records without their links."""
    return df.drop("links")
