"""A bounded, repeatable sample of labelled rows for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lowest(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """The rows whose hashed id is among the ``rows`` smallest; more than ``rows`` only if ids repeat.

    The threshold comes from a scan of the ids alone.
    """
    order = F.xxhash64(F.col(id_col))
    last = df.select(order.alias("o")).orderBy("o").limit(rows).agg(F.max("o")).first()[0]
    return df.limit(0) if last is None else df.where(order <= F.lit(last))


def fit_sample(df: DataFrame, id_col: str, rows: int, text_col: str = "text", longest: int = 100_000) -> list:
    """At most ``rows`` of the :func:`lowest`, less those with a text of over ``longest`` characters, in a fixed order. Only for fitting.

    Where ids repeat, hashes of the texts decide, so equal tables give equal samples.
    """
    found = lowest(df, id_col, rows).where(F.length(text_col) <= longest).orderBy(F.xxhash64(id_col), F.xxhash64(text_col)).limit(rows).collect()
    return sorted(found, key=lambda r: (str(r[id_col]), str(r[text_col])))
