"""Text columns: folding, damage checks, fingerprints."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Signs of text decoded with the wrong character set, when they repeat.
DAMAGE_MARKS = ("丐", "乓", "涓", "涔")
REPLACEMENT = "�"


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc_of(text: str) -> str:
    return unicodedata.normalize("NFKC", text)


def normal_of(text: str) -> str:
    """:func:`normalize_text` of one literal, on the driver."""
    return " ".join(nfkc_of(text).split()).lower()


def nfkc(c: Column) -> Column:
    """Compatibility composition. Spark has no such function, so it runs over Arrow batches."""
    return _nfkc(c)


def collapse(c: Column) -> Column:
    """White space runs to one space, ends trimmed; null to ''."""
    return F.coalesce(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def normalize_ascii(c: Column) -> Column:
    """Search form of text that is known to be ASCII: collapsed and in lower case."""
    return F.lower(collapse(c))


def normalize_text(c: Column) -> Column:
    """Search form of any text: NFKC, collapsed, lower case."""
    return F.lower(collapse(nfkc(c)))


def header_name(c: Column) -> Column:
    """A sheet header without byte order mark, trimmed, in upper case."""
    return F.upper(F.trim(F.regexp_replace(c, "^﻿+", "")))


def label(c: Column) -> Column:
    """A field label without colons and white space."""
    return F.regexp_replace(c, r"(?U)[\s:：]+", "")


def damaged(c: Column) -> Column:
    """A replacement character, or a mark of wrong decoding that stands twice or more."""
    repeated = [F.length(c) - F.length(F.replace(c, F.lit(m), F.lit(""))) >= 2 for m in DAMAGE_MARKS]
    out = F.contains(c, F.lit(REPLACEMENT))
    for r in repeated:
        out = out | r
    return F.coalesce(out, F.lit(False))


def distinct_names(names: Column) -> Column:
    """Trimmed, non-empty names in order of first occurrence."""
    return F.array_distinct(F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n != ""))


def summary(names: Column, shown: int) -> Column:
    """The first ``shown`` names, and ``+N`` for the others."""
    rest = F.size(names) - shown
    return F.concat(F.array_join(F.slice(names, 1, shown), ", "), F.when(rest > 0, F.concat(F.lit(" +"), rest.cast("string"))).otherwise(""))


def fingerprint(df: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """One text that is equal for equal rows and orders rows: JSON of the columns by name, map entries sorted."""
    kinds = dict(df.dtypes)
    cells = [F.array_sort(F.map_entries(c)).alias(c) if kinds[c].startswith("map<") else F.col(f"`{c}`") for c in sorted(df.columns) if c not in without]
    return F.to_json(F.struct(*cells))


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)
