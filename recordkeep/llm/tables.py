"""Reading the text tables, and small helpers that all operators here share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, everything else untouched."""
    return F.translate(c, UPPER, LOWER)


def hash128(c: Column) -> list[Column]:
    """Two 64-bit hashes with unrelated seeds; together they tell apart any corpus that fits a cluster."""
    return [F.xxhash64(c), F.xxhash64(F.lit("second"), c)]


def packed(df: DataFrame, name: str = "row") -> DataFrame:
    """All columns in one struct, so that names of the input cannot clash with names that an operator adds."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))
