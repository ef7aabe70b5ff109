"""Connected components of a link table by alternating large-star and small-star steps.

Each step replaces the links of a node by links to the smallest id that it knows; the number of rounds grows with the
logarithm of a component's size. Smallest ids come from partial aggregations and are joined back as written tables,
so a node with very many links is split like any other skewed key, and nothing is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordkeep.plans.lineage import cut


def _links(df: DataFrame) -> DataFrame:
    return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b of one long type) -> (node, component), component being the smallest node; linked nodes only.

    Null ends, loops and repeated links are ignored.
    """
    now = cut(_links(links.select(F.col("a").alias("u"), F.col("b").alias("v")).dropna()), "links")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large-star")
        large = cut(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).transform(_links), "large-star")
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")), "small-star")
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        now = cut(_links(small), "small-star")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(links: DataFrame) -> tuple[int, str]:
    """Number of links and an order-free checksum."""
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, str(row.h)
