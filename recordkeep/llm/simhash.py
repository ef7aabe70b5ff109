"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked by pigeonring filtering.

A fingerprint's bit is 1 if it is set in more than half of the shingles' XXH64 hashes. Only distinct fingerprints are
compared, in two steps that together find the components of "at most 3 differing bits" exactly:

1. *Balls.* Each fingerprint is sent to the 65 values within one bit. Those that meet are at most 2 bits apart, and
   all pairs that close meet. No value is met by more than 65 fingerprints, so no group is large, and dense clouds of
   near copies shrink to single components here, before anything compares pairs.
2. *Chains.* The four 16-bit segments form a ring. For a pair within 3 bits there is a segment from which the summed
   differences of 1, 2, 3 and 4 consecutive segments stay within 3/4 of a bit a segment: 0, 1, 2 and 3. A table keyed
   by (segment, its value, the next segment's value) is probed with the exact segment and the next one changed in at
   most one bit; chains of three and the full distance are checked on what meets. Keys under which only one component
   is found are dropped beforehand by a partial aggregation; keys that very many rows share are extended to the chain
   of three segments.

Defined cases:
* null, empty and white texts have fingerprint zero and link like any other; fewer words than a shingle: one shingle;
* texts of any length are hashed whole, in chunks; of a component's documents the smallest id names it;
* rows repeat as they come; a null doc_id never names a component (a component of such rows only has a null id);
* extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordkeep.llm.graph import components
from recordkeep.llm.tables import table
from recordkeep.plans.lineage import cut

SEGMENTS, BITS, WITHIN = 4, 16, 3
CHUNK = 1 << 15
HOT = 1024  # rows of a key that are compared by two segments alone
PER_TASK = 8192  # distinct fingerprints that one task sends to balls or chains


def fingerprint(text: str | None, width: int = 3) -> int:
    """Signed 64-bit fingerprint of the lower-cased words' shingles."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(width, len(words))
    starts, ends = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    hashed, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        part = np.array([hashed(joined[s:e], 42) for s, e in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, version, fp) per row of ``docs`` (doc_id, text); version is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text.as_py(), width) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=["doc_id", "version", "fp"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(coalesce(text, '')) version", "text").mapInArrow(run, "doc_id long, version long, fp long")


def _bit(i: int) -> Column:
    return F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long")


def close_links(fps: DataFrame) -> DataFrame:
    """(a, b): links that join all of ``fps`` (fp, distinct) within 2 bits, none further apart."""
    ball = F.array("fp", *[F.col("fp").bitwiseXOR(_bit(i)) for i in range(64)])
    met = fps.select("fp", F.explode(ball).alias("near"))
    return met.select(F.col("fp").alias("a"), F.min("fp").over(Window.partitionBy("near")).alias("b")).where("a <> b").distinct()


def _segment(i: int) -> Column:
    return F.shiftrightunsigned("fp", BITS * (i % SEGMENTS)).bitwiseAND(F.lit((1 << BITS) - 1))


def _keys(i: int, flips: bool) -> list[Column]:
    base = F.lit(i << 2 * BITS).bitwiseOR(F.shiftleft(_segment(i), BITS)).bitwiseOR(_segment(i + 1))
    return [base, *([base.bitwiseXOR(F.lit(1 << b)) for b in range(BITS)] if flips else [])]


#: The segment behind the two that ``key`` names, of the row's own fingerprint.
THIRD = f"shiftrightunsigned(fp, cast(pmod(shiftright(key, {2 * BITS}) + 2, {SEGMENTS}) * {BITS} as int)) & {(1 << BITS) - 1}"


#: All ways to change a segment in at most 3 * WITHIN // SEGMENTS bits.
CHANGES = [0, *(1 << i for i in range(BITS)), *(1 << i | 1 << j for i in range(BITS) for j in range(i))]


def chain_links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b): pairs of components that hold fingerprints within 3 bits; ``fps`` is (fp, comp), fp distinct.

    Keys that more than ``hot`` rows share go on to a chain of three: the key grows by the third segment, which is
    probed in all its values within two bits, so that few rows of such a key meet.
    """
    shifted = "cast(pmod(shiftright(key, {0}) * {1}, 64) as int)".format(2 * BITS, BITS)
    index = fps.select("fp", "comp", F.explode(F.array(*[k for i in range(SEGMENTS) for k in _keys(i, False)])).alias("key"))
    probes = fps.select("fp", "comp", F.explode(F.array(*[k for i in range(SEGMENTS) for k in _keys(i, True)])).alias("key"))
    census = (
        probes.select("key", "comp", F.lit(0).alias("own"))
        .unionByName(index.select("key", "comp", F.lit(1).alias("own")))
        .groupBy("key")
        .agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("own").alias("own"), F.count("*").alias("n"))
    )
    keys = cut(census.where("low < high and own = 1").select("key", (F.col("n") > hot).alias("is_hot")), "chain-keys")
    wide = F.shiftleft("key", BITS).bitwiseOR(F.expr(THIRD))
    left = cut(index.join(keys, "key").select("key", wide.alias("wide"), "is_hot", F.col("fp").alias("fp_a"), F.col("comp").alias("a")), "chain-index")
    right = cut(probes.join(keys, "key").select(F.col("key").alias("key_b"), wide.alias("wide_b"), F.col("is_hot").alias("hot_b"), F.col("fp").alias("fp_b"), F.col("comp").alias("b")), "chain-probes")
    differ = "(fp_a ^ fp_b)"
    turned = f"(shiftrightunsigned({differ}, {shifted}) | shiftleft({differ}, 64 - {shifted}))"
    near = F.expr(f"a <> b and bit_count({turned} & {(1 << 3 * BITS) - 1}) <= {3 * WITHIN // SEGMENTS} and bit_count({differ}) <= {WITHIN}")
    plain = left.where("not is_hot").join(right.where("not hot_b"), (F.col("key") == F.col("key_b")) & near)
    changed = right.where("hot_b").withColumn("wide_b", F.explode(F.array(*[F.col("wide_b").bitwiseXOR(F.lit(c)) for c in CHANGES])))
    crowded = left.where("is_hot").join(changed, (F.col("wide") == F.col("wide_b")) & near)
    return plain.select("a", "b").unionByName(crowded.select("a", "b")).distinct()


def _relabel(fps: DataFrame, found: DataFrame) -> DataFrame:
    return fps.join(cut(found, "components"), fps.comp == F.col("node"), "left").withColumn("comp", F.coalesce("component", "comp")).drop("node", "component")


def near_clusters(own: DataFrame) -> DataFrame:
    """``own`` (doc_id, fp) -> (fp, comp, first) per distinct fingerprint: its component and its smallest doc_id."""
    fps = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first")).select("fp", F.col("fp").alias("comp"), "first"), "distinct-fingerprints")
    tasks = max(1, math.ceil(fps.count() / PER_TASK))
    fps = cut(_relabel(fps, components(close_links(fps.select("fp").repartition(tasks, "fp")))), "balls")
    return cut(_relabel(fps, components(chain_links(fps.select("fp", "comp").repartition(tasks, "fp")))), "chains")


def simhash_groups(docs: DataFrame, width: int = 3) -> DataFrame:
    """Per row of ``docs``: doc_id, version, fp, component_id (smallest doc_id of the component)."""
    own = cut(fingerprints(docs, width), "fingerprints")
    fps = near_clusters(own)
    names = cut(fps.groupBy("comp").agg(F.min("first").alias("component_id")), "component-names")
    named = fps.join(names, "comp").select(F.col("fp").alias("fp_named"), "component_id")
    return own.join(named, own.fp == F.col("fp_named")).select("doc_id", "version", "fp", "component_id")


def one_per_group(docs: DataFrame, width: int = 3) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest doc_id.

    Of several rows with that doc_id one stays. Rows without a doc_id go if their component has an id, else stay.
    """
    groups = cut(simhash_groups(docs, width).select("doc_id", "version", "component_id"), "groups")
    gone = cut(groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id"), F.col("version").alias("_version")).distinct(), "near-copies")
    again = cut(groups.where("doc_id = component_id").groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("n"), F.min("version").alias("_version")).where("n > 1").drop("n"), "repeated-ids")
    own_id, own_version = docs["doc_id"].cast("long"), F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    stay = docs.join(gone, own_id.eqNullSafe(gone["_id"]) & (own_version == gone["_version"]), "left_anti")
    once = stay.join(again, own_id == again["_id"], "left_anti")
    chosen = stay.join(again, (own_id == again["_id"]) & (own_version == again["_version"]), "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(chosen)


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id."""
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
