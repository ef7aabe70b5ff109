"""Best-fit packing of documents into training sequences, with conflicts between documents.

A document of more than ``capacity`` words is cut into full sequences of its own and a rest. Rests, longest first, go
into the bin with the smallest residual that still holds them. Bins of a shard are kept ordered by residual and carry
bitmaps: one of the duplicate clusters that they hold, and ``per_source`` planes of their sources (plane k has a bit
for every source held more than k times). A bin that already holds the document's cluster, or ``per_source`` documents
of its source, is passed over and the search goes on to the next larger residual, so the tightest compatible bin is
found; if there is none, a new bin opens.

Clusters are the components of near copies that op7 finds (fingerprints within 3 bits, linked on): copies and texts
with a few changed words alike.

Shards are dealt by hash of (doc_id, text), hold about ``shard_rows`` documents each, and are packed independently:
the count of shards grows with the corpus, the work in each does not. Bins lie within shards, so a cluster of any size
can be dealt over all of them. Only (doc_id, source, length, text hash, fingerprint) and distinct fingerprints move.

Defined cases: a document without words gets one row with length 0 and no bin; null sources are a source of their own;
null ids pack like others; rows that repeat are packed once each and are one cluster; a very long text fills sequences of
its own; rests of equal length are packed by id, then text hash, bins of equal residual by age; extra columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordkeep.llm.simhash import fingerprint, near_clusters
from recordkeep.llm.tables import table
from recordkeep.plans.lineage import cut

OUT = "doc_id long, source string, piece int, start long, length long, bin_id long"


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, words, version, fp): version is a hash of the lower-cased words, fp their fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, version, fp = [], [], []
            for text in batch.column(2):
                own = (text.as_py() or "").encode().lower().split()
                words.append(len(own))
                version.append(xxhash.xxh3_64_intdigest(b" ".join(own)) - (1 << 63))
                fp.append(fingerprint(text.as_py()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, pa.int64()) for x in (words, version, fp)]], names=["doc_id", "source", "words", "version", "fp"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(source as string) source", "text").mapInArrow(run, "doc_id long, source string, words long, version long, fp long")


def best_fit(items: list[tuple[int, object, object]], capacity: int, per_source: int) -> list[int]:
    """Bin of each item (length 1..capacity, source, cluster); items come in the order of packing."""
    common = Counter(cluster for _, _, cluster in items)
    cluster_bit = {c: 1 << i for i, c in enumerate(c for c, n in common.items() if n > 1)}  # others cannot conflict
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(s for _, s, _ in items))}
    order: list[tuple[int, int]] = []  # (residual, bin)
    clusters: list[int] = []
    planes: list[list[int]] = []
    out = []
    for length, source, cluster in items:
        same, own = cluster_bit.get(cluster, 0), source_bit[source]
        at = bisect_left(order, (length, -1))
        while at < len(order) and (clusters[order[at][1]] & same or planes[order[at][1]][-1] & own):
            at += 1
        if at < len(order):
            residual, found = order.pop(at)
        else:
            residual, found = capacity, len(clusters)
            clusters.append(0)
            planes.append([0] * per_source)
        clusters[found] |= same
        for k, plane in enumerate(planes[found]):
            if not plane & own:
                planes[found][k] = plane | own
                break
        insort(order, (residual - length, found))
        out.append(found)
    return out


def pack(docs: DataFrame, capacity: int = 2048, per_source: int = 2, shard_rows: int = 4096) -> DataFrame:
    """``docs`` (doc_id, source, text) -> a row per piece: doc_id, source, piece, start, length, bin_id."""
    rows = cut(measured(docs), "packing-lengths")
    shards = max(1, math.ceil(rows.count() / shard_rows))
    clusters = near_clusters(rows).select(F.col("fp").alias("_fp"), F.col("comp").alias("cluster"))
    dealt = rows.join(clusters, rows.fp == F.col("_fp")).drop("fp", "_fp").withColumn("shard", F.pmod(F.xxhash64("doc_id", "version"), F.lit(shards)))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(rest=part["words"] % capacity).sort_values(["rest", "doc_id", "version", "source"], ascending=[False, True, True, True], na_position="first", kind="stable")
        items = [(int(r), None if pd.isna(s) else s, int(c)) for r, s, c in zip(part["rest"], part["source"], part["cluster"], strict=True) if r]
        bins = iter(best_fit(items, capacity, per_source))
        first = int(key[0]) << 32
        taken = len(items)  # bins of whole sequences are numbered behind those of rests
        out: list[tuple] = []
        for doc_id, source, words, rest in zip(part["doc_id"], part["source"], part["words"], part["rest"], strict=True):
            doc_id = None if pd.isna(doc_id) else int(doc_id)
            whole = int(words) // capacity
            for piece in range(whole):
                out.append((doc_id, source, piece, piece * capacity, capacity, first + taken))
                taken += 1
            if rest or not whole:
                out.append((doc_id, source, whole, whole * capacity, int(rest), first + next(bins) if rest else None))
        frame = pd.DataFrame(out, columns=["doc_id", "source", "piece", "start", "length", "bin_id"])
        return frame.astype({"doc_id": "Int64", "bin_id": "Int64"})

    return dealt.groupBy("shard").applyInPandas(run, OUT)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece of a document: doc_id, source, piece, start, length (words), bin_id."""
    return pack(table(spark, sf_dir, "documents"))
