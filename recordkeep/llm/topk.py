"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Every component becomes the integer floor(256 * x). Candidates are dealt into shards of bounded size, each candidate
to one; queries travel to every shard and stream past it, so no task holds more than a shard and a batch of queries.

In a shard, every dimension is a list of (value, candidate) sorted by value. A query reads all lists in step, strictly
by position: from the upper end where it weighs the dimension up, from the lower end elsewhere, and not at all where its
weight is 0. What was read of a candidate is summed up. What is unread of a list is between its frontier and its other
end, so each candidate has a lower and an upper bound: its sum and that of the ends, or of the frontiers, of the lists in
which it has not been met. The score to beat is the k-th best of the scores resolved so far, in this shard or before,
and of the lower bounds. After the first depth the most promising candidates are resolved, so that there is a score to
beat at once. Reading stops when few candidates can still qualify; their scores are then resolved.

Bounds are exact where sums fit a double, else they are widened by the largest possible rounding error; scores are exact
integers of any size, and move as two words, so that they are ranked exactly even where they do not fit a long.

Defined cases: vectors that are null, or hold a null, NaN or infinity, take no part; rows with a null vec_id neither;
vectors are compared with those of their own length only, however long; rows with the query's vec_id are the query's
own; other ids that repeat are separate candidates, and queries whose ids repeat are answered one by one; ties go to the
smaller vec_id; empty vectors score 0; extra columns are ignored. A score that does not fit a long is null, at its
right rank; one of 2^125 or more ends the query with an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordkeep.llm.tables import table
from recordkeep.plans.lineage import cut

#: Cells of a shard, and its candidates at most.
CELLS, BLOCK = 1 << 20, 16384
#: Shares of each list that are read before the bounds are looked at again.
DEPTHS = (0.1, 0.5, 0.65, 0.8, 0.9, 1.0)
FEW = 32  # candidates that are resolved without reading on
WORD = 62  # bits of a score's lower word


class Shard:
    """Sorted lists of the candidates ``ids`` with integer components ``x`` (n x dims, whole numbers as doubles)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.order = np.argsort(x, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(x, self.order, axis=0)
        self.largest = np.abs(x).max(axis=0, initial=0)
        self._read: dict[type, list] = {}
        self._last: dict[type, tuple] = {}

    def entries(self, d: int, start: int, end: int, up: bool) -> tuple[np.ndarray, np.ndarray]:
        """(candidates, values) at the positions from ``start`` to ``end`` of one list, from its upper or its lower end."""
        n = len(self.ids)
        rows = slice(n - end, n - start) if up else slice(start, end)
        return self.order[rows, d], self.sorted[rows, d]

    def frontiers(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The largest unread value of each list behind ``depth`` entries from above, and the smallest from below; 0 if all are read."""
        n = len(self.ids)
        return (np.zeros(self.x.shape[1]),) * 2 if depth >= n else (self.sorted[n - 1 - depth], self.sorted[depth])

    def reading(self, kind: type) -> Iterator[tuple[int, list[np.ndarray], list[np.ndarray]]]:
        """At each of DEPTHS: entries read of each list, and per end (upper, lower) what each cell is at most and at least.

        A cell is its value once the list has been read as far as its candidate; before, its list's frontier is the one
        bound and its list's other end the other. Lists are read on from where the depth before ended; what was read stays,
        for the queries of the next batch.
        """
        n, dims = self.x.shape
        if kind not in self._read:
            self._read[kind] = []
        made = self._read[kind]
        at, known, unread = 0, [np.zeros((n, dims), kind) for _ in range(2)], [np.ones((n, dims), bool) for _ in range(2)]
        for step, share in enumerate(DEPTHS):
            depth = min(n, math.ceil(share * n))
            if step >= len(made):
                if step and made:  # of the depth before: what is known, and where
                    at, known, unread = self._last[kind]
                for own, open_, up in zip(known, unread, (True, False), strict=True):
                    for d in range(dims):
                        who, value = self.entries(d, at, depth, up)
                        own[who, d] = value
                        open_[who, d] = False
                self._last[kind] = (depth, known, unread)
                frontier, ends = self.frontiers(depth), (self.sorted[0], self.sorted[-1])
                most = [np.where(o, f.astype(kind), v) for o, f, v in zip(unread, frontier, known, strict=True)]
                least = [np.where(o, e.astype(kind), v) for o, e, v in zip(unread, ends, known, strict=True)] if not step else []
                made.append((depth, most, least))
            yield made[step]

    def best(self, query_ids: np.ndarray, q: np.ndarray, k: int, stats: dict | None = None) -> list[list[tuple[int, int]]]:
        """Per query its k best (-score, id), scores as Python integers. ``stats`` counts entries read, cells resolved, and cells in all.

        The queries of a batch read in step, so that an entry is fetched once for all that read its list from that end.
        """
        stats = {} if stats is None else stats
        n, dims = self.x.shape
        width = float(self.largest @ np.abs(q).max(axis=0, initial=0)) if dims else 0.0
        kind = np.float32 if width < 1 << 23 else np.float64
        slack = 0.0 if width < 1 << 52 else width * (4 * dims + 16) * 2.0**-52
        sides = [np.maximum(q, 0).T.astype(kind), np.minimum(q, 0).T.astype(kind)]  # of queries still reading, dims x queries
        live, weighed = np.arange(len(q)), np.count_nonzero(q, axis=1)
        open_ = self.ids[:, None] != query_ids[None, :]  # may still qualify, and is not resolved
        found: list[list[tuple[int, int]]] = [[] for _ in query_ids]
        stats["all"] = stats.get("all", 0) + n * dims * len(q)

        def resolve(column: int, rows: np.ndarray) -> None:
            stats["resolved"] = stats.get("resolved", 0) + len(rows) * dims
            i = live[column]
            found[i] = _merged(found[i], self, rows, q[i], width, k)

        at, depths = 0, self.reading(kind)
        for step in range(len(DEPTHS)):
            done = open_.sum(axis=0) <= FEW
            if done.any():
                for column in np.flatnonzero(done):
                    resolve(column, np.flatnonzero(open_[:, column]))
                live, open_, sides = live[~done], open_[:, ~done], [s[:, ~done] for s in sides]
            if not len(live):
                return found
            depth, most, worst = next(depths)
            stats["read"] = stats.get("read", 0) + (depth - at) * int(weighed[live].sum())
            at = depth
            upper = most[0] @ sides[0] + most[1] @ sides[1]
            if not step:  # the most promising are resolved, so that there is a score to beat
                few = min(n, max(k, FEW))
                top = np.argpartition(np.where(open_, -upper, np.inf), few - 1, axis=0)[:few]
                for column in range(len(live)):
                    rows = top[:, column][open_[top[:, column], column]]
                    resolve(column, rows)
                    open_[rows, column] = False
            least = np.array([-float(found[i][-1][0]) if len(found[i]) == k else -np.inf for i in live])
            if not step and n > k:
                lower = np.where(open_, worst[0] @ sides[0] + worst[1] @ sides[1], -np.inf)
                least = np.maximum(least, np.partition(lower, n - k, axis=0)[n - k] - slack)
            open_ &= upper >= least - slack
        for column in range(len(live)):
            resolve(column, np.flatnonzero(open_[:, column]))
        return found


def _merged(have: list[tuple[int, int]], lists: Shard, rows: np.ndarray, q: np.ndarray, width: float, k: int) -> list[tuple[int, int]]:
    """The k best of ``have`` and of ``rows``, whose scores are resolved here."""
    if not len(rows):
        return have
    ids = lists.ids[rows]
    if width < 1 << 61:
        scores = lists.x[rows].astype(np.int64) @ q.astype(np.int64)
        top = np.lexsort((ids, -scores))[:k]
        new = list(zip((-scores[top]).tolist(), ids[top].tolist(), strict=True))
    else:
        weights = [int(c) for c in q]
        new = [(-sum(int(a) * b for a, b in zip(row, weights, strict=True)), i) for row, i in zip(lists.x[rows], ids.tolist(), strict=True)]
    return sorted(have + new)[:k]


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) as doubles, which hold these integers exactly."""
    cells = np.floor(x * 256.0)
    if not np.isfinite(cells).all():
        raise ArithmeticError("a component is too large")
    return cells


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], np.ndarray, np.ndarray, np.ndarray]]:
    """((dims, shard, kind), row ids, vec_ids, components) of neighbouring rows that agree in the first three."""
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
        ends = [*(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)] if len(keys) else []
        for at, end in zip([0, *ends], ends, strict=False):
            part = batch.slice(at, end - at)
            cells = part.column(5).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            yield tuple(keys[at].tolist()), part.column(3).to_numpy(), part.column(4).to_numpy(), whole_numbers(cells.reshape(len(part), keys[at][0]))


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, batch: int = 128) -> DataFrame:
    """``vectors`` and ``queries`` (vec_id, embedding) -> query_id, rank, vec_id, score. A shard has ``block`` candidates, fewer of long vectors."""

    def whole(df: DataFrame, name: str) -> DataFrame:
        ok = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~F.coalesce(F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(True))
        out = df.where(ok).select(F.size("embedding").alias("dims"), F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
        return cut(out, name)

    asked, found = whole(queries, "top-k-queries"), whole(vectors, "top-k-vectors")
    size = found.agg(F.count("*").alias("n"), F.coalesce(F.max("dims"), F.lit(1)).alias("dims")).first()
    shards = max(1, math.ceil(size.n / max(1, min(block, CELLS // max(1, size.dims)))))
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    rows = found.select("dims", shard.alias("shard"), F.lit(0).alias("kind"), "row", "vec_id", "v").unionByName(asked.select("dims", every.alias("shard"), F.lit(1).alias("kind"), "row", "vec_id", "v"))
    met = rows.repartitionByRange(shards, "dims", "shard").sortWithinPartitions("dims", "shard", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, own = None, [], None
        for (dims, number, kind), row, ids, x in _runs(batches):
            if place != (dims, number):
                place, held, own = (dims, number), [], None
            if not kind:
                held.append((ids, x))
                continue
            if not held:
                continue
            own = own or Shard(*(np.concatenate(c) for c in zip(*held, strict=True)))
            for at in range(0, len(ids), batch):
                part = slice(at, at + batch)
                best = own.best(ids[part], x[part], k)
                out = [(int(r), int(i), vec_id, -score) for r, i, f in zip(row[part], ids[part], best, strict=True) for score, vec_id in f]
                if any(abs(r[3]) >> 125 for r in out):
                    raise ArithmeticError("a score is too large")
                out = [(*r[:3], r[3] >> WORD, r[3] & ((1 << WORD) - 1)) for r in out]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(5)], names=["row", "query_id", "vec_id", "high", "low"])

    near = met.mapInArrow(run, "row long, query_id long, vec_id long, high long, low long")
    ranked = Window.partitionBy("row").orderBy(F.desc("high"), F.desc("low"), "vec_id")
    score = F.when(F.col("high").between(-2, 1), F.shiftleft("high", WORD) + F.col("low"))
    return near.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score for every 50th vector against all others."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return exact_top_k(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
