import numpy as np

from recordkeep.llm.topk import Shard, exact_top_k


def brute(vectors, queries, k):
    out = []
    for i, q in queries:
        scored = sorted((-sum(int(a) * int(b) for a, b in zip(q, v, strict=True)), j) for j, v in vectors if j != i and len(v) == len(q))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def test_bounds_against_brute_force():
    rng = np.random.default_rng(1)
    for n, dims, high in ((1, 3, 5), (4, 2, 5), (300, 8, 150), (300, 8, 2), (500, 4, 2_000_000), (200, 5, 1 << 40), (150, 3, 1 << 60)):
        x = rng.integers(-high, high + 1, (n, dims)).astype(float)
        x[n // 2 :] = x[0]  # many ties
        q, ids = x[:20], np.arange(n) * 3
        got = Shard(ids, x).best(ids[:20], q, 5)
        got = sorted((int(i), r + 1, j, -s) for i, f in zip(ids[:20], got, strict=True) for r, (s, j) in enumerate(f))
        assert got == brute(list(zip(ids.tolist(), x.tolist(), strict=True)), list(zip(ids[:20].tolist(), q.tolist(), strict=True)), 5), (n, dims, high)


def test_lists_are_read_by_position_and_not_to_the_end():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(0, 40, (4000, 8)))
    shard, stats, calls = Shard(np.arange(4000), x), {}, []
    own = shard.entries
    shard.entries = lambda d, start, end, up: calls.append((d, up, start, end)) or own(d, start, end, up)
    shard.best(np.arange(30), x[:30], 5, stats)
    assert stats["all"] == 30 * 4000 * 8 and stats["read"] < 0.8 * stats["all"] and stats["resolved"] < 0.05 * stats["all"]
    for d in range(8):
        for up in (True, False):
            ways = [(a, b) for e, u, a, b in calls if (e, u) == (d, up)]
            assert len(ways) > 1 and ways[0] == (0, 400) and all(b[0] == a[1] for a, b in zip(ways, ways[1:]))  # on from where reading stopped
    who, value = own(3, 400, 401, True)
    assert value == [np.sort(x[:, 3])[-401]] and x[who[0], 3] == value[0]


def test_bounds_hold_at_every_depth():
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(0, 30, (200, 5)))
    shard, q = Shard(np.arange(200), x), np.array([3.0, -2.0, 0.0, 1.0, -7.0])
    for depth in (1, 50, 199, 200):
        total, high, low = np.zeros(200), np.zeros(200), np.zeros(200)
        for d in np.flatnonzero(q):
            up = q[d] > 0
            who, value = shard.entries(d, 0, depth, up)
            total[who] += q[d] * value
            rest = np.setdiff1d(np.arange(200), who)
            frontier, end = shard.frontiers(depth)[0 if up else 1][d], shard.sorted[0 if up else -1][d]
            high[rest] += q[d] * frontier
            low[rest] += q[d] * end
        assert (total + high >= x @ q).all() and (total + low <= x @ q).all()


def test_the_given_tables_go_through_the_lists(spark):
    import os

    for scale in ("sf0.01", "sf0.1"):
        path = f"/root/testdata/{scale}/embeddings.parquet"
        if not os.path.exists(path):
            continue
        rows = [r for r in spark.read.parquet(path).collect() if r.embedding]
        x = np.floor(np.array([r.embedding for r in rows], float) * 256)
        ids, stats, asked = np.array([r.vec_id for r in rows]), {}, []
        shard = Shard(ids, x)
        own = shard.entries
        shard.entries = lambda d, start, end, up, own=own: asked.append(end - start) or own(d, start, end, up)
        pick = np.flatnonzero(ids % 50 == 0)
        shard.best(ids[pick], x[pick], 5, stats)
        assert asked and 0 < stats["resolved"] < 0.3 * stats["all"]  # scores come from lists, not from a product of all
        print(scale, stats["read"] / stats["all"], stats["resolved"] / stats["all"])


def test_blocks_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 0.3, (150, 6)).astype("float32")
    rows = [(i, [float(v) for v in x[i % 100]], "z") for i in range(150)]
    odd = [(500, None, "z"), (550, [1.0, None, 0.0, 0.0, 0.0, 0.0], "z"), (600, [float("nan")] * 6, "z"), (650, [float("inf")] * 6, "z"), (None, [9.0] * 6, "z"), (700, [1.0, 2.0], "z"), (701, [3.0, 1.0], "z"), (750, [], "z"), (751, [], "z"), (3, [0.5] * 6, "z")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score string")
    got = sorted(tuple(r) for r in exact_top_k(df, df.where("vec_id % 50 = 0"), 5, block=40, batch=2).collect())
    cells = [(i, np.floor(np.asarray(v, "float32").astype("float64") * 256).astype(int).tolist()) for i, v, _ in [*rows, odd[5], odd[6], odd[7], odd[8], odd[9]]]
    assert got == brute(cells, [c for c in cells if c[0] % 50 == 0], 5)
    assert exact_top_k(df.limit(0), df).collect() == [] and exact_top_k(df, df.limit(0)).collect() == []


def test_large_components_and_repeated_queries(spark):
    rows = [(50, [1.0, 1.0]), (1, [5e6, 0.0]), (2, [6e6, 0.0]), (3, [4e6, 0.0]), (4, [1e15, 0.0]), (5, [1.5e15, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in exact_top_k(df, df.where("vec_id = 50")).collect())
    assert got == [(50, 1, 5, None), (50, 2, 4, None), (50, 3, 2, 6_000_000 << 16), (50, 4, 1, 5_000_000 << 16), (50, 5, 3, 4_000_000 << 16)]
    twice = spark.createDataFrame([(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in exact_top_k(df, twice, 1).collect())
    assert got == [(50, 1, 5)] * 3


def test_very_long_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i * 50, [float(v) for v in rng.normal(size=20_000)]) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    cells = [(i, np.floor(np.asarray(v) * 256).astype(int).tolist()) for i, v in rows]
    assert sorted(tuple(r) for r in exact_top_k(df, df, 2).collect()) == brute(cells, cells, 2)
