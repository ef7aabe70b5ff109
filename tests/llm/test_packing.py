import random
from collections import Counter, defaultdict

from recordkeep.llm.packing import best_fit, pack


def slow(items, capacity, per_source):
    bins = []
    out = []
    for length, source, cluster in items:
        fits = [(capacity - sum(i[0] for i in b), n) for n, b in enumerate(bins) if capacity - sum(i[0] for i in b) >= length and all(i[2] != cluster for i in b) and sum(i[1] == source for i in b) < per_source]
        n = min(fits)[1] if fits else len(bins)
        if n == len(bins):
            bins.append([])
        bins[n].append((length, source, cluster))
        out.append(n)
    return out


def test_tightest_compatible_bin():
    rng = random.Random(3)
    for per_source in (1, 2, 3):
        for _ in range(40):
            items = sorted(((rng.randrange(1, 41), rng.choice("aaab"), rng.choice([1, 1, 2, *range(3, 40)])) for _ in range(120)), key=lambda x: -x[0])
            assert best_fit(items, 40, per_source) == slow(items, 40, per_source)


def test_documents(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w%d" % rng.randrange(50) for _ in range(rng.choice([0, 1, 3, 7, 9, 10, 25, 30]))), rng.choice(["s", "s", "t", None])) for i in range(300)]
    rows += [(1000, None, "s"), (1001, "Same text", "s"), (1002, "same  TEXT", "t"), (1001, "Same text", "s"), (None, "no id", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, bin_id int")
    got = pack(df, capacity=10, per_source=2, shard_rows=64).collect()
    lengths = Counter()
    for r in got:
        lengths[r.doc_id] += r.length
        assert (r.bin_id is None) == (r.length == 0) and r.length <= 10 and r.start == r.piece * 10
    want = Counter()
    for i, t, _ in rows:
        want[i] += len((t or "").split())
    assert lengths == want
    held = defaultdict(list)
    text = {i: " ".join((t or "").lower().split()) for i, t, _ in rows}
    for r in got:
        if r.bin_id is not None:
            held[r.bin_id].append(r)
    for rs in held.values():
        assert sum(r.length for r in rs) <= 10
        assert max(Counter(r.source for r in rs).values()) <= 2
        assert len(rs) == len({text[r.doc_id] for r in rs})
    assert pack(df.limit(0)).collect() == []


def test_near_copies_never_share_a_bin(spark):
    rng = random.Random(5)
    base = [["v%d" % rng.randrange(10**6) for _ in range(600)] for _ in range(5)]
    rows = [(i, " ".join(w if n != at else "changed" for n, w in enumerate(base[i // 12])), f"s{i}") for i, at in enumerate(rng.randrange(600) for _ in range(60))]
    held = defaultdict(list)
    for r in pack(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        held[r.bin_id].append(r.doc_id // 12)
    assert all(len(x) == len(set(x)) for x in held.values()), sum(len(x) > len(set(x)) for x in held.values())
    assert len(held) == 24  # twelve for the first three texts, twelve for the others
