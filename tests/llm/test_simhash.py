import random
import re

import xxhash

from recordkeep.llm.graph import components
from recordkeep.llm.simhash import chain_links, close_links, fingerprint, fingerprints, one_per_group, simhash_groups


def slow_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def slow_components(nodes, near):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def apart(a, b):
    return bin((a ^ b) & (1 << 64) - 1).count("1")


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 140)] + [(1, k) for k in range(200, 260)] + [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(40)] + [(5, 5), (None, 3), (1, 200)]
    nodes = {n for a, b in links if a is not None and a != b for n in (a, b)}
    want = slow_components(nodes, lambda a, b: (a, b) in set(links) or (b, a) in set(links))
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_fingerprints(spark):
    texts = [None, "", " \t\n", "One", "one TWO", "A b\x0bc  d", "Été ÉTÉ Z z z z", "x y " * 40_000, "the same three words " * 3]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    assert [r.fp for r in sorted(fingerprints(df).collect(), key=lambda r: r.doc_id)] == [slow_fingerprint(t) for t in texts]


def test_links_of_planted_fingerprints(spark):
    """Neighbours at every distance around few centres, ties at segment borders included."""
    rng = random.Random(5)
    fps = {0, -1}
    for _ in range(25):
        centre = rng.getrandbits(64)
        for d in (0, 1, 2, 3, 3, 3, 3, 3, 4, 4, 5, 6):
            value = centre
            for b in rng.sample(range(64), d):
                value ^= 1 << b
            fps.add(value - (1 << 64) if value >> 63 else value)
    want = slow_components(fps, lambda a, b: apart(a, b) <= 3)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    assert all(apart(r.a, r.b) <= 2 for r in close_links(df).collect())
    near = {tuple(sorted((r.a, r.b))) for r in chain_links(df.selectExpr("fp", "fp comp")).collect()}
    assert near == {tuple(sorted((r.a, r.b))) for r in chain_links(df.selectExpr("fp", "fp comp"), hot=0).collect()}  # keys of three segments
    all_near = {(a, b) for a in fps for b in fps if a < b and apart(a, b) <= 3}
    assert near == all_near
    pairs = [(a, b) for a, b in all_near]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {n: got.get(n, n) for n in fps} == want


def test_documents_against_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    rows = [(90, None), (91, ""), (92, "  "), (None, "a b c d"), (93, "a b c d"), (94, "A  b c\td")]
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([30, 200, 700]))]
        for copy in range(6):
            edited = list(text)
            for _ in range(copy // 2):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            rows.append((base * 6 + copy, " ".join(edited)))
    rows.append(rows[-1])
    fps = [fingerprint(t) for _, t in rows]
    assert fps == [slow_fingerprint(t) for _, t in rows]
    comp = slow_components(set(fps), lambda a, b: apart(a, b) <= 3)
    first = {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            first[comp[f]] = min(i, first.get(comp[f], i))
    want = sorted(((i, f, first.get(comp[f])) for (i, _), f in zip(rows, fps, strict=True)), key=repr)
    got = simhash_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.fp, r.component_id) for r in got.collect()), key=repr) == want


def test_empty_table(spark):
    assert simhash_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_document_stays(spark):
    rows = [(5, "a b c d", "x"), (2, "A b  c d", "x"), (9, "e f g h i", "x"), (9, "e f g h i", "x"), (9, "a b c d", "x"), (None, "a b c d", "x"), (None, "no id here", "x"), (3, None, "x"), (4, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string")
    got = sorted(((r.doc_id, r.text) for r in one_per_group(df).collect()), key=repr)
    assert got == sorted([(2, "A b  c d"), (9, "e f g h i"), (None, "no id here"), (3, None)], key=repr)
    assert one_per_group(df).columns == df.columns
