import hashlib
import random
import zlib

import pytest

from pyspark.sql import functions as F

from recordkeep.llm import merkle as M

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
KIND = "text string, doc_id long, leaf string, lang string, source string, n_chars long, hash string, tree string"


def leaf(doc_id, source, lang, n_chars, text):
    return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])


def climb(hashes):
    """Root of a list of leaves, and per leaf the siblings level by level as (before, after)."""
    ways, row, at = [[] for _ in hashes], list(hashes), list(range(len(hashes)))
    while len(row) > 1:
        for k, i in enumerate(at):
            first = i - i % 3
            ways[k].append(("".join(row[first:i]), "".join(row[i + 1 : first + 3])))
        row = [H(*row[i : i + 3]) for i in range(0, len(row), 3)]
        at = [i // 3 for i in at]
    return row[0], ways


def brute(rows, changed):
    """(doc_id, leaf, subroot, root, proof, folded) of rows (doc_id, source, lang, n_chars, text), sorted."""
    by = {}
    for r in rows:
        seen = (*r[:4], r[4].replace("\n", "")) if changed(r[0]) and r[4] is not None else r
        by.setdefault(r[1], []).append((r[0], leaf(*r), leaf(*seen)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[1] for x in sorted(by[s], key=lambda x: (x[0] is not None, x[0] or 0, *x[1:]))]) for s in order}
    root, ways = climb([trees[s][0] for s in order])
    out = []
    for s, up in zip(order, ways):
        for (i, own, seen), way in zip(sorted(by[s], key=lambda x: (x[0] is not None, x[0] or 0, *x[1:])), trees[s][1]):
            end = seen
            for a, b in [*way, *up]:
                end = H(a, end, b)
            out.append((i, own, trees[s][0], root, H(*[x for p in [*way, *up] for x in p]), end))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(t, i, "x", lang, s, n, "y", "z") for i, s, lang, n, t in rows], KIND)


def docs(sizes, seed=1):
    rng, rows, i = random.Random(seed), [], 0
    for source, n in sizes.items():
        for _ in range(n):
            i += rng.randrange(1, 4)
            rows.append((i, source, rng.choice(["en", None]), rng.choice([5, None]), rng.choice(["a\nb", "ñ", "", None, "x\n" * 50]) and f"{rng.random()}\n{rng.random()}"))
    rng.shuffle(rows)
    return rows


def got(spark, rows):
    out = M.manifest(table(spark, rows), F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"))).otherwise(F.col("text")))
    return sorted((tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", M.proof(F.col("path")), M.fold(F.col("path"), F.col("seen"))).collect()), key=repr)


@pytest.mark.parametrize("levels", [1, 2, 5])
def test_all_sizes_against_brute_force(spark, monkeypatch, levels):
    monkeypatch.setattr(M, "LEVELS", levels)
    rows = docs({f"s{n}": n for n in (1, 2, 3, 4, 9, 10, 28)} | {None: 7, "é": 3, "": 2})
    assert got(spark, rows) == brute(rows, lambda i: i % 2 == 0)


def test_several_tiers(spark):
    rows = docs({"hot": 800, "b": 243, "c": 244})
    assert got(spark, rows) == brute(rows, lambda i: i % 2 == 0)


def test_labels_cover_each_level_once(spark):
    rows = docs({"a": 300, "b": 20})
    found = M.tiers(M.ranked(M.cut(M.leaves(table(spark, rows))), ["doc_id"]).select("tree", "rank", "n", F.col("leaf").alias("hash"), F.struct("doc_id").alias("own")))
    nodes = M.nodes(found).collect()
    for tree, n in (("+a", 300), ("+b", 20)):
        by = {}
        for x in nodes:
            if x.tree == tree:
                by.setdefault(x.level, []).append((x.lo, x.hi))
        assert sorted(by) == list(range(max(by) + 1)) and len(by[max(by)]) == 1
        for level, spans in by.items():
            spans.sort()
            assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
            assert all(b - a == 3**level for a, b in spans[:-1])
    assert {x.hash for x in nodes if x.level == 0} == {leaf(*r) for r in rows}


def test_defined_cases(spark):
    rows = [(5, "s", "en", 1, "same"), (5, "s", "en", 1, "same"), (5, "s", "en", 1, "other\n"), (None, "s", None, None, None), (None, None, "de", 0, ""), (6, "s", "en", 3, "long\n" * 200_000)]
    assert got(spark, rows) == brute(rows, lambda i: i is not None and i % 2 == 0)
    assert got(spark, []) == []
    one = [(3, "only", "en", 1, "x")]
    assert got(spark, one) == brute(one, lambda i: False) and got(spark, one)[0][1] == got(spark, one)[0][3]


def test_query(spark, tmp_path):
    rows = docs({"a": 60, "b": 5, None: 9}, 4)
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = M.op12_merkle_manifest(spark, str(tmp_path)).collect()
    hit = lambda i: zlib.crc32(str(i).encode()) % 2 == 0
    assert sorted((tuple(r)[:6] for r in out), key=repr) == brute(rows, hit)
    text = {r[0]: r[4] for r in rows}
    assert all(r.verified == (not hit(r.doc_id) or "\n" not in (text[r.doc_id] or "")) for r in out)
