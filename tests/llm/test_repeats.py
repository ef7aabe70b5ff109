import random
from collections import Counter

import numpy as np
import pyarrow as pa

from recordkeep.llm import repeats
from recordkeep.llm.repeats import SIZE, SPAN, WIDTH, cut_out, digest, merged, op6_suffix_array_dedup, parsed, shared, with_neighbours, without_repeats


def brute(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[s : s + SIZE] for _, b in texts for s in range(len(b) - SIZE + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - SIZE + 1):
            if seen[b[s : s + SIZE]] > 1:
                gone[s : s + SIZE] = b"\1" * SIZE
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), runs, digest(kept)))
    return sorted(out, key=repr)


def test_each_start_belongs_to_one_row():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abc ") for _ in range(n)) for n in (0, 199, 200, 201, 1000, 5000)] + [b"z" * 900, b"ab" * 700, rng.randbytes(SPAN + 1000)]
    seen, count = {}, Counter()
    for rows in parsed(texts):
        for n, pos, left, right, least, more in zip(*(rows[c].tolist() for c in ("number", "pos", "left", "right", "least", "more")), strict=True):
            assert 0 <= least <= left < WIDTH and right <= SIZE - least
            count[n] += 1
            for s in range(pos - left, pos + more * (left + 1) - least + 1):
                assert (n, s) not in seen
                seen[n, s] = None if more else pos - s
    assert set(seen) == {(n, s) for n, t in enumerate(texts) for s in range(len(t) - SIZE + 1)}
    assert count[6] < 5 and count[7] < 6 and count[8] < (SPAN + 1000) / 70  # runs take few rows
    by_string = {}
    for (n, s), place in seen.items():
        if n < 6:  # equal strings lie alike around their trigger
            assert by_string.setdefault(texts[n][s : s + SIZE], place) == place


def test_neighbours(spark):
    assert shared(pa.array([b"abc", b"abd", b"ab", b"", b"x" * 200, b"x" * 200], pa.binary())).tolist() == [2, 2, 0, 0, 200]
    rng = random.Random(6)
    rows = [(i, rng.randrange(3), bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 9)))) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, key long, back binary").repartition(3)
    got = {r.i: r.n for r in with_neighbours(df, ["key", "back"], "back", "n", within="key").collect()}
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    best = {i: max(common(b, c) for j, l, c in rows if j != i and l == k) for i, k, b in rows}
    wrong = [i for i in best if got[i] != best[i]]
    assert len(wrong) <= 2 and all(got[i] == SIZE for i in wrong)  # the rims are left open


def test_merged():
    got = merged(np.array([5, 0, 3, 10, 20, 6]), np.array([9, 2, 3, 12, 20, 7]))
    assert [x.tolist() for x in got] == [[0, 5, 20], [3, 12, 20]]
    assert [x.tolist() for x in merged(np.empty(0, int), np.empty(0, int))] == [[], []]


def test_long_runs_and_parts(spark, monkeypatch):
    """Texts over several parts, and runs of one byte."""
    monkeypatch.setattr(repeats, "PER_TASK", 40)
    rng = random.Random(8)
    body = "".join(rng.choice("abcdefgh ") for _ in range(900))
    quiet = "q"
    far = body[:400] + "".join(rng.choice("ijkl") for _ in range(SPAN + 300)) + body[300:]
    rows = [(1, "z" * 1_000_000), (2, far), (3, quiet * 450 + body[500:720]), (4, quiet * 199), (5, "no" + quiet * 210)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in without_repeats(df).collect()}
    # 220 bytes of the long text stand in another; the 100 that it repeats itself are too few
    assert got == {1: (1_000_000, 1), 2: (220, 1), 3: (450 + 220, 1), 4: (0, 0), 5: (210, 1)}


def test_cut_out():
    text = bytes(range(256)) * 4
    assert cut_out(text, []) == (text, 0)
    assert cut_out(text, [(0, 0), (200, 210), (600, 600), (5, 5)]) == (text[410:600] + text[800:], 2)


def test_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(60) for _ in range(5)]
    rows = []
    for i in range(50):
        parts = [text(rng.randrange(0, 120)) for _ in range(3)]
        if i % 2:
            parts.insert(1, rng.choice(shared))
        rows.append((i, " ".join(parts)))
    for k in range(12):  # near copies
        body = rows[k * 3][1].split(" ")
        for _ in range(k % 4):
            body[rng.randrange(len(body))] = word()
        rows.append((200 + k, " ".join(body)))
    for cut in (198, 199, 200, 201, 202, 296, 297, 298, 393):
        rows.append((300 + cut, text(20) + shared[0][3 : 3 + cut] + text(20)))
    rows += [(400, None), (401, ""), (402, "z" * 700), (403, "zy" * 300), (404, "z" * 199), (405, rows[4][1]), (405, rows[4][1]), (None, rows[6][1]), (None, text(80)), (406, (text(30) + " ") * 3)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, k int").repartition(3)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, digest(bytes(r.kept))) for r in without_repeats(df).collect()]
    assert sorted(got, key=repr) == brute(rows)
    assert without_repeats(df.limit(0)).collect() == []


def test_query_on_a_small_table(spark, tmp_path):
    rows = [(1, "a" * 150 + "b" * 150), (2, "b" * 40 + "a" * 150 + "b" * 100)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted((tuple(r) for r in op6_suffix_array_dedup(spark, str(tmp_path)).collect()), key=repr) == brute(rows)


def thue_morse(n, flip=0, letters="ab"):
    return "".join(letters[(bin(i).count("1") + flip) & 1] for i in range(n))


def test_hashes_tell_structured_texts_apart():
    """Sums of bytes times powers modulo 2^64 agree in 49 to 64 low bits for these, the longer ones in all."""
    for size in (256, 512, 4096):
        pair = [repeats.Windows(np.frombuffer(thue_morse(size, flip).encode(), np.uint8)) for flip in (0, 1)]
        for word in (0, 1):
            a, b = (int(w.parts[word][0][size - repeats.GRAM + 1]) for w in pair)
            difference = (a - b) % (1 << 64)
            assert difference and (difference & -difference).bit_length() <= 8
    buffer = np.random.default_rng(1).integers(97, 99, 3000).astype(np.uint8)
    windows, seen = repeats.Windows(buffer), {}
    for size in (8, 9, 41, 300):
        at = np.arange(len(buffer) - size)
        for i, h in zip(at, zip(windows.hash(at, at + size, 0).tolist(), windows.hash(at, at + size, 1).tolist())):
            assert seen.setdefault(buffer[i : i + size].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)


def test_thue_morse_and_periodic_texts(spark):
    rows = [(1, thue_morse(1024)), (2, thue_morse(1024, 1)), (3, thue_morse(700, letters="xy")), (4, thue_morse(700, 1, "xy")), (5, "abc" * 120), (6, "bca" * 90 + "z" + "abc" * 70), (7, "q" * 500), (8, thue_morse(300, 0, "é~"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, digest(bytes(r.kept))) for r in without_repeats(docs).collect()]
    assert sorted(got, key=repr) == brute(rows)
