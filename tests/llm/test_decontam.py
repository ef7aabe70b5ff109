import random

import numpy as np

from recordkeep.llm import decontam
from recordkeep.llm.decontam import CHUNK, Items, answer_of, bit_masks, clean, common_length, contaminated, holds, latent_basis, passages, verdict, words_of


def slow_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def test_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = (rng.integers(0, 5, rng.integers(1, 30)) for _ in range(2))
        assert common_length(len(a), bit_masks(a), b) == slow_common(a.tolist(), b.tolist())


def test_words_and_answers():
    assert words_of("A, b-c (D)! -- é") == ["a", "bc", "d", "é"]
    assert answer_of("What is it? A stone. The red one") == ["the", "red", "one"]
    assert answer_of("Q: what?\nAnswer: the blue one.") == ["the", "blue", "one"] and answer_of("...") == []
    assert holds(np.array([1, 2, 3, 2, 4]), np.array([2, 4])) and not holds(np.array([1, 2]), np.array([2, 1])) and not holds(np.array([1]), np.array([], int))


def test_passage_sums():
    """Parts of very long documents give the same passages as the whole."""
    rng = np.random.default_rng(2)
    matrix = np.vstack([np.zeros(3), rng.normal(size=(9, 3))]).astype(np.float32)
    docs = [rng.integers(0, 10, n) for n in (0, 1, 24, 25, 60, 500, CHUNK * 2 + 100)]
    got = {}
    for _, _, sums, doc, number in passages(docs, matrix):
        pair = sums + np.roll(sums, -1, axis=0)
        for i in np.flatnonzero(number >= 0):
            got.setdefault((int(doc[i]), int(number[i])), []).append(pair[i])
    for d, ids in enumerate(docs):
        for first in range(0, max(1, len(ids) - 24), 24):
            (found,) = got.pop((d, first // 24))
            assert np.allclose(found, matrix[ids[first : first + 48]].sum(axis=0), atol=1e-3)
    assert all(np.allclose(v[0], 0) for v in got.values())


def corpus(rng):
    common = [f"c{i}" for i in range(60)]
    rare = [f"r{i}x" for i in range(4000)]
    sentence = lambda n: [rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(n)]
    items = [(i, sentence(rng.randrange(15, 60))) for i in range(30)]
    docs = [(i, sentence(rng.randrange(0, 300))) for i in range(300)]
    return items, docs, sentence


def test_planted_items(spark):
    rng = random.Random(3)
    items, docs, sentence = corpus(rng)
    want = set()
    for k in range(40):
        item_id, words = items[k % 30]
        how = k % 4
        body = list(words)
        if how == 1:  # some words replaced
            for at in rng.sample(range(len(body)), len(body) // 7):
                body[at] = "other"
        elif how == 2:  # words put in
            for _ in range(len(body) // 5):
                body.insert(rng.randrange(len(body)), "extra")
        elif how == 3:
            body = [w.upper() + "," for w in body]
        docs.append((1000 + k, sentence(rng.randrange(0, 200)) + body + sentence(rng.randrange(0, 200))))
        want.add((1000 + k, item_id))
    rows = [(i, " ".join(w), "s") for i, w in docs]
    rows += [(5000, None, "s"), (5001, "", "s"), (1000, rows[300][1], "s"), (None, " ".join(items[4][1]), "s")]
    want.add((None, 4))
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id string").repartition(5)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(77, None), (78, "?!"), (None, "x"), (3, " ".join(items[3][1]))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(df, bench).collect()}
    assert got == want
    small_blocks = {(r.doc_id, r.item_id) for r in contaminated(df, bench, block_items=13).collect()}
    assert small_blocks == want
    kept = clean(df, bench)
    assert kept.columns == df.columns and kept.count() == len(rows) - len(docs[300:]) - 2
    assert contaminated(df, bench.limit(0)).count() == 0 and contaminated(df.limit(0), bench).count() == 0
    assert Items([(1, None), (2, "")]).ids == []


def test_items_of_all_lengths(spark):
    """Exact copies and near copies of short and long items are found as brute force finds them, and nothing else."""
    rng = random.Random(9)
    _, _, sentence = corpus(rng)
    items = [(10 * n + i, [f"w{rng.randrange(9000)}" if rng.random() < 0.6 else sentence(1)[0] for _ in range(n)]) for n in (3, 5, 7, 13, 49, 100, 300, 600, 1500) for i in range(3)]
    docs = [(i, sentence(rng.randrange(0, 300))) for i in range(100)]
    for i, (_, words) in enumerate(items):
        body = list(words)
        if i % 3 == 1:
            for at in rng.sample(range(len(body)), len(body) // 6):
                body[at] = "other"
        docs.append((1000 + i, sentence(rng.randrange(60, 200)) + body + sentence(rng.randrange(60, 200))))
    want = set()
    for d, words in docs:
        for k, item in items:
            n, code = len(item), {w: j + 1 for j, w in enumerate(dict.fromkeys(item))}
            ids, own = np.array([code.get(w, 0) for w in words], np.uint32), np.array([code[w] for w in item], np.uint32)
            if np.isin(own, ids).mean() < 0.5:
                continue
            step = 1 if n <= 13 else 24
            parts = (ids[max(0, p - 2 * n) : p + 2 * n + 1] if n <= 13 else ids[max(0, p - n) : p + 48 + n] for p in range(0, max(1, len(ids)), step))
            if any(verdict(own, bit_masks(own), own, bit_masks(own), p) for p in parts):
                want.add((d, k))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(df, bench).collect()}
    planted = {(1000 + i, items[i][0]) for i in range(len(items))}
    assert planted - {(1000 + i, items[i][0]) for i in range(len(items)) if i % 3 == 1} <= got
    assert got == want


def test_words_are_split_whole(spark):
    """Pieces of a batch, leading and trailing blanks, nulls and a very long text give the words of the whole."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(40)]
    texts = [None, "", "  ", " a  b\n", "w1, W2! -- w3", "(W4) \"w5\" w-6 w7's ẃ8 W9É w10É. É ... |w11| w12;w13", " ".join(rng.choice(words) for _ in range(400_000)), "\u3000w1\u00a0w2 "]
    items = Items([(1, " ".join(words))])
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(1)
    got = {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in decontam.encoded(df, items).collect()}
    want = {i: [items.vocabulary.get(w, 0) for w in words_of(t or "")] for i, t in enumerate(texts)}
    assert got == {i: w for i, w in want.items() if any(w)}


def test_verdicts():
    item, answer = np.arange(1, 41), np.arange(31, 41)
    judge = lambda part: verdict(item, bit_masks(item), answer, bit_masks(answer), np.array(part))
    assert judge(range(1, 25)) == (0.6, False) and judge(range(1, 24)) is None
    assert judge([*range(1, 16), *range(31, 36)]) == (0.5, True) and judge([*range(1, 17), *range(31, 35)]) is None
    middle = np.arange(1, 21)
    fair = lambda part: verdict(middle, bit_masks(middle), middle[-4:], bit_masks(middle[-4:]), np.array(part))
    assert fair([*range(1, 9), 17, 18]) is None and fair([*range(1, 10), 17, 18]) == (0.55, True) and fair([*range(1, 7), 17, 18, 19, 20]) == (0.5, True)
    long_answer = verdict(middle, bit_masks(middle), middle[8:], bit_masks(middle[8:]), middle[8:])
    assert long_answer == (0.6, True) and verdict(middle, bit_masks(middle), middle[8:], bit_masks(middle[8:]), middle[9:]) is None
    short = np.arange(1, 11)
    brief = lambda part, a: verdict(short, bit_masks(short), np.array(a, int), {}, np.array(part))
    assert brief(range(1, 8), []) is None and brief(range(1, 9), []) == (0.8, False)
    assert brief([1, 2, 3, 9, 10], [9, 10]) == (0.5, True) and brief([1, 2, 3, 4, 9], [9, 10]) is None


def test_paraphrases(spark):
    """Copies with a share of their words replaced, those of the answer as well; clean documents stay clean."""
    rng = random.Random(21)
    _, _, sentence = corpus(rng)
    items = [(i, " ".join(sentence(rng.randrange(14, 40))) + ". " + " ".join(sentence(rng.randrange(3, 12))) + ".") for i in range(40)]
    docs, want = [(i, " ".join(sentence(rng.randrange(0, 300)))) for i in range(200)], {}
    for strength in (0, 15, 25, 33):
        for i, text in items:
            body = text.split()
            for at in rng.sample(range(len(body)), len(body) * strength // 100):
                body[at] = rng.choice(sentence(3)) + ("." if body[at].endswith(".") else "")
            docs.append((1000 * (strength + 1) + i, " ".join([*sentence(60), *body, *sentence(60)])))
            want.setdefault(strength, set()).add((docs[-1][0], i))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.item_id) for r in contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    recall = {k: len(v & got) / len(v) for k, v in want.items()}
    assert recall[0] == recall[15] == 1.0 and recall[25] >= 0.95 and recall[33] >= 0.9, recall
    assert not {d for d, _ in got if d < 1000}


def test_basis_is_that_of_an_exact_svd(spark):
    """Rows of few passages, projected by the randomised basis, are as close to each other as by the exact one."""
    rng = np.random.default_rng(4)
    topics = rng.integers(1, 61, (5, 12))
    docs = [np.concatenate([rng.choice(topics[rng.integers(5)], 40), rng.integers(1, 61, 8)]).astype("<u2") for _ in range(120)]
    coded = spark.createDataFrame([(i, i, d.tobytes()) for i, d in enumerate(docs)], "doc_id long, version long, ids binary")
    idf = np.concatenate([[0.0], rng.uniform(1, 3, 60)])
    a = np.zeros((240, 61))
    for i, d in enumerate(docs):
        np.add.at(a[2 * i], d, idf[d])  # passages start at each step but the last
    a = a[::2]
    basis = latent_basis(coded, idf, "<u2", rank=5)
    _, values, right = np.linalg.svd(a, full_matrices=False)
    exact = idf[:, None] * right[:5].T / values[:5]
    counts = np.stack([np.bincount(d, minlength=61) for d in docs])
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x, y = unit(counts @ basis), unit(counts @ exact)
    assert basis.shape[1] == 5 and np.corrcoef((x @ x.T).ravel(), (y @ y.T).ravel())[0, 1] > 0.97
