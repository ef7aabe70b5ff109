import random
import zlib

from recordkeep.llm.toxicity import Model, fit, fit_model, sentences, toxicity


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(300)]
    bad = ["vile", "rotten", "foul"]
    rows = []
    for i in range(n):
        y = i % 5 == 0
        text = [[rng.choice(words) for _ in range(rng.randrange(3, 9))] for _ in range(rng.randrange(1, 40))]
        if y:
            for _ in range(2):
                rng.choice(text).insert(0, rng.choice(bad))
        rows.append((i, ". ".join(" ".join(s) for s in text), int(y)))
    return rows


def test_held_out_accuracy_and_places():
    model = fit((t, y) for _, t, y in corpus(600, 1))
    right = 0
    for _, text, y in corpus(300, 2):
        score, where = model.score(text)
        right += (score >= 0.7) == bool(y)
        for w in where:
            assert any(b in text[w["start"] : w["end"]] for b in ("vile", "rotten", "foul"))
        assert 0 <= score <= 1 and bool(where) >= (score >= 0.99)
    assert right >= 297


def test_noisy_or():
    model = Model({"a": 2.0, "b": 1.0}, -3.0)
    import math

    p = [1 / (1 + math.exp(-z)) for z in (-1.0, -3.0, 0.0)]
    assert abs(model.score("A a.\nzz! b a")[0] - (1 - (1 - p[0]) * (1 - p[1]) * (1 - p[2]))) < 1e-12
    assert [s[:2] for s in sentences("ab. .c\n")] == [(0, 2), (5, 6)]


def test_documents(spark):
    rows = corpus(200, 3)
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(900, None, "s"), (901, "", "s"), (None, "vile", "s"), (0, rows[0][1], "s")], "doc_id long, text string, score string")
    # labels of held-out rows are wrong on purpose: they must not be learned from
    labels = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in rows] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = fit_model(docs, labels)
    got = {r.doc_id: r.score for r in toxicity(docs, model).collect()}
    assert got[900] == got[901] == 0.0
    wrong = [i for i, _, y in rows if (got[i] >= 0.7) != bool(y)]
    assert len(wrong) <= 6
    empty = fit_model(docs.limit(0), labels)
    assert toxicity(docs, empty).where("score <> 0").count() == 0 and toxicity(docs.limit(0), model).count() == 0


def test_long_clean_documents_stay_clean(spark):
    rng = random.Random(8)
    clean = lambda n: ". ".join(" ".join(f"word{rng.randrange(300)}" for _ in range(6)) for _ in range(n))
    rows = corpus(600, 4)
    rows = [(i, clean(5), y) if i % 50 == 0 else (i, t, y) for i, t, y in rows]  # toxic ones without a sign
    model = fit((t, y) for _, t, y in rows)
    long = clean(22_000)
    assert len(long) > 1_000_000 and model.score(long)[0] < 0.1 and model.score(long + ". vile foul rotten")[0] >= 0.7
    free = [i for i in range(20) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = spark.createDataFrame([(free[0], "bad vile"), (free[1], long), (free[2], "x")], "doc_id long, text string")
    seen = []
    import recordkeep.llm.toxicity as module

    own, module.fit = module.fit, lambda pairs: seen.extend(len(t) for t, _ in pairs)
    try:
        fit_model(docs, spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int"))
    finally:
        module.fit = own
    assert len(long) in seen
