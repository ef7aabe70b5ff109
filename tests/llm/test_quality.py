import math
import random
import zlib

import numpy as np
import zstandard

from recordkeep.llm import quality as Q


def prose(rng, n):
    return " ".join("".join(rng.choice(("ta", "re", "mi", "so", "lu", "ne")) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y, text = int(i % 4 != 0), prose(rng, rng.randrange(20, 400))
        if not y:
            words = text.split()
            at = rng.randrange(len(words) // 2)
            text = " ".join(w + rng.choice(("###", "&&&", "%%%")) if k >= at else w for k, w in enumerate(words))
        rows.append((i, text, y))
    return rows


def test_pieces_hold_the_whole_text():
    for n in (0, 1, 999, 1000, 1001, 1499, 1500, 2499, 2500, 10_321):
        text = ("äbcdé " * n)[:n]
        got = Q.pieces(text)
        assert b"".join(got) == text.encode() and all(len(p) < 1.5 * Q.PIECE for p in got)
    assert Q.pieces(None) == Q.pieces("") == []


def test_evidence_against_plain_compression():
    model = Q.fit([(t, y) for _, t, y in corpus(200, 1)])
    text = corpus(3, 9)[1][1] * 3
    size = lambda d, p: len(zstandard.ZstdCompressor(level=Q.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(p))
    bad, good = ([size(d, p) for p in Q.pieces(text)] for d in (model.bad, model.good))
    own = [len(p) for p in Q.pieces(text)]
    want = [(sum(bad) - sum(good)) / (sum(bad) + sum(good)), min((b - g) / (b + g) for b, g in zip(bad, good)), math.log(sum((b + g) / 2 / n for b, g, n in zip(bad, good, own)) / len(own))]
    assert np.allclose(model.evidence(text), want)
    z = model.weights[0] + sum(w * x for w, x in zip(model.weights[1:], want))
    assert abs(model.score(text)[0] - 1 / (1 + math.exp(-z))) < 1e-9


def test_held_out_accuracy_and_calibration():
    model = Q.fit([(t, y) for _, t, y in corpus(800, 1)])
    scored = [(model.score(t)[0], y) for _, t, y in corpus(400, 2)]
    assert sum((s >= 0.5) == bool(y) for s, y in scored) >= 388
    assert np.mean([(s - y) ** 2 for s, y in scored]) < 0.03
    assert abs(np.mean([s for s, _ in scored]) - 0.75) < 0.05


def test_calibration_finds_the_maximum():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 3)) * [1, 0.1, 5]
    truth = np.array([0.4, 1.5, -8.0, 0.1])
    y = rng.random(4000) < 1 / (1 + np.exp(-(truth[0] + x @ truth[1:])))
    assert np.allclose(Q.calibrate(x, y.astype(float)), truth, rtol=0.25, atol=0.12)
    assert all(np.isfinite(Q.calibrate(np.zeros((6, 3)), np.array([0, 0, 0, 1, 1, 1.0]))))


def test_documents(spark):
    rows = corpus(300, 3)
    long = prose(random.Random(5), 60_000)
    extra = [(900, None, "s"), (901, "", "s"), (None, "ta re", "s"), (0, rows[0][1], "s"), (902, long, "s"), (903, long + " " + " ".join(w + "###" for w in long.split()), "s")]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + extra, "doc_id long, text string, score string")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    # labels of held-out rows are wrong on purpose: they must not be learned from
    labels = spark.createDataFrame([(i, 1 - y if held(i) else y) for i, _, y in rows] + [(None, 1), (7, None)], "doc_id long, quality int")
    model = Q.fit_model(docs, labels)
    out = Q.quality(docs, model).collect()
    assert len(out) == len(rows) + len(extra)
    got = {r.doc_id: r.score for r in out}
    assert got[900] == got[901] and all(0 <= s <= 1 for s in got.values())
    assert got[902] >= 0.5 > got[903]
    assert sum((got[i] >= 0.5) != bool(y) for i, _, y in rows if held(i)) <= 6
    moved = Q.fit_model(docs.orderBy("text"), labels.orderBy("quality"))
    assert (moved.bad, moved.good, moved.weights) == (model.bad, model.good, model.weights)
    none = Q.fit_model(docs.limit(0), labels)
    assert {r.score for r in Q.quality(docs, none).collect()} == {0.5} and Q.quality(docs.limit(0), model).count() == 0


def test_few_samples_and_characters(spark, monkeypatch):
    assert Q.fit([("good text here", 1), ("bad", 0)]).weights == ()
    small = Q.fit([("good text here", 1), ("fine words", 1), ("bad ### bad", 0), ("worse ###", 0)])  # too few to train on: their own bytes
    assert len(small.weights) == 4 and 0 <= small.score("some good text")[0] <= 1
    free = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = spark.createDataFrame([(i, "x" * 100) for i in free], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(Q, "FIT_CHARS", 1000)
    monkeypatch.setattr(Q, "fit", lambda pairs: seen.extend(len(t) for t, _ in pairs))
    Q.fit_model(docs, spark.createDataFrame([(i, 0) for i in range(60)], "doc_id long, quality int"))
    assert sum(seen) == 1000
