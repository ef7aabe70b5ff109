"""Quality by compression: text that a dictionary of good text compresses better than one of bad text is good.

Two zstandard dictionaries are trained, one on labelled good and one on labelled bad text. A text is cut into pieces of
about PIECE bytes, so that a dictionary matters to all of it, and every piece is compressed with both. Its evidence is
the difference of the two sizes, each normalised by their sum: over the whole text, and of the piece that looks worst.
A logistic calibration, fitted on labelled texts that no dictionary has seen, turns this and the logarithm of the
compressed share of the text (repetition compresses with any dictionary) into a score between 0 and 1.

The model is bounded: FIT_ROWS labelled texts of FIT_CHARS characters in all, two dictionaries of DICT_BYTES. Scoring
is one pass over the texts without a shuffle.

Defined cases: null or empty text has no piece and gets the calibrated score of no difference and no compression; a
very long text is scored whole, piece by piece, but only texts of up to LONGEST characters take part in the fit;
without labelled rows of both kinds every score is 0.5; an id with both labels counts once for each; rows repeat as
they come; extra columns, whatever their names, are ignored; labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordkeep.llm.sampling import lowest
from recordkeep.llm.tables import table
from recordkeep.plans.lineage import cut

#: Bytes of a piece; what is left at the end joins the piece before it if it is under half of that.
PIECE = 1000
DICT_BYTES, LEVEL = 112_000, 3
#: Labelled texts that the model is fitted on, at most, the characters of them in all, and of one text.
FIT_ROWS, FIT_CHARS, LONGEST = 6000, 30_000_000, 200_000
#: Bytes that one dictionary is trained on, at most.
DICT_SAMPLE = 8_000_000
CUTOFF = 0.5


def pieces(text: str | None) -> list[bytes]:
    """The UTF-8 bytes of a text in pieces; none of an empty text."""
    whole = (text or "").encode("utf-8", "replace")
    ends = list(range(PIECE, len(whole), PIECE))
    if ends and len(whole) - ends[-1] < PIECE // 2:
        ends.pop()
    return [whole[a:b] for a, b in zip([0, *ends], [*ends, len(whole)], strict=True)] if whole else []


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; of samples too few or too small to train on, their own bytes."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:]


class Model:
    """Dictionaries of bad and good text, and the calibration (bias and three weights)."""

    def __init__(self, bad: bytes, good: bytes, weights: tuple[float, ...] = ()):
        self.bad, self.good, self.weights = bad, good, tuple(weights)
        self._by = [self._compressor(d) for d in (bad, good)] if bad and good else []

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        kind = zstandard.DICT_TYPE_AUTO if content[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT  # the magic number of a trained one
        known = zstandard.ZstdCompressionDict(content, dict_type=kind)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)

    def evidence(self, text: str | None) -> tuple[float, float, float]:
        """Normalised difference of the whole text and of its worst piece, and the log of the compressed share."""
        cut_up = pieces(text)
        if not cut_up:
            return 0.0, 0.0, 0.0
        bad, good = (np.array([len(c.compress(p)) for p in cut_up], float) for c in self._by)
        size = np.array([len(p) for p in cut_up], float)
        return float((bad.sum() - good.sum()) / (bad.sum() + good.sum())), float(((bad - good) / (bad + good)).min()), float(np.log(((bad + good) / 2 / size).mean()))

    def score(self, text: str | None) -> tuple[float, float]:
        """(score, normalised difference of the whole text)."""
        if not self.weights:
            return 0.5, 0.0
        found = self.evidence(text)
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], found, strict=True))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500)))), found[0]


def calibrate(evidence: np.ndarray, labels: np.ndarray, ridge: float = 1e-2, steps: int = 100) -> tuple[float, ...]:
    """Bias and weights of a logistic regression by Newton steps, with a small ridge on scaled columns."""
    mean, scale = evidence.mean(0), evidence.std(0) + 1e-9
    x = np.c_[np.ones(len(evidence)), (evidence - mean) / scale]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (p - labels) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    own = w[1:] / scale
    return (float(w[0] - own @ mean), *map(float, own))


def fit(rows: Iterable[tuple[str, int]]) -> Model:
    """Fit on (text, label): dictionaries on one half of the texts of each label, calibration on the other."""
    order = sorted({(zlib.crc32(t.encode("utf-8", "replace")), t, int(y)) for t, y in rows if t})
    kinds = [[t for _, t, y in order if y == label] for label in (0, 1)]
    if min(map(len, kinds)) < 2:
        return Model(b"", b"")
    seen = [[p for t in texts[::2] for p in pieces(t)] for texts in kinds]
    room = min(DICT_SAMPLE, *(sum(map(len, s)) for s in seen))  # equal shares, so that neither dictionary knows more
    samples = []
    for own in seen:
        own.sort(key=zlib.crc32)
        total = np.cumsum([len(p) for p in own])
        samples.append(own[: int(np.searchsorted(total, room)) + 1])
    bare = Model(*map(dictionary, samples))
    rest = [(bare.evidence(t), y) for y, texts in enumerate(kinds) for t in texts[1::2]]
    return Model(bare.bad, bare.good, calibrate(np.array([e for e, _ in rest]), np.array([y for _, y in rest], float)))


def quality(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, score, difference."""
    sent = docs.sparkSession.sparkContext.broadcast((model.bad, model.good, model.weights))  # two dictionaries of DICT_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in batches:
            found = [own.score(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[i] for f in found], pa.float64()) for i in (0, 1))], names=["doc_id", "score", "difference"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, score double, difference double")


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def fit_model(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents that are not held out, and FIT_CHARS characters of them."""
    labelled = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality")).where(~held_out(F.col("doc_id"))).distinct()
    sample = cut(lowest(labelled, "doc_id", rows), "quality-labels")  # at most 2 x ``rows`` pairs, so texts need not move to them
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").where(F.length("text").between(1, LONGEST))
    found = cut(chosen.select("quality", "text", F.length("text").alias("size"), F.xxhash64("doc_id").alias("o"), F.xxhash64("text", "quality").alias("h")).dropDuplicates(["o", "h"]), "quality-fit")
    total, last = 0, None
    for at, text, size in found.select("o", "h", "size").orderBy("o", "h").limit(2 * rows).collect():  # narrow rows
        if total + size > FIT_CHARS:
            break
        total, last = total + size, (at, text)
    kept = found.where((F.col("o") < last[0]) | (F.col("o") == last[0]) & (F.col("h") <= last[1])).select("text", "quality").collect() if last is not None else []
    return fit((r["text"], r["quality"]) for r in kept)


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, difference."""
    docs = table(spark, sf_dir, "documents")
    found = quality(docs, fit_model(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"), "difference")
