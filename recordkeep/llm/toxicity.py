"""Toxicity by multiple-instance learning: only documents carry labels, sentences are scored.

A sentence's score is the logistic of a bias and the weights of its distinct words and word beginnings. A document's
score is the noisy-or of its sentences, 1 - prod(1 - p): one bad sentence is enough, however long the rest. Fitted
models score relative to sentences without evidence, so that those add nothing, however many they are. Weights
are trained through the noisy-or from document labels (gradient steps on a bounded sample of labelled documents) and
start at features that toxic documents hold much more often than others. Because sentences are scored, the sentences
that make a document toxic come out with it.

Defined cases: a very long text is scored whole, sentence by sentence, but only its first 4,000,000 characters may take
part in the fit, which holds 40,000,000 characters at most; sentences that tie all come out; extra columns, whatever
their names, are ignored; null or empty text has no sentence and gets the score of the empty noisy-or, 0; without labelled rows
of both kinds every score is 0; rows repeat as they come; labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordkeep.llm.sampling import lowest
from recordkeep.llm.tables import table
from recordkeep.plans.lineage import cut

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
#: Lengths of word beginnings that are features besides whole words.
PREFIXES = (4, 5, 7)
#: Labelled documents that the model is fitted on, at most.
FIT_ROWS = 6000
#: Characters that the model is fitted on, at most, and those of one text; all texts are scored whole.
FIT_CHARS, LONGEST = 40_000_000, 4_000_000
CUTOFF = 0.7


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def sentences(text: str | None) -> Iterator[tuple[int, int, set[str]]]:
    """(start, end, distinct words) of each sentence that has words."""
    for found in SENTENCE.finditer((text or "").lower()):
        if words := set(WORD.findall(found[0])):
            yield found.start(), found.end(), words


class Model:
    """Weights of features and the bias; ``word`` holds what whole words sum up to, filled on demand.

    If ``relative``, sentences without evidence add nothing to a document's score.
    """

    def __init__(self, weights: dict[str, float], bias: float, relative: bool = False):
        self.weights, self.bias, self.relative, self.word = weights, bias, relative, {}

    def of(self, word: str) -> float:
        found = self.word.get(word)
        if found is None:
            found = sum(self.weights.get(f, 0.0) for f in features(word))
            if len(self.word) >= 500_000:
                self.word.clear()
            if len(word) <= 64:
                self.word[word] = found
        return found

    def score(self, text: str | None, blame: float = 0.5) -> tuple[float, list[dict]]:
        """Score of the document, and its sentences of at least ``blame`` with their places in the text."""
        if not self.weights:
            return 0.0, []
        spans, logits = [], []
        for start, end, words in sentences(text):
            logits.append(self.bias + sum(map(self.of, words)))
            spans.append((start, end))
        z = np.asarray(logits, float)
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        floor = np.logaddexp(0, self.bias) if self.relative else 0.0
        score = float(-np.expm1(-(np.logaddexp(0, z) - floor).sum()))
        return score, [{"start": spans[i][0], "end": spans[i][1], "score": float(p[i])} for i in np.flatnonzero(p >= blame)]


def fit(rows: Iterable[tuple[str, int]], steps: int = 400, rate: float = 0.1, l2: float = 2e-5) -> Model:
    """Fit on (text, label)."""
    bags = [([words for _, _, words in sentences(text)], int(label)) for text, label in rows]
    n_bad = sum(y for _, y in bags)
    if not bags or n_bad in (0, len(bags)):
        return Model({}, 0.0)
    bad, good = Counter(), Counter()
    for bag, y in bags:
        (bad if y else good).update({f for words in bag for w in words for f in features(w)})
    prior = n_bad / (len(bags) - n_bad)
    odds = {f: (n + 0.5) / ((good[f] + 0.5) * prior) for f, n in bad.items() if n >= 3}
    names = sorted(f for f, o in odds.items() if o >= 4)
    index = {f: i for i, f in enumerate(names)}
    cols, at, doc, label = [], [], [], []
    for k, (bag, y) in enumerate(bags):
        for words in bag:
            cols.append(np.fromiter({index[f] for w in words for f in features(w) if f in index}, np.int64))
            doc.append(k)
        label.append(y)
    at = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
    col, doc, label = np.concatenate([*cols, np.empty(0, np.int64)]), np.asarray(doc, np.int64), np.asarray(label, float)
    w = np.log([odds[f] for f in names]) / 2
    theta = np.concatenate([w, [-6.0]])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        z = theta[-1] + np.bincount(at, theta[col], len(cols))
        total = np.bincount(doc, np.logaddexp(0, z), len(label))
        outer = np.where(label > 0, -1 / np.expm1(np.maximum(total, 1e-6)), 1.0) / len(label)
        slope = outer[doc] / (1 + np.exp(-np.clip(z, -500, 500)))
        gradient = np.concatenate([np.bincount(col, slope[at], len(names)) + l2 * theta[:-1], [slope.sum()]])
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        theta = theta - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        theta[:-1] = np.maximum(theta[:-1], 0)  # evidence for toxicity only: no sentence can excuse another
    return Model({f: float(x) for f, x in zip(names, theta, strict=False) if x > 0}, float(theta[-1]), relative=True)


def toxicity(docs: DataFrame, model: Model, blame: float = 0.5) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, score, offending (start, end, score of sentences)."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.relative))  # bounded by the fit sample
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in batches:
            found = [own.score(text.as_py(), blame) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([b for _, b in found], kind)], names=["doc_id", "score", "offending"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, score double, offending array<struct<start:int,end:int,score:double>>")


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def fit_model(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents that are not held out, and FIT_CHARS characters of them."""
    labelled = labels.where(F.col("toxic").isin(0, 1)).select("doc_id", "toxic").where(~held_out(F.col("doc_id"))).distinct()
    sample = cut(lowest(labelled, "doc_id", rows), "toxicity-labels")  # at most 2 x ``rows`` pairs, so texts need not move to them
    chosen = docs.select("doc_id", F.substring("text", 1, LONGEST).alias("text")).join(F.broadcast(sample), "doc_id").where("text is not null")
    found = cut(chosen.select("*", F.length("text").alias("size"), F.xxhash64("doc_id").alias("o"), F.xxhash64("text", "toxic").alias("h")).dropDuplicates(["o", "h"]), "toxicity-fit")
    total, last = 0, None
    for at, text, size in found.select("o", "h", "size").orderBy("o", "h").limit(2 * rows).collect():  # narrow rows
        if total + size > FIT_CHARS:
            break
        total, last = total + size, (at, text)
    kept = found.where((F.col("o") < last[0]) | (F.col("o") == last[0]) & (F.col("h") <= last[1])).collect() if last is not None else []
    return fit((r["text"], r["toxic"]) for r in sorted(kept, key=lambda r: (r["doc_id"], r["text"], r["toxic"])))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, n_offending."""
    docs = table(spark, sf_dir, "documents")
    found = toxicity(docs, fit_model(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))
