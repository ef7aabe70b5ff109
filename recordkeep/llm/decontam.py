"""Benchmark decontamination by latent semantic retrieval, then common-subsequence and answer checks.

Benchmark items come in blocks of bounded size; the words of a block are its vocabulary. Documents are turned once
into sequences of vocabulary ids (0 for any other word, so distances stay) and written; every further pass reads those.

1. Passages are windows of 48 words that overlap by half. Inverse document frequencies are counted over all documents;
   words of more than a twentieth of them do not count, except for items that have hardly any others.
2. A randomised SVD of the TF-IDF passages is computed where the passages are: a random matrix is multiplied by A and
   its transpose in every task, the partial products are summed on the cluster, orthonormalised, and multiplied once
   more; the small Gram matrix of the second product rotates the basis to singular directions. Only matrices of
   (vocabulary x rank), bounded by the benchmark block, reach the driver.
3. All passages are projected and compared with all items of the block in matrix products. Items of more than 48 words
   are cut into the same windows. Passages above a cosine with any window become candidates, whatever their number.
   Items of up to 13 words are lost among the other words of a passage, so they are also looked up by their rarest
   words: more than half of their words, of which every match has one.
4. Around each candidate the longest common subsequence with the item, and the item's answer (what follows an answer
   mark, else its last sentence), decide: three fifths of the item in order, or half of it and the answer as it stands,
   or half of it and, in order, half of an answer that is the smaller part of it, so that a reworded answer still counts.
   Of shorter items other texts hold more by chance: under 25 words the last case needs 0.55 of the item; up to 13 words
   it takes three quarters alone, or half and the answer as it stands.

Found are copies in which up to a third of the words are replaced, the answer's as well (README has the recall by
strength); the common subsequences of unrelated texts stay under 0.4 of an item on the test tables.

Defined cases: null or empty texts match nothing, items without words neither; an empty benchmark gives no rows; rows
with equal id and text are one document, texts of one id are told apart by ``version``; very long texts are encoded
whole and searched in parts that overlap; items that repeat give a row each, passages that tie the best cosine; extra
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordkeep.llm.tables import table
from recordkeep.plans.lineage import cut

STEP = 24  # words; a passage is two steps
SHORT = 13  # words of the longest item that is looked up by its words
RANK, EXTRA = 128, 8
COSINE = 0.4
#: Words in more than this share of the documents do not count in retrieval, unless an item has too few others.
FREQUENT, LEAST_RARE = 0.05, 3
#: Shares of an item's words, in order: enough alone, enough with the answer, and enough of the answer.
ALONE, WITH_ANSWER, OF_ANSWER = 0.6, 0.5, 0.5
#: Enough alone for items of up to SHORT words, and with half of an answer for those of up to STEP words.
SHORT_ALONE, STEP_WITH_ANSWER = 0.75, 0.55
PIECE = 8 << 20  # bytes of text that are split at once
BLOCK_ITEMS = 2000
CHUNK = 40_000  # words that are projected at once
ANSWER = re.compile(r"(?is)\banswer\s*:\s*(.+)$")
OUT = "doc_id long, version long, item_id long, cosine double, common double, answered boolean"


PUNCTUATION = ".,;:!?()\"'|"


def norm(word: str) -> str:
    word = word.lower()
    if word.isalnum():
        return word
    word = word.strip(PUNCTUATION)
    return word if word.isalnum() else "".join(filter(str.isalnum, word))


def words_of(text: str) -> list[str]:
    return [w for w in map(norm, text.split()) if w]


def answer_of(text: str) -> list[str]:
    """The words after an answer mark, else those of the last sentence."""
    if found := ANSWER.search(text):
        return words_of(found[1])
    parts = [w for w in map(words_of, re.split(r"[.!?\n]+", text)) if w]
    return parts[-1] if parts else []


class Items:
    """A block of benchmark items as ids of their own vocabulary (from 1)."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.ids: list[int] = []
        self.items: list[np.ndarray] = []
        self.answers: list[np.ndarray] = []
        for item_id, text in rows:
            if words := words_of(text or ""):
                self.ids.append(item_id)
                self.items.append(self._code(words))
                self.answers.append(self._code(answer_of(text)))

    def _code(self, words: list[str]) -> np.ndarray:
        return np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.uint32)


class Codes(dict):
    """Raw word -> id, filled on demand, of bounded size."""

    def __init__(self, vocabulary: dict[str, int], limit: int = 500_000):
        super().__init__()
        self.vocabulary, self.limit = vocabulary, limit
        self.words = pa.array(list(vocabulary), pa.string())  # in the order of their ids, which start at 1

    def __missing__(self, raw: str) -> int:
        word = norm(raw)
        value = self.vocabulary.get(word, 0) if word else -1
        if len(raw) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[raw] = value
        return value


def pieces(batch: pa.RecordBatch, column: int, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text each, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, end - at)
        at = end


def word_ids(texts: pa.Array, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words of ``texts``, one text behind another, and where each text starts; a word is looked up once."""
    split = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    words = split.flatten().dictionary_encode()
    # ASCII words that are alphanumeric but for punctuation around them need no Python; norm() says the same of them.
    raw = words.dictionary
    bare = pc.ascii_trim(pc.ascii_lower(raw), PUNCTUATION)
    plain = pc.and_(pc.string_is_ascii(raw), pc.ascii_is_alnum(bare)).to_numpy(zero_copy_only=False)
    table = pc.fill_null(pc.index_in(bare, value_set=codes.words), -1).to_numpy().astype(np.int64) + 1
    rest = np.flatnonzero(~plain)
    table[rest] = np.fromiter(map(codes.__getitem__, raw.take(pa.array(rest)).to_pylist()), np.int64, len(rest))
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
    return table[words.indices.to_numpy()] if len(words) else np.empty(0, np.int64), ends


def encoded(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id, version, words, at, ids): places and ids of the block's words, for documents that have any."""
    sent = docs.sparkSession.sparkContext.broadcast(items.vocabulary)  # bounded by BLOCK_ITEMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(sent.value)
        kind = "<u4" if len(codes.vocabulary) > 65535 else "<u2"
        for batch in batches:
            for part in pieces(batch, 2):
                ids, ends = word_ids(part.column(2), codes)
                rows = []
                for i, (at, end) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                    own = ids[at:end]
                    own = own[own >= 0]
                    if own.any():
                        rows.append((i, own.astype(kind).tobytes()))
                kept = pa.array([i for i, _ in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(kept), part.column(1).take(kept), pa.array([x for _, x in rows], pa.binary())], names=["doc_id", "version", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("version"), "text")
    return rows.mapInArrow(run, "doc_id long, version long, ids binary")


def passages(sequences: list[np.ndarray], matrix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For chunks of documents: ids and step of each vocabulary word, sums of ``matrix`` rows per step, document and step number of each step."""
    used = matrix.any(axis=1)
    group: list[tuple[int, int, np.ndarray]] = []
    size = 0
    for d, ids in enumerate(sequences):
        for at in range(0, max(1, len(ids) - STEP), CHUNK // STEP * STEP):  # very long documents come in parts that share a step
            group.append((d, at // STEP, ids[at : at + CHUNK // STEP * STEP + STEP]))
            size += len(group[-1][2])
            if size >= CHUNK:
                yield _steps(group, matrix, used)
                group, size = [], 0
    if group:
        yield _steps(group, matrix, used)


def _steps(group: list, matrix: np.ndarray, used: np.ndarray):
    counts = [max(2, -(-len(ids) // STEP)) for _, _, ids in group]
    firsts = np.cumsum([0, *counts])
    step = np.concatenate([f + np.arange(len(ids)) // STEP for f, (_, _, ids) in zip(firsts, group, strict=False)])
    ids = np.concatenate([ids for _, _, ids in group]).astype(np.int64)
    step, ids = step[used[ids]], ids[used[ids]]
    sums = np.zeros((firsts[-1], matrix.shape[1]), np.float32)
    if len(ids):
        starts = np.flatnonzero(np.diff(step, prepend=-1))
        sums[step[starts]] = np.add.reduceat(matrix[ids], starts, axis=0)
    doc = np.repeat([d for d, _, _ in group], counts)
    number = np.concatenate([first + np.arange(c) for (_, first, _), c in zip(group, counts, strict=True)])
    last = np.zeros(firsts[-1], bool)
    last[firsts[1:] - 1] = True  # the last step of a part starts no passage
    return ids, step, sums, doc, np.where(last, -1, number)


def _sequences(batch: pa.RecordBatch, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), kind) for x in batch.column(batch.schema.names.index("ids"))]


def _summed(parts: DataFrame, width: int) -> np.ndarray:
    """Sum over tasks of (block, salt, cells) rows, in two rounds, so that no task sees the rows of all tasks."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        whole = sum(np.frombuffer(x, "<f8") for x in frame["cells"])
        return pd.DataFrame({"block": frame["block"].iloc[:1], "salt": frame["salt"].iloc[:1], "cells": [whole.tobytes()]})

    for keys in (["block", "salt"], ["block"]):
        parts = parts.groupBy(*keys).applyInPandas(add, "block int, salt int, cells binary")
    found = sorted(parts.collect(), key=lambda r: r["block"])  # (vocabulary x width) cells in all
    return np.concatenate([np.frombuffer(r["cells"], "<f8") for r in found]).reshape(-1, width) if found else np.zeros((0, width))


def _blocks(total: np.ndarray, rows: int = 512) -> pa.RecordBatch:
    context = TaskContext.get()
    salt = context.partitionId() % 64 if context else 0
    cells = [total[at : at + rows].astype("<f8").tobytes() for at in range(0, len(total), rows)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(cells)), pa.int32()), pa.array([salt] * len(cells), pa.int32()), pa.array(cells, pa.binary())], names=["block", "salt", "cells"])


PARTS = "block int, salt int, cells binary"


def document_frequencies(coded: DataFrame, size: int, kind: str) -> np.ndarray:
    """Number of documents that hold each id, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, 1))
        for batch in batches:
            for ids in _sequences(batch, kind):
                total[np.unique(ids)] += 1
        yield _blocks(total)

    return _summed(coded.mapInArrow(run, PARTS), 1)[:, 0]


def gram_product(coded: DataFrame, weighted: np.ndarray, idf: np.ndarray, kind: str) -> np.ndarray:
    """A^T (A M) for all passages A, given idf * M."""
    sent = coded.sparkSession.sparkContext.broadcast((weighted.astype(np.float32), idf))
    size, width = weighted.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, own_idf = sent.value
        total = np.zeros((size, width))
        for batch in batches:
            for ids, step, sums, _, number in passages(_sequences(batch, kind), matrix):
                ok = (number >= 0)[:, None]
                pair = np.where(ok, sums + np.roll(sums, -1, axis=0), 0)  # A M, by passage
                back = pair + np.roll(pair, 1, axis=0)  # a step stands in its own passage and the one before
                order = np.argsort(ids, kind="stable")
                starts = np.flatnonzero(np.diff(ids[order], prepend=-1))
                if len(starts):
                    total[ids[order][starts]] += np.add.reduceat(back[step[order]], starts, axis=0)
        yield _blocks(total * own_idf[:, None])

    return _summed(coded.mapInArrow(run, PARTS), width)


def word_weights(df: np.ndarray, total: int, items: Items) -> np.ndarray:
    """Inverse document frequencies; 0 for words that are too frequent to tell passages apart."""
    counts = (df > 0) & (df <= FREQUENT * total)
    for item in items.items:
        if counts[np.unique(item)].sum() < LEAST_RARE:
            counts = counts.copy()
            counts[item] = True
    counts[0] = False
    return np.where(counts, np.log1p(total / np.maximum(df, 1)), 0.0)


def latent_basis(coded: DataFrame, idf: np.ndarray, kind: str, rank: int = RANK) -> np.ndarray:
    """idf * V / sigma for the leading singular values and right vectors of the passages: randomised SVD, one power step.

    With the division a passage's coordinates are those of its left singular vector, so that directions of rare words
    count as much as those of common ones.
    """
    width = min(rank + EXTRA, len(idf))
    start = np.random.default_rng(11).normal(size=(len(idf), width))
    basis, _ = np.linalg.qr(gram_product(coded, idf[:, None] * start, idf, kind))
    again = gram_product(coded, idf[:, None] * basis, idf, kind)
    values, turn = np.linalg.eigh((basis.T @ again + again.T @ basis) / 2)
    keep = [i for i in np.argsort(-values)[:rank] if values[i] > 1e-6 * max(values.max(), 1e-30)]
    return idf[:, None] * (basis @ turn[:, keep]) / np.sqrt(values[keep])


def bit_masks(item: np.ndarray) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def common_length(size: int, masks: dict[int, int], part: np.ndarray) -> int:
    """Length of the longest common subsequence with an item of ``size`` words, bit-parallel over the item."""
    row = full = (1 << size) - 1
    for w in part.tolist():
        if hit := masks.get(w):
            kept = row & hit
            row = (row + kept | row - kept) & full
    return size - row.bit_count()


def holds(part: np.ndarray, answer: np.ndarray) -> bool:
    n = len(answer)
    if not n or n > len(part):
        return False
    at = np.flatnonzero(part[: len(part) - n + 1] == answer[0])
    return any(np.array_equal(part[i : i + n], answer) for i in at)


def verdict(item: np.ndarray, masks: dict[int, int], answer: np.ndarray, answer_masks: dict[int, int], part: np.ndarray) -> tuple[float, bool] | None:
    """Share of the item in order and whether its answer is there, if both together are enough."""
    share = common_length(len(item), masks, part) / len(item)
    if share < WITH_ANSWER:
        return None
    answered = holds(part, answer)
    if not answered and len(item) > SHORT and 2 * len(answer) <= len(item) and share >= (WITH_ANSWER if len(item) > STEP else STEP_WITH_ANSWER):
        answered = bool(len(answer)) and common_length(len(answer), answer_masks, part) >= OF_ANSWER * len(answer)
    return (share, answered) if answered or share >= (ALONE if len(item) > SHORT else SHORT_ALONE) else None


def windows(item: np.ndarray) -> list[np.ndarray]:
    """An item's passages: windows of two steps that overlap by half, the last one flush with its end."""
    last = max(0, len(item) - 2 * STEP)
    return [item[at : at + 2 * STEP] for at in sorted({*range(0, last, STEP), last})]


def anchors(items: list[np.ndarray], df: np.ndarray) -> dict[int, list[int]]:
    """Word -> short items that are looked up by it."""
    out: dict[int, list[int]] = {}
    for k, item in enumerate(items):
        if len(item) <= SHORT:
            rare = item[np.argsort(df[item], kind="stable")]
            for w in set(rare[: len(item) - math.ceil(WITH_ANSWER * len(item)) + 1].tolist()):
                out.setdefault(w, []).append(k)
    return out


def short_candidates(ids: np.ndarray, items: list[np.ndarray], by_word: dict[int, list[int]], is_anchor: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(item, part of the document) around each place where enough words of a short item stand about one that it is looked up by."""
    at = np.flatnonzero(is_anchor[ids])
    met: dict[int, list[int]] = {}
    for w in np.unique(ids[at]).tolist():
        for k in by_word[w]:
            met.setdefault(k, []).append(w)
    for k, found in met.items():
        item, reach = items[k], 2 * len(items[k])
        places = at[np.isin(ids[at], found)]
        sums = np.concatenate([[0], np.cumsum(np.isin(ids, item))])
        low, high = np.maximum(places - reach, 0), np.minimum(places + reach + 1, len(ids))
        enough = sums[high] - sums[low] >= WITH_ANSWER * len(item)
        for a, b in zip(low[enough].tolist(), high[enough].tolist(), strict=True):
            yield k, ids[a:b]


def search(coded: DataFrame, items: Items, basis: np.ndarray, kind: str, cosine: float, df: np.ndarray) -> DataFrame:
    """Rows of OUT for items that a document holds."""
    sent = coded.sparkSession.sparkContext.broadcast((items.ids, items.items, items.answers, basis.astype(np.float32), anchors(items.items, df)))

    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, own_items, answers, matrix, by_word = sent.value
        masks, answer_masks = [bit_masks(i) for i in own_items], [bit_masks(a) for a in answers]
        cuts = [windows(i) for i in own_items]
        firsts = np.cumsum([0, *map(len, cuts)])[:-1]
        wanted = unit(np.stack([matrix[w].sum(axis=0) for cut in cuts for w in cut])).T
        is_anchor = np.zeros(len(matrix), bool)
        is_anchor[list(by_word)] = True

        def judge(k: int, part: np.ndarray) -> tuple[float, bool] | None:
            return verdict(own_items[k], masks[k], answers[k], answer_masks[k], part)

        for batch in batches:
            sequences = _sequences(batch, kind)
            best: dict[tuple[int, int], tuple] = {}
            for _, _, sums, doc, number in passages(sequences, matrix):
                pair = unit(sums + np.roll(sums, -1, axis=0))
                for at in range(0, len(pair), 8192):
                    near = pair[at : at + 8192] @ wanted
                    if near.shape[1] > len(own_items):
                        near = np.maximum.reduceat(near, firsts, axis=1)
                    near[number[at : at + 8192] < 0] = -1
                    for p, k in zip(*np.nonzero(near >= cosine), strict=True):
                        d, first = int(doc[at + p]), int(number[at + p]) * STEP
                        item = own_items[k]
                        around = sequences[d][max(0, first - len(item)) : first + 2 * STEP + len(item)]
                        if found := judge(k, around):
                            now = (*found, float(near[p, k]))
                            best[d, int(k)] = max(best.get((d, int(k)), now), now)
            for d, ids in enumerate(sequences if by_word else []):
                for k, part in short_candidates(ids, own_items, by_word, is_anchor):
                    if found := judge(k, part):
                        now = (*found, float((unit(matrix[part].sum(axis=0)[None]) @ wanted[:, firsts[k]])[0]))
                        best[d, k] = max(best.get((d, k), now), now)
            rows = [(batch.column(0)[d].as_py(), batch.column(1)[d].as_py(), own_ids[k], c, s, a) for (d, k), (s, a, c) in best.items()]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["doc_id", "version", "item_id", "cosine", "common", "answered"])

    return coded.mapInArrow(run, OUT)


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``docs`` (doc_id, text) x ``benchmark`` (item_id, text) -> doc_id, version, item_id, cosine, common, answered."""
    found = docs.sparkSession.createDataFrame([], OUT)
    total = docs.count()
    after, block = None, benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    while rows := (block if after is None else block.where((F.col("item_id") > after[0]) | (F.col("item_id") == after[0]) & (F.col("text") > after[1]))).orderBy("item_id", "text").limit(block_items).collect():
        after = rows[-1]
        items = Items([tuple(r) for r in rows])
        if not items.ids:
            continue
        kind = "<u4" if len(items.vocabulary) > 65535 else "<u2"
        coded = cut(encoded(docs, items), "decontam-ids")
        df = document_frequencies(coded, len(items.vocabulary) + 1, kind)
        if not len(df):
            continue
        idf = word_weights(df, total, items)
        found = found.unionByName(search(coded, items, latent_basis(coded, idf, kind), kind, cosine, df))
    return found.distinct()


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document and benchmark item that it holds: doc_id, item_id, cosine, common, answered."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("version")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    hit = cut(contaminated(docs, benchmark).select(F.col("doc_id").alias("_hit"), F.col("version").alias("_version")).distinct(), "contaminated")
    own = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(hit, docs["doc_id"].cast("long").eqNullSafe(hit["_hit"]) & (own == hit["_version"]), "left_anti")
