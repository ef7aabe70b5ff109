"""Suffix-array dedup by prefix-free parsing: bytes under a 200-byte string that also starts elsewhere are removed.

Texts are cut into phrases at *triggers*, chosen by a rolling hash alone, so equal strings are cut alike. A trigger is the
smallest hash of an 8-byte window among WIDTH neighbouring ones rather than one that is zero modulo a number: phrases are
then never long, and each string has a trigger among its first WIDTH places. The string consists of a *left* part before
it, the end of a phrase, and of a *right* part from it on. All strings of a trigger together are its context.

1. *Parse.* Every trigger gives a hash of the first bytes behind it and a 128-bit hash of its whole context. A partial
   aggregation leaves triggers whose beginnings occur twice, which almost none of unique text does. Of triggers that
   follow each other at one distance with equal contexts, as in a run of one byte, a single row is kept with their number.
2. *Dictionary.* Equal contexts are one entry. All strings of an entry that occurs twice are repeated; so far no bytes
   have moved. Entries stay on if others begin alike, one place of each, with the context's bytes.
3. *Suffix order of the dictionary.* Entries that begin alike are sorted by their phrases, read backwards from the
   trigger. Neighbours show how much of a left part any other entry shares.
4. *Suffix order of the parse.* Entries are sorted by what follows the trigger. Neighbours show how much of a right part
   is shared.
5. *Corpus order.* Both bounds leave the few strings whose left part and right part may be shared together, mostly
   where repeated passages begin. These are brought into one order with their bytes; equal neighbours are repeated.

Both orders are sorts over range partitions, whose tasks compare each row with its neighbours as they stream by; at the
rim of a partition the bound is left open, so no result depends on where partitions end.

Strings are judged on the input; the starts found are gathered per document and the text is cut once.

Defined cases: null is empty; texts under 200 bytes lose nothing; very long texts are parsed in parts that overlap, and
runs of one byte, however long, take a row a part; rows that repeat are separate documents, so each loses what the other
holds; a null doc_id is an id like any other; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordkeep.llm.tables import hash128, table
from recordkeep.plans.lineage import cut, discard

SIZE = 200
GRAM = 8
WIDTH = 160  # places that a trigger is the smallest of; one of about 80 is one
LEAST = SIZE - WIDTH + 1  # bytes from the trigger on that every string of it has
SPAN = 1 << 21  # bytes that are parsed at once
PER_TASK = 50_000  # dictionary entries that one task sorts

_random = np.random.default_rng(20)
_SALTS = _random.integers(1, 1 << 63, 2, np.uint64)
_BASES = [int(_random.integers(1 << 60, 1 << 63)) | 1 for _ in range(2)]
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of both bases modulo 2^64 and their inverses, made once for a worker."""
    if not _powers or len(_powers[0][0]) < n:
        size = max(n, SPAN + 4 * SIZE)
        _powers.clear()
        for base in _BASES:
            both = []
            for b in (base, pow(base, -1, 1 << 64)):
                row = np.full(size, b, np.uint64)
                row[0] = 1
                both.append(np.multiply.accumulate(row))
            _powers.append((both[0], both[1]))
    return _powers


def grams(buffer: np.ndarray) -> np.ndarray:
    """The GRAM bytes at each place as a number."""
    n = len(buffer)
    out = np.empty(n - GRAM + 1, np.uint64)
    for k in range(GRAM):
        out[k::GRAM] = buffer[k : k + (n - k) // GRAM * GRAM].view("<u8")
    return out


class Windows:
    """Rolling hashes of a buffer: of any window of GRAM bytes or more, from sums over its beginnings.

    The terms are mixed grams, not bytes: sums of bytes times powers modulo 2^64 nearly cancel for texts like those of
    Thue and Morse, of grams they do not.
    """

    def __init__(self, buffer: np.ndarray, words: int = 2):
        own = grams(buffer)
        n = len(own)
        self.parts = []
        for salt, (power, inverse) in list(zip(_SALTS, _power_tables(len(buffer)), strict=True))[:words]:
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_mixed(own ^ salt) * power[:n], out=sums[1:])
            self.parts.append((sums, inverse))

    def hash(self, at: np.ndarray, end: np.ndarray, word: int, salt: np.ndarray | int = 0) -> np.ndarray:
        sums, inverse = self.parts[word]
        return _mixed((sums[end - GRAM + 1] - sums[at]) * inverse[at] + (end - at).astype(np.uint64) + np.asarray(salt).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def triggers(buffer: np.ndarray) -> np.ndarray:
    """For each place of ``buffer`` the trigger of a string that starts there: the smallest window hash, of equal ones the first."""
    own = grams(buffer)
    low = (_mixed(own) & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(own), dtype=np.uint64)
    have = 1
    while have * 2 <= WIDTH:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < WIDTH:
        low = np.minimum(low[: have - WIDTH], low[WIDTH - have :])
    return (low & np.uint64(0xFFFFFF)).astype(np.int64)


#: Columns of a parse: text number, place of the trigger, left (bytes of its longest left part), right (bytes behind it),
#: least (bytes of its shortest left part), more (repetitions behind it), key, c1, c2 (context).
FIELDS = ("number", "pos", "left", "right", "least", "more", "key", "c1", "c2")


def parsed(texts: list[bytes]) -> Iterator[dict[str, np.ndarray]]:
    """Rows of FIELDS for all texts; together they hold each start of a SIZE-byte string once."""
    group: list[tuple[int, int, int, bytes]] = []
    held = 0
    for number, text in enumerate(texts):
        last = len(text) - SIZE
        for at in range(0, last + 1, SPAN):
            own = min(SPAN, last + 1 - at)
            part = text[at : at + own + 2 * SIZE]
            group.append((number, at, own, part))
            held += len(part)
            if held >= SPAN:
                yield _parsed(group)
                group, held = [], 0
    if group:
        yield _parsed(group)


def _parsed(group: list[tuple[int, int, int, bytes]]) -> dict[str, np.ndarray]:
    buffer = np.frombuffer(b"".join(g[3] for g in group), np.uint8)
    windows, at = Windows(buffer), triggers(buffer)
    ends = np.cumsum([len(g[3]) for g in group])
    begins = ends - np.array([len(g[3]) for g in group])
    own = begins + np.array([g[2] for g in group])  # starts before this belong to the part
    number, shift = np.array([g[0] for g in group]), np.array([g[1] for g in group]) - begins
    valid = np.zeros(len(at) + 1, np.int8)
    valid[begins], valid[own] = 1, valid[own] - 1
    valid = np.cumsum(valid[:-1]) > 0
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    new[begins] = True
    low = np.flatnonzero(new & valid)
    o = np.searchsorted(begins, low, side="right") - 1
    high = np.minimum(np.append(low[1:], len(at)), own[o]) - 1
    t = at[low]
    left, least = t - low, t - high
    right = np.minimum(SIZE - least, ends[o] - t)
    shape = (left << 16) | (right << 8) | least
    context = [windows.hash(low, t + right, w, shape) for w in (0, 1)]
    same = np.zeros(len(t), bool)
    same[1:] = (context[0][1:] == context[0][:-1]) & (context[1][1:] == context[1][:-1]) & (o[1:] == o[:-1]) & (np.diff(t) == left[1:] + 1) & (least[1:] == 0)
    rows = {"number": number[o], "pos": t + shift[o], "left": left, "right": right, "least": least, "key": windows.hash(t, t + LEAST, 0, 1), "c1": context[0], "c2": context[1]}
    return _without_runs(rows, same)


def _without_runs(rows: dict[str, np.ndarray], same: np.ndarray) -> dict[str, np.ndarray]:
    """The first row of each run of rows that are the ``same`` as the one before, and how many follow it."""
    heads = np.flatnonzero(~same)
    return {f: x[heads] for f, x in rows.items()} | {"more": np.diff(np.append(heads, len(same))) - 1}


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents are told apart by (doc_id, v), v being a hash of the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("v"), text.alias("text"))


PARSED = "doc_id long, v long, shape long, pos int, more int, key long, c1 long, c2 long"


def parse(docs: DataFrame, key_only: bool = False) -> DataFrame:
    """(doc_id, v, shape, pos, more, key, c1, c2); with ``key_only`` (key, n) alone. ``shape`` packs left, right and least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                texts = [t.encode() for t in part.column(2).to_pylist()]
                for rows in parsed(texts):
                    key = pa.array(rows["key"].view(np.int64))
                    if key_only:
                        yield pa.RecordBatch.from_arrays([key, pa.array(rows["more"] + 1)], names=["key", "n"])
                        continue
                    number = pa.array(rows["number"])
                    shape = (rows["left"] << 16) | (rows["right"] << 8) | rows["least"]
                    cells = [pa.array(shape), pa.array(rows["pos"].astype(np.int32)), pa.array(rows["more"].astype(np.int32)), key, pa.array(rows["c1"].view(np.int64)), pa.array(rows["c2"].view(np.int64))]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(number), part.column(1).take(number), *cells], names=[c.split()[0] for c in PARSED.split(", ")])

    return _keyed(docs).mapInArrow(run, "key long, n long" if key_only else PARSED)


def _part(name: str):
    """A field of ``shape``."""
    at, bits = {"left": (16, 8), "right": (8, 8), "least": (0, 8)}[name]
    return F.shiftright("shape", at).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


ENTRIES = "c1 long, c2 long, key long, alone boolean, doc_id long, v long, pos int, left int, least int, back binary, ahead binary"


def entries(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of dictionary entries: ``back``, the phrase backwards from the trigger, and ``ahead``, what follows it."""
    cells = ["c1", "c2", "key", "alone", "pos", "shape"]
    lists = wanted.groupBy(F.col("doc_id").alias("w_id"), F.col("v").alias("w_v")).agg(F.collect_list(F.struct(*cells)).alias("wanted"))
    joined = _keyed(docs).join(lists, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("v") == F.col("w_v"))).select("doc_id", "v", "text", "wanted")
    names = [c.split()[0] for c in ENTRIES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, lists = batch.column(2)[i].as_py().encode(), batch.column(3)[i].values
                if not len(lists):
                    continue
                get = {c: lists.field(c).to_numpy(zero_copy_only=False) for c in ("pos", "shape")}
                pos, left, right, least = get["pos"].tolist(), get["shape"] >> 16 & 255, (get["shape"] >> 8 & 255).tolist(), get["shape"] & 255
                back = [text[p - x : p][::-1] for p, x in zip(pos, left.tolist(), strict=True)]
                ahead = [text[p : p + x] for p, x in zip(pos, right, strict=True)]
                n = len(pos)
                same = lambda c: batch.column(c).slice(i, 1).take(pa.array(np.zeros(n, np.int64)))  # noqa: B023, E731
                values = {**{c: lists.field(c) for c in ("c1", "c2", "key", "alone", "pos")}, "doc_id": same(0), "v": same(1), "left": pa.array(left.astype(np.int32)), "least": pa.array(least.astype(np.int32)), "back": pa.array(back, pa.binary()), "ahead": pa.array(ahead, pa.binary())}
                yield pa.RecordBatch.from_arrays([values[c] for c in names], names=names)

    return joined.mapInArrow(run, ENTRIES)


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Binary values as rows of SIZE bytes, and their lengths."""
    values = column.to_pylist()
    sizes = np.array([len(x) for x in values], np.int64)
    return np.frombuffer(b"".join(x.ljust(SIZE, b"\0") for x in values), np.uint8).reshape(-1, SIZE), sizes


def shared(column: pa.Array) -> np.ndarray:
    """For each pair of neighbours the number of leading bytes that they share."""
    cells, sizes = _matrix(column)
    differ = cells[1:] != cells[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), SIZE)
    return np.minimum(common, np.minimum(sizes[1:], sizes[:-1]))


def with_neighbours(rows: DataFrame, order: list[str], column: str, name: str, within: str | None = None) -> DataFrame:
    """``rows`` with ``name``: how many leading bytes of ``column`` a row shares with a neighbour in ``order``, at most.

    Neighbours count only if they agree in ``within``. The first and last row of a range partition get SIZE.
    """
    tasks = max(1, math.ceil(rows.count() / PER_TASK))
    placed = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    names = placed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, above = None, SIZE  # the row whose lower neighbour is still to come, and what it shares with the upper one
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch] if kept is None else [kept, batch]).combine_chunks().to_batches()[0]
            common = shared(now.column(names.index(column)))
            if within:
                keys = now.column(names.index(within)).to_numpy(zero_copy_only=False)
                common = np.where(keys[1:] == keys[:-1], common, 0)
            upper = np.concatenate([[above], common])
            lower = common
            n = now.num_rows - 1
            yield pa.RecordBatch.from_arrays([*now.slice(0, n).columns, pa.array(np.maximum(upper[:n], lower).astype(np.int32))], names=[*names, name])
            kept, above = now.slice(n), int(upper[n])
        if kept is not None:
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.array([SIZE], np.int32))], names=[*names, name])

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return placed.mapInArrow(run, f"{kinds}, {name} int")


def open_strings(found: DataFrame) -> DataFrame:
    """(string, alone, doc_id, v, start) of all strings that both bounds leave open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {c: batch.column(batch.schema.names.index(c)) for c in batch.schema.names}
            pos, left, least, backs, aheads = (get[c].to_pylist() for c in ("pos", "left", "least", "shared_left", "shared_right"))
            out: list[list] = [[], [], []]
            for i, (p, x, y, b, a) in enumerate(zip(pos, left, least, backs, aheads, strict=True)):
                low, high = max(y, SIZE - a), min(x, b)
                if low > high:
                    continue
                whole = get["back"][i].as_py()[::-1] + get["ahead"][i].as_py()
                for n in range(low, high + 1):
                    out[0].append(i)
                    out[1].append(whole[x - n : x - n + SIZE])
                    out[2].append(p - n)
            number = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out[1], pa.binary()), *[get[c].take(number) for c in ("alone", "doc_id", "v")], pa.array(out[2], pa.int32())], names=["string", "alone", "doc_id", "v", "start"])

    return found.mapInArrow(run, "string binary, alone boolean, doc_id long, v long, start int")


STARTS = "l_id long, l_v long, firsts array<int>, lasts array<int>"


def repeated_starts(docs: DataFrame) -> DataFrame:
    """(l_id, l_v, firsts, lasts): per document the ranges of starts of strings that also start elsewhere, in order."""
    keys = cut(parse(docs, key_only=True).groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"), "repeat-keys", free=True)
    rows = cut(parse(docs).join(keys, "key", "left_semi"), "repeat-triggers", free=True)
    # A document's triggers in one row: no more than its text has. They need not move again.
    hits = cut(rows.groupBy("doc_id", "v").agg(F.collect_list(F.struct("pos", "shape", "more", "key", "c1", "c2")).alias("t")), "repeat-parse", free=True)
    discard(keys, rows)
    place = F.struct("doc_id", "v", "pos", "shape", "key")
    known = hits.select("doc_id", "v", F.inline("t")).groupBy("c1", "c2").agg(F.sum(F.col("more") + 1).alias("n"), F.min(place).alias("rep"))
    known = cut(known.select("c1", "c2", (F.col("n") == 1).alias("alone"), "rep.*"), "repeat-dictionary", free=True)
    crowd = known.groupBy("key").agg(F.min("c1").alias("a"), F.max("c1").alias("b"), F.max("alone").alias("some")).where("a < b and some").select("key")
    crowd = cut(crowd, "repeat-crowds", free=True)
    found = cut(entries(docs, known.join(crowd, "key", "left_semi")), "repeat-entries", free=True)
    phrases = cut(with_neighbours(found, ["key", "back"], "back", "shared_left", within="key"), "repeat-phrases", free=True)
    discard(crowd, found)
    suffixes = cut(with_neighbours(phrases, ["ahead", "back"], "ahead", "shared_right"), "repeat-suffixes", free=True)
    discard(phrases)
    strings = cut(open_strings(suffixes), "repeat-strings", free=True)
    discard(suffixes)
    twice = strings.groupBy("string").agg(F.count("*").alias("n"), F.max("alone").alias("some")).where("n > 1 and some")
    word = [h.alias(n) for h, n in zip(hash128(F.col("string")), ("x1", "x2"), strict=True)]  # of strings that were equal byte by byte
    twice = cut(twice.select(*word), "repeat-equal", free=True)
    single = strings.where("alone").select("doc_id", "v", "start", *word).join(twice, ["x1", "x2"], "left_semi").groupBy(F.col("doc_id").alias("s_id"), F.col("v").alias("s_v")).agg(F.collect_list("start").alias("single"))
    single = cut(single, "repeat-single", free=True)
    discard(strings, twice)
    alone = known.where("alone").groupBy(F.col("doc_id").alias("a_id"), F.col("v").alias("a_v")).agg(F.collect_list("pos").alias("alone"))
    own = hits.select("doc_id", "v", "t.pos", "t.shape", "t.more")
    own = own.join(alone, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("v") == F.col("a_v")), "left").join(single, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("v") == F.col("s_v")), "left")
    starts = cut(own.select("doc_id", "v", "pos", "shape", "more", "alone", "single").mapInArrow(_settled, STARTS), "repeat-starts", free=True)
    discard(hits, known, single)
    return starts


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All strings of entries that occur twice, and the single strings found, as ranges per document."""
    for batch in batches:
        firsts, lasts = [], []
        for i in range(batch.num_rows):
            pos, shape, more, alone, single = (np.asarray(batch.column(c)[i].values, np.int64) if batch.column(c)[i].is_valid else np.empty(0, np.int64) for c in range(2, 7))
            stay = ~np.isin(pos, alone)
            pos, shape, more = pos[stay], shape[stay], more[stay]
            left, least = shape >> 16 & 255, shape & 255
            first, last = merged(np.concatenate([pos - left, single]), np.concatenate([pos + more * (left + 1) - least, single]))
            firsts.append(first)
            lasts.append(last)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(firsts, pa.list_(pa.int32())), pa.array(lasts, pa.list_(pa.int32()))], names=["l_id", "l_v", "firsts", "lasts"])


def merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inclusive ranges merged where they meet or follow each other."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order]) if len(last) else last
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > reach[:-1] + 1
    return first[new], np.append(reach[:-1][new[1:]], reach[-1:])


def cut_out(text: bytes, starts: list[tuple[int, int]]) -> tuple[bytes, int]:
    """``text`` without the bytes of strings that start in ``starts`` (inclusive ranges), and the count of runs removed."""
    kept, runs, at = [], 0, 0
    reach = -1
    for first, last in sorted(starts):
        if first > reach:
            if reach >= 0:
                at = reach
            kept.append(text[at:first])
            runs += 1
        reach = max(reach, last + SIZE)
    if reach >= 0:
        at = reach
    kept.append(text[at:])
    return b"".join(kept), runs


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay)."""
    lists = repeated_starts(docs)
    joined = _keyed(docs).join(lists, F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("v") == F.col("l_v")), "left").select("doc_id", "text", "firsts", "lasts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, firsts, lasts in zip(*(batch.column(i) for i in range(4)), strict=True):
                text = text.as_py().encode()
                kept, runs = cut_out(text, list(zip(firsts.as_py() or (), lasts.as_py() or (), strict=True)))
                rows.append((doc_id.as_py(), len(text), len(text) - len(kept), runs, kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def digest(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()
