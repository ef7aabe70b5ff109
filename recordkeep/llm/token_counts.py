"""Token counts: greedy longest-match word-piece lengths by a linear automaton.

The vocabulary is a trie of byte strings. Every node carries a failure link and the number of pieces that taking the
link pops, both computed once, breadth first; so a word is counted in one pass over its bytes, without building pieces
and without ever stepping back. Words are maximal runs without ASCII white space; each is matched with one leading
space, as byte-level vocabularies mark word starts. A word that the vocabulary cannot cover counts as one piece and as
one unknown. Words repeat, so each task remembers counts in a table of bounded size.

Defined cases: null or empty text has no words and no pieces; a very long text is counted whole and a very long word in
time linear in it; of pieces that match, the longest is taken, so there are no ties; rows repeat as they come; extra
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from recordkeep.llm.tables import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


class Automaton:
    """Longest-match automaton over ``vocabulary``; ``count(word)`` is (pieces, unknown)."""

    def __init__(self, vocabulary: Iterable[bytes]):
        self.child: dict[int, int] = {}
        ends = [False]
        edges: list[list[tuple[int, int]]] = [[]]
        for token in vocabulary:
            node = 0
            for byte in token:
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = len(ends)
                    edges[node].append((byte, len(ends)))
                    ends.append(False)
                    edges.append([])
                node = self.child[key]
            if node:
                ends[node] = True
        self.fail = [-1] * len(ends)
        self.pops = [0] * len(ends)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for byte, node in edges[parent]:
                if ends[node]:
                    self.fail[node], self.pops[node] = 0, 1
                else:
                    at, popped = self.fail[parent], self.pops[parent]
                    while at >= 0 and (at << 8 | byte) not in self.child:
                        popped += self.pops[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[node], self.pops[node] = self.child[at << 8 | byte], popped
                queue.append(node)

    def count(self, word: bytes) -> tuple[int, int]:
        child, fail, pops = self.child, self.fail, self.pops
        node = pieces = 0
        for byte in word:
            while (step := child.get(node << 8 | byte)) is None:
                pieces += pops[node]
                node = fail[node]
                if node < 0:
                    return 1, 1
            node = step
        while node:
            pieces += pops[node]
            node = fail[node]
            if node < 0:
                return 1, 1
        return pieces, 0


class Counts(dict):
    """Word -> pieces + unknown * 2**40, filled on demand and emptied when ``limit`` words are held."""

    def __init__(self, automaton: Automaton, limit: int = 500_000, longest: int = 64):
        super().__init__()
        self.automaton, self.limit, self.longest = automaton, limit, longest

    def __missing__(self, word: bytes) -> int:
        pieces, unknown = self.automaton.count(b" " + word)
        value = pieces | unknown << 40
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a file with one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


def token_counts(docs: DataFrame, vocabulary: Iterable[bytes]) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_words, n_tokens, n_unknown."""
    sent = docs.sparkSession.sparkContext.broadcast(Automaton(vocabulary))  # as large as the vocabulary, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(sent.value)
        for batch in batches:
            n_bytes, n_words, n_tokens, n_unknown = [], [], [], []
            for text in batch.column(1):
                whole = (text.as_py() or "").encode()
                words = whole.split()
                total = sum(map(counts.__getitem__, words))
                n_bytes.append(len(whole))
                n_words.append(len(words))
                n_tokens.append(total & (1 << 40) - 1)
                n_unknown.append(total >> 40)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (n_bytes, n_words, n_tokens, n_unknown)]], names=["doc_id", "n_bytes", "n_words", "n_tokens", "n_unknown"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_words long, n_tokens long, n_unknown long")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_bytes, n_words, n_tokens, n_unknown."""
    return token_counts(table(spark, sf_dir, "documents"), read_ranks(VOCABULARY))
