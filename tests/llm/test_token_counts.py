import random

from recordkeep.llm.token_counts import Automaton, Counts, token_counts


def brute(vocabulary, word):
    at = n = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in vocabulary), None)
        if end is None:
            return 1, 1
        n, at = n + 1, end
    return n, 0


def test_automaton_against_longest_match():
    rng = random.Random(2)
    for _ in range(300):
        vocabulary = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 14))}
        automaton = Automaton(vocabulary)
        for _ in range(40):
            word = bytes(rng.choice(b"abcd" if rng.random() < 0.1 else b"abc") for _ in range(rng.randrange(0, 15)))
            assert automaton.count(word) == brute(vocabulary, word), (vocabulary, word)


def test_work_is_linear():
    automaton = Automaton([b"a" * 50, b"a", b"ab"])
    assert automaton.count(b"a" * 100_003) == (2000 + 3, 0)


def test_bounded_memory():
    counts = Counts(Automaton([b" ", b"a", b"b"]), limit=10)
    for i in range(100):
        counts[b"ab" * (i + 1)]
    assert len(counts) <= 10 and counts[b"ab" * 7] == 15


def test_documents(spark):
    words = [" ", " he", "llo", "l", "o", "h", "e", "w"]
    rows = [(1, "hello\thello  wo"), (2, None), (3, ""), (4, " \n"), (None, "hello"), (5, "hé"), (1, "hello\thello  wo")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_words string")
    got = sorted((tuple(r) for r in token_counts(df, [w.encode() for w in words]).collect()), key=repr)
    assert got == sorted([(1, 15, 3, 2 + 2 + 3, 0), (1, 15, 3, 7, 0), (2, 0, 0, 0, 0), (3, 0, 0, 0, 0), (4, 2, 0, 0, 0), (None, 5, 1, 2, 0), (5, 3, 1, 1, 1)], key=repr)
    assert token_counts(df.limit(0), [b"a"]).collect() == []
