import itertools
import random
import re
import zlib
from collections import Counter

from recordkeep.llm import spelling as S


def count(rows, least_chars=5, least=3, modulus=None):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if modulus and h % modulus == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= least_chars:
                found[word] += 1
    return {w: n for w, n in found.items() if n >= least}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n_of):
    kin = {w: [v for v in n_of if near(w, v)] for w in n_of}
    form = {}
    for w, vs in kin.items():
        best = min(vs, key=lambda v: (-n_of[v], v), default=None)
        form[w] = best if best is not None and n_of[best] >= 2 * n_of[w] else None
    out = []
    for w in n_of:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n_of[w], len(kin[w]), n_of[form[w]] if form[w] else None))
    return sorted(out)


def run(spark, n_of):
    return sorted(tuple(r) for r in S.variants(spark.createDataFrame(list(n_of.items()), "word string, n long")).collect())


def test_small_alphabets_against_brute_force(spark):
    rng = random.Random(1)
    every = ["".join(w) for k in range(1, 6) for w in itertools.product("aé", repeat=k)]
    assert run(spark, found := {w: rng.choice((1, 2, 4, 8, 300)) for w in every}) == brute(found)
    mixed = {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 9))): rng.randrange(1, 40) for _ in range(700)}
    assert run(spark, mixed) == brute(mixed)


def test_long_words(spark):
    rng = random.Random(2)
    words = {"b" * 300: 50, "b" * 299: 3, "b" * 301: 2}
    for size in (63, 64, 65, 66, 127, 128, 129, 130, 1000):
        w = "".join(rng.choice("abcdefgh") for _ in range(size))
        words[w] = 900
        for at in (0, 1, 62, size // 2, size - 1):
            words[w[:at] + w[at + 1 :]] = 100
            words[w[:at] + "z" + w[at:]] = 40
            words[w[:at] + "y" + w[at + 1 :]] = 7
        words[w + "z"] = 1
    assert run(spark, words) == brute(words)


def test_keys_follow_from_what_was_read():
    rng = random.Random(3)
    long = "".join(rng.choice("ab") for _ in range(400))
    seen = {}
    for text in (long, long[:64], long[:65], long[:128], long[:200] + "c" + long[200:], "b" * 400, ""):
        trail = S.Trail(text)
        for k in range(len(text) + 1):
            key = trail.key(k)
            assert len(key) <= 65 + S.KEY and seen.setdefault(key, text[:k]) == text[:k]
    assert len(set(seen.values())) == len(seen)


def test_words(spark):
    rows = [(1, "Häuser HÄUSER\nhäuser, x-abcde ABCDE abcde9abcde"), (2, None), (3, ""), (None, "abcde abcde"), (1, "Häuser HÄUSER\nhäuser, x-abcde ABCDE abcde9abcde"), (4, "lang" * 50_000 + " Ünder ünder ÷÷÷÷÷ ×abcd")]
    docs = spark.createDataFrame([(t, i, "e", 5) for i, t in rows], "text string, doc_id long, word string, n int")
    for modulus in (None, 1, 2):
        assert {r.word: r.n for r in S.words(docs, modulus=modulus).collect()} == count(rows, modulus=modulus)
    assert S.words(docs.limit(0)).count() == 0 and run(spark, {}) == []


def test_forms_lead_to_roots(spark):
    # each word is near the next alone, which occurs twice as often
    chain = {"m" + "abcdefghijklmnopqrst"[: k + 1]: 2**k for k in range(18)}
    got = {r[0]: r for r in run(spark, chain)}
    top = "mabcdefghijklmnopqr"
    assert all(r[2] == top for r in got.values()) and got[top][1] is None and run(spark, chain) == brute(chain)
    ties = {"mitte": 2, "matte": 9, "motte": 9, "mätte": 9}
    assert {r[0]: r[1] for r in run(spark, ties)}["mitte"] == "matte"


def test_query(spark, tmp_path):
    rng = random.Random(4)
    stems = ["".join(rng.choice("taremisolu") for _ in range(6)) for _ in range(40)]
    rows = [(i, " ".join(rng.choice(stems) for _ in range(rng.randrange(0, 200)))) for i in range(60)]
    spark.createDataFrame(rows + rows[:3], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in S.op13_spelling_variants(spark, str(tmp_path)).collect()) == brute(count(rows + rows[:3], modulus=97))
