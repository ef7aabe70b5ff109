"""Spelling variants: words that differ by one code point, and the commoner word that each is a form of.

Two words differ by one replaced code point if they share what stands before it and what stands behind it, and by one
inserted if the longer one shares both with the shorter one cut at that place. So every word is followed through two
tries, of beginnings and of endings, whose nodes are numbered once, and what is joined are pairs of integers: for each
place the node before it and the node behind it, with the code point there skipped, and with nothing skipped (where
another word has one inserted). Words that meet at a pair are neighbours for certain; nothing has to be verified, and no pair meets
twice, as of a run of equal code points only the first is taken as inserted. At one pair only words stand that differ in
one code point, as many as the alphabet has, so groups are small whatever the corpus; their counts and best members are
enough, and no pairs are written. The corpus is read once and aggregated to words before any shuffle.

Forms make a forest (a form occurs at least ``ratio`` > 1 times as often as its word), whose roots are found by pointer jumping.

Defined cases: null and empty texts have no words; a null doc_id reads as the empty text where noise is drawn; rows
repeat as they come, each counts; a text of any length is split as a whole; of a word longer than KEY code points,
nodes are keyed by a SHA-256 chain over blocks of KEY code points and what follows the last, so that its rows stay as short as other words';
ties between forms go to the smallest in code-point order; an empty table gives no words; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordkeep.llm.merkle import CRC, CRC_TABLE
from recordkeep.llm.tables import LOWER, UPPER, ascii_lower, table
from recordkeep.operators.browse import placed
from recordkeep.plans.lineage import cut, discard

RUN = r"[A-Za-zÀ-ÿ]+"
#: Code points of a node's key before it is shortened by a hash.
KEY = 64
#: Rows of an Arrow batch.
BATCH = 20_000


def noisy(doc_id: Column, run: Column, modulus: int) -> Column:
    """``run`` without one code point where ``modulus`` divides the checksum of document and run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % modulus == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def words(docs: DataFrame, least_chars: int = 5, least: int = 3, modulus: int | None = None) -> DataFrame:
    """(word, n) of the runs of letters in ``docs`` (doc_id, text), A-Z in lower case."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), 0)).alias("run"))
    one = ascii_lower(F.col("run"))
    found = runs.select((one if modulus is None else noisy(F.col("doc_id"), one, modulus)).alias("word")).where(F.length("word") >= least_chars)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


class Trail:
    """Keys of the trie nodes that a word passes, by the number of code points read: the text itself, later a chained hash and the rest."""

    def __init__(self, word: str):
        self.word, self.chain = word, [""]
        for start in range(0, len(word) - KEY, KEY):
            self.chain.append("#" + hashlib.sha256((self.chain[-1] + word[start : start + KEY]).encode("utf-8", "surrogatepass")).hexdigest())

    def key(self, read: int) -> str:
        block = max(0, read - 1) // KEY
        return self.chain[block] + self.word[block * KEY : read]


def places(vocabulary: DataFrame) -> DataFrame:
    """``vocabulary`` (id, word, n) -> (id, n, ahead, behind, skip): keys of the nodes around each place of a word.

    ``skip`` is null where nothing is skipped; else it says if the code point skipped is the first of its run.
    """
    names = ["id", "n", "ahead", "behind", "skip"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for i, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ahead, behind, size = Trail(word), Trail(word[::-1]), len(word)
                for k in range(size + 1):
                    rows.append((i, n, ahead.key(k), behind.key(size - k), None))
                    if k < size:
                        rows.append((i, n, ahead.key(k), behind.key(size - k - 1), k == 0 or word[k] != word[k - 1]))
                    if len(rows) >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return vocabulary.select("id", "word", "n").mapInArrow(run, "id long, n long, ahead string, behind string, skip boolean")


def numbered(rows: DataFrame, key: str, number: str) -> DataFrame:
    """``rows`` with the node of their ``key`` as an integer, for the key itself; the empty key is node 0.

    Beginnings of one letter are hot keys: both sides of the join are shuffles of written tables, which Spark splits.
    """
    nodes = cut(rows.select(key).where(F.col(key) != "").distinct().withColumn(number, F.monotonically_increasing_id() + 1), f"trie-{key}")
    inner = rows.where(F.col(key) != "").join(nodes, key).drop(key)
    return inner.unionByName(rows.where(F.col(key) == "").withColumn(number, F.lit(0).cast("long")).drop(key))


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """``vocabulary`` (id, word, n), ids in code-point order -> (id, n_near, best) of words that have near ones.

    ``best`` is the struct (n, -id) of the near word that occurs most, of several the first.
    """
    rows = cut(places(vocabulary), "spelling-places")
    half = cut(numbered(rows, "ahead", "p"), "spelling-ahead")
    pairs = numbered(half, "behind", "s")
    met = pairs.groupBy("p", "s").agg(F.collect_list(F.struct("n", (-F.col("id")).alias("o"), "skip")).alias("all")).where(F.size("all") > 1)
    plain = lambda xs: F.transform(xs, lambda x: F.struct(x["n"].alias("n"), x["o"].alias("o")))
    met = met.select(
        F.get(F.filter("all", lambda x: x["skip"].isNull()), F.lit(0))["o"].alias("whole"),
        F.get(plain(F.filter("all", lambda x: x["skip"].isNull())), F.lit(0)).alias("shorter"),
        F.sort_array(plain(F.filter("all", lambda x: x["skip"].isNotNull())), asc=False).alias("gaps"),
        F.sort_array(plain(F.filter("all", lambda x: x["skip"])), asc=False).alias("longer"),
    )
    of = lambda x, count, best: F.struct((-x["o"]).alias("id"), count.cast("long").alias("n_near"), best.alias("best"))
    replaced = F.transform("gaps", lambda x: of(x, F.size("gaps") - 1, F.when(x["o"] == F.get("gaps", F.lit(0))["o"], F.get("gaps", F.lit(1))).otherwise(F.get("gaps", F.lit(0)))))
    cut_short = F.when(F.col("whole").isNotNull(), F.transform("longer", lambda x: of(x, F.lit(1), F.col("shorter"))))
    filled = F.when(F.col("whole").isNotNull() & (F.size("longer") > 0), F.array(of(F.col("shorter"), F.size("longer"), F.get("longer", F.lit(0)))))
    none = F.array().cast("array<struct<id:bigint,n_near:bigint,best:struct<n:bigint,o:bigint>>>")
    each = met.select(F.explode(F.concat(*[F.coalesce(a, none) for a in (replaced, cut_short, filled)])).alias("x")).select("x.*").where("n_near > 0")
    found = cut(each.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.max("best").alias("best")), "spelling-near")
    discard(rows, half)
    return found


def roots(forms: DataFrame) -> DataFrame:
    """``forms`` (id, form) of a forest -> (id, root); every form is followed to its last.

    Each round doubles the way that a row has gone, so there are as many as the depth has binary digits.
    """
    now = cut(forms.select("id", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = now.join(now.select(F.col("id").alias("root"), F.col("root").alias("next")), "root", "left")
        after = cut(step.select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        moved = not after.where("moved").isEmpty()
        discard(now)
        now = after.drop("moved")
        if not moved:
            return now
        now = cut(now, "spelling-roots")
        discard(after)


def variants(found: DataFrame, ratio: int = 2) -> DataFrame:
    """``found`` (word, n) -> per word: word, form, root, n, n_near, form_n."""
    own = cut(found.select("word", "n"), "spelling-words")
    vocabulary = cut(placed(own, [F.col("word")]).withColumnRenamed("place", "id"), "spelling-vocabulary")
    near = neighbours(vocabulary)
    good = vocabulary.join(near, "id").where(F.col("best.n") >= F.lit(ratio) * F.col("n"))
    forms = cut(good.select("id", (-F.col("best.o")).alias("form"), F.col("best.n").alias("form_n")), "spelling-forms")
    last = roots(forms)
    name = lambda c: vocabulary.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word"))
    ends = forms.join(last, "id").join(name("form"), "form").join(name("root"), "root").select("id", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "form_n")
    out = vocabulary.join(near.select("id", "n_near"), "id", "left").join(ends, "id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n."""
    return variants(words(table(spark, sf_dir, "documents"), modulus=97))


_LOWER = f"translate(run, '{UPPER}', '{LOWER}')"

#: The same by joining texts with one code point left out or replaced by a mark.
ORACLE = f"""
WITH RECURSIVE {CRC_TABLE},
t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
o AS (SELECT doc_id, {_LOWER} AS run, count(*) AS n FROM t GROUP BY ALL),
h AS (SELECT run, n, {CRC.format("doc_id::VARCHAR || ':' || run")} AS h FROM o, crc),
d AS (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM d WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
g AS (SELECT word, n, substr(word, 1, i::INT) AS a, substr(word, i::INT + 2) AS b FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
near AS (
  SELECT x.word, y.word AS other, y.n AS other_n FROM g x JOIN g y ON x.a = y.a AND x.b = y.b AND x.word <> y.word AND length(x.word) = length(y.word)
  UNION SELECT g.word, w.word, w.n FROM g JOIN w ON w.word = g.a || g.b
  UNION SELECT w.word, g.word, g.n FROM g JOIN w ON w.word = g.a || g.b),
f AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS best, max(other_n) AS best_n FROM near GROUP BY word),
v AS (SELECT w.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 2 * n THEN best END AS form, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n FROM w LEFT JOIN f ON w.word = f.word),
r AS (SELECT word, word AS root, 0 AS k FROM v UNION ALL SELECT r.word, v.form, k + 1 FROM r JOIN v ON v.word = r.root WHERE v.form IS NOT NULL),
last AS (SELECT word, arg_max(root, k) AS root FROM r GROUP BY word)
SELECT v.word, form, root, n, n_near, form_n FROM v JOIN last ON v.word = last.word
"""
