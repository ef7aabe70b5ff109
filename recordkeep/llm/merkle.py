"""A Merkle manifest of a data set: every document can be proved to be in it, and unchanged, by a few digests.

The documents of a source are the leaves of a tree, in the order of their ids; FAN consecutive nodes become one, level
by level, and the subroots of the sources are folded in the same way to the root.

A node is labelled by the interval of leaf ranks that it covers, [lo, hi). Ranks come from a range-partitioned sort, so
a source that holds a third of all rows is spread like any other. LEVELS levels at a time share a bucket: the nodes of
the lowest of them under one top, at most FAN ** LEVELS, are grouped once, their upper levels are folded in place, and the tops go on to
the next tier. On the way back each tier's buckets are joined with the node of the tier above whose interval contains
theirs, on (tree, bucket), which attaches all their ancestors; siblings are the nodes inside the parent's interval that
do not contain the leaf. Only (id, source, digests) of a document are moved, twice; the tables of the tiers above hold
a 1/243 of the rows each.

Defined cases: null fields have an encoding of their own, empty text is not null text; a null source is a source, the
first; null ids come first; rows with one id and source stand in the order of their digests, equal rows are leaves of
their own; an empty table has no leaf and no root; a source of one document is its own subroot, a data set of one
source has that subroot as root; a text of any length is one digest; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordkeep.llm.tables import table
from recordkeep.plans.lineage import cut

#: Children of a node, and levels that are folded in one bucket.
FAN, LEVELS = 3, 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "struct<lo:bigint,hi:bigint,hash:string>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts set one behind another."""
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value, so that no two rows share an encoding."""
    text = c.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(row: dict[str, Column]) -> Column:
    return digest(*[field(row[c]) for c in FIELDS])


def leaves(docs: DataFrame, seen_text: Column | None = None) -> DataFrame:
    """(tree, doc_id, source, leaf, seen): ``seen`` is the leaf of the document as a verifier sees it, with ``seen_text``.

    ``tree`` names the source so that bytewise order puts the null source first.
    """
    own = {c: F.col(f"`{c}`") for c in FIELDS}
    tree = F.when(own["source"].isNull(), "").otherwise(F.concat(F.lit("+"), own["source"]))
    seen = leaf(own) if seen_text is None else leaf(own | {"text": seen_text})
    return docs.select(tree.alias("tree"), "doc_id", "source", leaf(own).alias("leaf"), seen.alias("seen"))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (tree, ...) with their ``rank`` in their tree's ``order``, from 0, and ``n``, the rows of the tree.

    Give rows that are written: a range sort reads its input twice. Rows that tie fall apart by their place in the input.
    """
    part = rows.withColumn("_tie", F.monotonically_increasing_id()).orderBy("tree", *order, "_tie").drop("_tie")
    part = cut(part.withColumn("_id", F.monotonically_increasing_id()), "ranked").withColumn("_part", F.shiftright("_id", 33))
    spans = part.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    whole = Window.partitionBy("tree")  # rows are (tree, partition) pairs
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("tree", "_part", "_first", before.alias("_before"), F.sum("_n").over(whole).alias("n"))
    return part.join(spans, ["tree", "_part"]).withColumn("rank", F.col("_before") + F.col("_id") - F.col("_first")).drop("_part", "_id", "_first", "_before")


def depth(n: Column) -> Column:
    """Levels above ``n`` leaves: the powers of FAN below ``n``."""
    powers = F.array(*[F.lit(FAN**k) for k in range(40)])
    return F.size(F.filter(powers, lambda p: p < n))


def _upper(level: Column) -> Column:
    """The parents of a level: intervals and digests of runs of FAN nodes."""

    def parent(j: Column) -> Column:
        run = F.slice(level, j * FAN + 1, FAN)
        return F.struct(F.get(run, F.lit(0))["lo"].alias("lo"), F.element_at(run, -1)["hi"].alias("hi"), F.sha2(F.array_join(F.transform(run, lambda x: x["hash"]), ""), 256).alias("hash"))

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FAN).cast("int")), parent)


def _buckets(items: DataFrame, tier: int) -> DataFrame:
    """``items`` (tree, n, at, lo, hi, hash, own) -> (tree, n, bucket, left, own, levels), written.

    ``left`` counts the levels still above this tier's lowest, ``levels`` holds those inside the bucket.
    """
    grouped = items.groupBy("tree", "n", F.floor(F.col("at") / FAN**LEVELS).cast("long").alias("bucket")).agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "hash", "own"))).alias("l"))
    out = grouped.select("tree", "n", "bucket", (depth(F.col("n")) - LEVELS * tier).alias("left"), F.transform("l", lambda x: x["own"]).alias("own"), F.transform("l", lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), x["hash"].alias("hash"))).alias("l0"))
    for k in range(1, LEVELS + 1):
        out = out.withColumn(f"l{k}", F.when(F.col("left") >= k, _upper(F.col(f"l{k - 1}"))))
    levels = F.array(*[F.coalesce(f"l{k}", F.array().cast(f"array<{NODE}>")) for k in range(LEVELS + 1)])
    return cut(out.select("tree", "n", "bucket", "left", "own", levels.alias("levels")), "merkle-tier")


def _top() -> Column:
    """The highest node inside a bucket."""
    return F.get(F.get("levels", F.least(F.col("left"), F.lit(LEVELS))), F.lit(0))


def tiers(rows: DataFrame) -> list[DataFrame]:
    """``rows`` (tree, rank, n, hash, own) -> bucket tables from the leaves up; as many as the largest tree needs."""
    most = rows.agg(F.max("n")).first()[0]
    if most is None:
        return []
    items, out = rows.select("tree", "n", F.col("rank").alias("at"), F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "hash", "own"), []
    while True:
        out.append(_buckets(items, len(out)))
        if FAN ** (LEVELS * len(out)) >= most:
            return out
        top = _top()
        items = out[-1].where(F.col("left") > LEVELS).select("tree", "n", F.col("bucket").alias("at"), top["lo"].alias("lo"), top["hi"].alias("hi"), top["hash"].alias("hash"), F.lit(None).cast(rows.schema["own"].dataType).alias("own"))


def roots(found: list[DataFrame]) -> DataFrame:
    """(tree, hash) of :func:`tiers`."""
    ends = [t.where(F.col("left") <= LEVELS).select("tree", _top()["hash"].alias("hash")) for t in found]
    out = ends[0]
    for more in ends[1:]:
        out = out.unionByName(more)
    return out


def nodes(found: list[DataFrame]) -> DataFrame:
    """All nodes of :func:`tiers` by their labels: (tree, level, lo, hi, hash), leaves at level 0."""
    out = None
    for k, tier in enumerate(found):
        low = tier.select("tree", F.posexplode("levels").alias("level", "row")).where("level > 0" if k else "true")  # a tier's lowest level is the top one of the tier below
        own = low.select("tree", (F.col("level") + LEVELS * k).alias("level"), F.explode("row").alias("x")).select("tree", "level", "x.*")
        out = own if out is None else out.unionByName(own)
    return out


def paths(found: list[DataFrame], outer: DataFrame) -> DataFrame:
    """:func:`tiers` and what is above their trees (tree, path, ...) -> (tree, hash, own, path, ...) a leaf.

    A path holds, level by level up to the root, the digests of the siblings left and right of the way.
    """
    more = [c for c in outer.columns if c not in ("tree", "path")]
    above = None  # (tree, at, lo, hi, path, ...): the nodes of the tier above that are tops of this tier's buckets
    for k in reversed(range(len(found))):
        rows = found[k].withColumn("top", _top())
        held = rows.where(F.col("left") <= LEVELS).join(outer.withColumnRenamed("path", "up"), "tree")
        if above is not None:
            inner = above.withColumnRenamed("tree", "t").withColumnRenamed("path", "up")
            contains = (F.col("tree") == F.col("t")) & (F.col("bucket") == F.col("at")) & (F.col("lo") <= F.col("top.lo")) & (F.col("hi") >= F.col("top.hi"))
            held = held.unionByName(rows.where(F.col("left") > LEVELS).join(inner, contains).drop("t", "at", "lo", "hi"))

        def siblings(x: Column, level: int, tier: int = k) -> Column:
            place = F.floor(x["lo"] / FAN ** (LEVELS * tier + level)) - F.col("bucket") * FAN ** (LEVELS - level)
            run = F.slice(F.get("levels", F.lit(level)), (F.floor(place / FAN) * FAN + 1).cast("int"), FAN)  # what the parent covers
            hashes = lambda kept: F.array_join(F.transform(F.filter(run, kept), lambda c: c["hash"]), "")
            return F.struct(hashes(lambda c: c["hi"] <= x["lo"]).alias("before"), hashes(lambda c: c["lo"] >= x["hi"]).alias("after"))

        steps = lambda x: F.slice(F.array(*[siblings(x, level) for level in range(LEVELS)]), F.lit(1), F.least(F.col("left"), F.lit(LEVELS)))
        inside = F.transform(F.get("levels", F.lit(0)), lambda x, i: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), x["hash"].alias("hash"), F.get("own", i).alias("own"), steps(x).alias("way")))
        each = held.select("tree", "up", *more, F.explode(inside).alias("x"))
        above = each.select("tree", F.floor(F.col("x.lo") / FAN ** (LEVELS * k)).alias("at"), "x.lo", "x.hi", "x.hash", "x.own", F.concat("x.way", "up").alias("path"), *more)
        if k:
            above = cut(above.drop("own", "hash"), "merkle-paths")
    return above.drop("at", "lo", "hi")


def fold(path: Column, start: Column) -> Column:
    """The root that follows from a leaf and the digests beside its way."""
    return F.aggregate(path, start, lambda acc, s: digest(s["before"], acc, s["after"]))


def proof(path: Column) -> Column:
    """One digest of all the digests of a path."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(docs: DataFrame, seen_text: Column | None = None) -> DataFrame:
    """Per document: doc_id, source, leaf, subroot, root, path, and ``seen``, the leaf with ``seen_text`` for its text.

    ``fold(path, leaf)`` is the root; ``fold(path, seen)`` is it only for an unchanged document.
    """
    rows = cut(leaves(docs, seen_text), "merkle-leaves")
    own = F.struct("doc_id", "source", "seen")
    found = tiers(ranked(rows, ["doc_id", "leaf", "seen"]).select("tree", "rank", "n", F.col("leaf").alias("hash"), own.alias("own")))
    kind = "array<struct<before:string,after:string>>"
    if not found:
        return rows.select("doc_id", "source", "leaf", "seen", F.lit("").alias("subroot"), F.lit("").alias("root"), F.array().cast(kind).alias("path")).limit(0)
    subroots = cut(roots(found), "merkle-subroots")
    upper = tiers(ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash"), ["name"]).select("tree", "rank", "n", "hash", F.struct(F.col("name"), F.col("hash").alias("subroot")).alias("own")))
    root = roots(upper).withColumnRenamed("hash", "root").withColumn("path", F.array().cast(kind))  # one row
    outer = cut(paths(upper, root).select(F.col("own.name").alias("tree"), "path", F.col("own.subroot").alias("subroot"), "root"), "merkle-sources")
    return paths(found, outer).select("own.doc_id", "own.source", F.col("hash").alias("leaf"), "own.seen", "subroot", "root", "path")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 2 == 0
    found = manifest(docs, F.when(hit, F.replace("text", F.lit("\n"))).otherwise(F.col("text")))
    done = found.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), fold(F.col("path"), F.col("seen")).alias("folded_root"))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS[:-1]) + " || " + _FIELD + ")"

#: The reversed polynomial of crc32 gives the table of its bytes; then one step a byte of the UTF-8 text.
CRC_TABLE = "crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode({0}))), lambda k: ('0x' || substr(hex(encode({0})), 2 * k::INT + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, crc.t[1 + (xor(c, b) & 255)])), 4294967295)"

#: The same by levels, a row a node, and a climb from each leaf.
ORACLE = f"""
WITH RECURSIVE {CRC_TABLE},
l AS (SELECT doc_id, source, {_LEAF.format('text')} AS leaf,
        CASE WHEN {CRC.format('doc_id::VARCHAR')} % 2 = 0 THEN {_LEAF.format("replace(text, chr(10), '')")} ELSE {_LEAF.format('text')} END AS seen FROM documents, crc),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS rank FROM l),
tree AS (SELECT source, 0 AS level, rank AS pos, leaf AS hash, count(*) OVER (PARTITION BY source) AS n FROM r
    UNION ALL SELECT source, level + 1, pos // {FAN}, sha256(string_agg(hash, '' ORDER BY pos)), (n + {FAN - 1}) // {FAN} FROM tree WHERE n > 1 GROUP BY source, level, pos // {FAN}, n),
s AS (SELECT source, hash AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS rank FROM tree WHERE n = 1),
top AS (SELECT 0 AS level, rank AS pos, subroot AS hash, count(*) OVER () AS n FROM s
    UNION ALL SELECT level + 1, pos // {FAN}, sha256(string_agg(hash, '' ORDER BY pos)), (n + {FAN - 1}) // {FAN} FROM top WHERE n > 1 GROUP BY level, pos // {FAN}, n),
root AS (SELECT hash AS root FROM top WHERE n = 1),
own AS (SELECT source, level, pos, n, pos // {FAN} AS up, hash FROM tree WHERE n > 1),
kin AS (SELECT a.source, a.level, a.pos, coalesce(string_agg(b.hash, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before, coalesce(string_agg(b.hash, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
    FROM own a JOIN own b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.up = b.up GROUP BY ALL),
town AS (SELECT level, pos, n, pos // {FAN} AS up, hash FROM top WHERE n > 1),
tkin AS (SELECT a.level, a.pos, coalesce(string_agg(b.hash, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before, coalesce(string_agg(b.hash, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
    FROM town a JOIN town b ON a.level = b.level AND a.up = b.up GROUP BY ALL),
climb AS (SELECT source, rank AS k, 0 AS level, rank AS pos, seen AS hash, '' AS path FROM r
    UNION ALL SELECT c.source, k, c.level + 1, c.pos // {FAN}, sha256(before || c.hash || after), path || before || after FROM climb c JOIN kin ON c.source IS NOT DISTINCT FROM kin.source AND c.level = kin.level AND c.pos = kin.pos),
inner_end AS (SELECT c.source, k, c.hash, path FROM climb c JOIN tree t ON c.source IS NOT DISTINCT FROM t.source AND c.level = t.level AND c.pos = t.pos WHERE t.n = 1),
above AS (SELECT e.source, k, 0 AS level, s.rank AS pos, hash, path FROM inner_end e JOIN s ON e.source IS NOT DISTINCT FROM s.source
    UNION ALL SELECT a.source, k, a.level + 1, a.pos // {FAN}, sha256(before || a.hash || after), path || before || after FROM above a JOIN tkin ON a.level = tkin.level AND a.pos = tkin.pos),
ended AS (SELECT source, k, arg_max(hash, level) AS folded_root, arg_max(path, level) AS path FROM above GROUP BY source, k)
SELECT doc_id, leaf, subroot, root, sha256(path) AS proof_sha256, folded_root, folded_root = root AS verified
FROM r JOIN ended e ON r.source IS NOT DISTINCT FROM e.source AND r.rank = e.k JOIN s ON r.source IS NOT DISTINCT FROM s.source, root
"""
