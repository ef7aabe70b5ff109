"""Line dedup: lines that several documents hold stay only in the document with the smallest id.

Each document is split at ``\\n``. A line's key is the line without ASCII white space at its ends and with A-Z in
lower case. Keys of at least ``min_chars`` code points are hashed to 128 bits; a partial aggregation finds, per hash,
how many documents hold it and the smallest doc_id among them. Only (hash, keeper) of repeated lines is joined back
to the narrow (document, position, hash) rows, which are written once; the text itself is shuffled once, when the
positions to drop reach it, and split only behind that.

Defined cases:
* null or empty text: one empty line, which stays (n_lines 1, n_dropped 0);
* null doc_id: the row counts for no line, so it is never a keeper; it loses lines held by ``min_docs`` other ids;
* rows with the same doc_id are one document: they do not make a line repeated, and keep or lose it together;
* very long texts: a text is one row, however many lines it has; a line of any length is one hash;
* ties: of documents that hold a line only the smallest id keeps it, there, however often it stands in it;
* extra columns pass through; a column named as one of the added ones is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordkeep.llm.tables import WHITE, ascii_lower, hash128, packed, table
from recordkeep.plans.lineage import cut


def line_dedup(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` (doc_id, text, ...) with text replaced by what is kept, and n_lines and n_dropped added."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    lines = F.split(text, "\n", -1)
    rows = packed(docs).select("row", F.col("row.doc_id").cast("long").alias("id"), F.xxhash64(text).alias("version"))  # rows of one id may hold different texts
    key = ascii_lower(F.btrim(F.col("line"), F.lit(WHITE)))
    held = (
        rows.select("id", "version", F.posexplode(lines).alias("at", "line"))
        .select("id", "version", "at", key.alias("key"))
        .where(F.length("key") >= min_chars)
        .select("id", "version", "at", *[h.alias(n) for h, n in zip(hash128(F.col("key")), ("h1", "h2"), strict=True)])
    )
    held = cut(held, "line-hashes")  # narrow; both uses below read it instead of the texts
    if min_docs == 2:  # two documents differ in their smallest and largest id
        repeated = held.groupBy("h1", "h2").agg(F.min("id").alias("keeper"), F.max("id").alias("last")).where("keeper < last").drop("last")
    else:
        one = held.where("id is not null").select("h1", "h2", "id").distinct()
        repeated = one.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("id").alias("keeper")).where(F.col("n") >= min_docs).drop("n")
    repeated = cut(repeated, "repeated-lines")  # both sides of the join below are then plain shuffles, so hot lines are split
    lost = (
        held.join(repeated, ["h1", "h2"])
        .where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("id").alias("lost_id"), F.col("version").alias("lost_version"))
        .agg(F.collect_list("at").alias("lost"))
    )
    found = rows.join(lost, F.col("id").eqNullSafe(F.col("lost_id")) & (F.col("version") == F.col("lost_version")), "left").select("row", "lost", lines.alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("lost", F.array().cast("array<int>")))
    kept = found.select(
        "row",
        F.size("lines").cast("long").alias("n_lines"),
        F.size(stay).cast("long").alias("n_stay"),
        F.when(F.col("lost").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")).alias("kept"),
    )
    own = {"text": F.when(F.col("n_lines") == F.col("n_stay"), F.col("row.text")).otherwise(F.col("kept")), "n_lines": F.col("n_lines"), "n_dropped": F.col("n_lines") - F.col("n_stay")}
    names = [c for c in docs.columns if c not in own or c == "text"]
    return kept.select(*[own[c].alias(c) if c == "text" else F.col(f"row.`{c}`") for c in names], own["n_lines"].alias("n_lines"), own["n_dropped"].alias("n_dropped"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256."""
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_KEY = r"translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The same by plain SQL.
ORACLE = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, {_KEY} AS key FROM l),
r AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.doc_id, pos, line, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
