"""Link sheets: positional CSV with two scopes, strict two-column child sheets, rich cells of a link directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordkeep.functions.keys import code_prefix, normalize_code, normalize_prefix
from recordkeep.functions.text import collapse, header_name
from recordkeep.functions.urls import destination, unwrap_redirect
from recordkeep.operators import spread
from recordkeep.operators.gates import header_errors
from recordkeep.plans.lineage import cut

CODE, DIVIDER = "NEW CODE", "UNCENSORED"
HEADERS = {"STREAMTAPE": "streamtape", "PLAYER4ME": "player4me", "GOFILE": "gofile"}


class SheetError(ValueError):
    """The sheet's structure is not as agreed."""


#: Characters of the widest line break within a sheet.
_BREAK = "\n"


def read_sheets(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """(file, row_no, cells): the rows of sheet files in order, with all their cells; quoted cells may hold line breaks.

    A file is split at any line. A line starts a row if the quotes before it are even in number, which a running sum
    over pieces of the file tells; lines of one row are set together again and parsed by Spark. Blank rows drop out but
    count. Line ends inside a cell read as line feeds. A quote that stands inside an unquoted cell counts like any other.
    With ``parts`` a sheet is a folder, of which ``file`` is the path, and its files in the order of their names.
    """
    own = F.col("_metadata.file_path")
    file, part = (F.regexp_replace(own, "/[^/]*$", ""), F.substring_index(own, "/", -1)) if parts else (own, F.lit(""))
    lines = spark.read.text(path, lineSep=_BREAK).select(file.alias("file"), part.alias("part"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    place = ["part", "block", "at"]
    counted = spread.running(cut(lines, "sheet-lines"), ["file"], place, F.length("value") - F.length(F.replace("value", F.lit('"'))), "quotes")
    starts = counted.withColumn("start", F.when(F.col("quotes") % 2 == 0, 1).otherwise(0))
    numbered = spread.running(starts, ["file"], place, F.col("start"), "rows").withColumn("row_no", (F.col("rows") + F.col("start") - 1).cast("int"))
    whole = numbered.groupBy("file", "row_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*place, "value"))), lambda x: x["value"]), _BREAK).alias("text"))  # one row's lines
    whole = cut(whole.select("file", "row_no", F.regexp_replace(F.regexp_replace("text", r"\r$", ""), "^\ufeff", "").alias("text")).where("text <> ''"), "sheet-rows")
    bare = F.regexp_replace("text", '"[^"]*"', "")  # commas between cells
    whole = whole.withColumn("n", F.length(bare) - F.length(F.replace(bare, F.lit(","))) + 1)
    width = whole.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    names = [f"c{i}" for i in range(width)]
    options = {"quote": '"', "escape": '"', "multiLine": "true", "emptyValue": "", "maxColumns": str(width + 1), "maxCharsPerColumn": "-1"}
    parsed = whole.select("file", "row_no", "n", F.from_csv("text", ", ".join(f"{n} string" for n in names), options).alias("c"))
    return parsed.select("file", "row_no", F.slice(F.array(*[F.coalesce(F.col(f"c.{n}"), F.lit("")) for n in names]), F.lit(1), F.col("n")).alias("cells"))


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """(row_no, cells) of one sheet file, see :func:`read_sheets`."""
    return read_sheets(spark, path).drop("file")


def link_cells(rows: DataFrame) -> DataFrame:
    """``rows`` (row_no, cells) with a header in the first -> (row_no, code, scope, provider, url), in long form.

    Columns are found by position, as provider names repeat on both sides of the divider. Rows without a code drop out.
    """
    first = rows.orderBy("row_no").limit(1).select("row_no", F.transform("cells", lambda c: header_name(F.coalesce(c, F.lit("")))).alias("h")).first()
    if first is None:
        raise SheetError("the sheet is empty")
    header = list(first.h)
    if errors := header_errors(header, CODE, DIVIDER, tuple(HEADERS)):
        raise SheetError("; ".join(errors))
    start, middle = header.index(CODE), header.index(DIVIDER)
    places = [(i, "" if i < middle else "uncensored", HEADERS[name]) for i, name in enumerate(header) if name in HEADERS and i > start]
    wide = F.array(*[F.struct(F.lit(scope).alias("scope"), F.lit(p).alias("provider"), F.trim(F.get("cells", F.lit(i))).alias("url")) for i, scope, p in places])
    body = rows.where(F.col("row_no") > first.row_no).select("row_no", normalize_code(F.get("cells", F.lit(start))).alias("code"), F.explode(wide).alias("x"))
    return body.where("code is not null").select("row_no", "code", "x.*").where("url <> ''")


def read_link_sheet(spark: SparkSession, path: str) -> DataFrame:
    return link_cells(read_rows(spark, path))


def child_links(rows: DataFrame, prefix: str, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A strict child sheet of one group -> (links, violations). Any violation means that nothing of it may be used."""
    first = rows.orderBy("row_no").limit(1).select("row_no", F.transform("cells", lambda c: header_name(F.coalesce(c, F.lit("")))).alias("h")).first()
    if first is None or list(first.h)[:2] != ["CODE", "URL"] or any(list(first.h)[2:]):
        raise SheetError("the header must be CODE, URL")
    body = rows.where(F.col("row_no") > first.row_no)
    code = normalize_code(F.get("cells", F.lit(0)))
    out = body.select("row_no", code.alias("code"), F.trim(F.get("cells", F.lit(1))).alias("url"), F.exists(F.slice("cells", 3, F.greatest(F.size("cells"), F.lit(1))), lambda c: c.isNotNull() & (c != "")).alias("wide"))
    target = unwrap_redirect(F.col("url"))
    kind = (
        F.when(F.col("wide"), "width")
        .when(F.col("code").isNull(), "code")
        .when(code_prefix(F.col("code")) != prefix, "prefix")
        .when(target.isNull() | (destination(target) != "drive"), "url")
    )
    bad = out.select("row_no", "code", kind.alias("kind")).where("kind is not null")
    lost = out.join(records.select("code"), "code", "left_anti").where("code is not null").select("row_no", "code", F.lit("unknown").alias("kind"))
    again = out.where("code is not null").groupBy("code").agg(F.count("*").alias("n"), F.max("row_no").alias("row_no")).where("n > 1").select("row_no", "code", F.lit("repeated").alias("kind"))
    return out.select("code", F.lit("").alias("scope"), F.lit("subtitle").alias("provider"), target.alias("url")), bad.unionByName(lost).unionByName(again)


def directory_links(cells: DataFrame, legend: str) -> DataFrame:
    """Landed rich cells (text, color, href, anchor) -> (prefix, url, kind) of cells in the legend's colour.

    ``kind`` is drive (a link), sheet (a child sheet) or opaque (unresolved).
    """
    from recordkeep.functions.urls import normalize_color

    own = cells.where(normalize_color(F.col("color")) == F.lit(legend)).withColumn("prefix", normalize_prefix(collapse(F.col("text"))))
    target = unwrap_redirect(F.col("href"))
    return own.where("prefix is not null and href is not null").select("prefix", target.alias("url"), destination(target).alias("kind"), F.coalesce("anchor", "text").alias("label"))


def repeated_groups(directory: DataFrame) -> DataFrame:
    """Groups that a directory names with more than one target."""
    return directory.groupBy("prefix").agg(F.count_distinct("url").alias("n")).where("n > 1").select("prefix")


def manifest(directory: DataFrame, children: DataFrame) -> DataFrame:
    """Resolved, unresolved and child sources in one table (state, scope, prefix, url)."""
    kinds = directory.select(F.when(F.col("kind") == "drive", "resolved").when(F.col("kind") == "sheet", "child").otherwise("unresolved").alias("state"), F.lit("group").alias("scope"), "prefix", "url")
    own = children.select(F.lit("resolved").alias("state"), F.lit("record").alias("scope"), code_prefix(F.col("code")).alias("prefix"), "url")
    return kinds.unionByName(own)
