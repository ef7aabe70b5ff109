"""Reading snapshots, legacy exports, override maps and prior state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordkeep.functions.keys import normalize_code

RECORD = (
    "struct<code:string,number:bigint,title:string,actors:array<string>,releaseDate:string,cover:string,productId:bigint,previewBase:string,previewCount:int,"
    "tagIds:array<bigint>,tagsStatus:string,tagsUpdatedAt:string,tagsSource:string,links:string>"
)
DOCUMENT = f"schemaVersion int, generatedAt string, totals map<string,bigint>, refresh string, resources map<string,string>, series array<struct<code:string,count:bigint,firstReleaseDate:string,latestReleaseDate:string,links:map<string,string>,videos:array<{RECORD}>>>, tags array<struct<id:bigint,group:string,nameJa:string,nameZh:string,count:bigint>>"
#: Providers of the old export, by the names used now.
LEGACY_PROVIDERS = {"st": "streamtape", "gf": "gofile"}


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """One row per snapshot document."""
    return spark.read.schema(DOCUMENT).json(path, multiLine=True)


def flatten(document: DataFrame) -> DataFrame:
    """One row per record, with its group as ``series``; other fields under their own names."""
    groups = document.select(F.explode("series").alias("g"))
    return groups.select(F.col("g.code").alias("series"), F.explode("g.videos").alias("r")).select("series", "r.*")


def group_links(document: DataFrame) -> DataFrame:
    """(prefix, provider, url)."""
    groups = document.select(F.explode("series").alias("g"))
    return groups.select(F.col("g.code").alias("prefix"), F.explode("g.links").alias("provider", "url"))


def record_links(records: DataFrame) -> DataFrame:
    """(code, scope, provider, url) from records whose ``links`` is a two-level JSON map."""
    flat = records.where("links is not null").select("code", F.from_json("links", "map<string,string>").alias("m")).select("code", F.explode("m").alias("k", "v"))
    leaf = lambda scope, provider, url: F.struct(scope.alias("scope"), provider.alias("provider"), url.alias("url"))
    nested = F.transform(F.map_entries(F.from_json("v", "map<string,string>")), lambda e: leaf(F.col("k"), e["key"], e["value"]))
    own = F.when(F.startswith(F.trim("v"), F.lit("{")), nested).otherwise(F.array(leaf(F.lit(""), F.col("k"), F.col("v"))))
    return flat.where("v is not null").select("code", F.explode(own).alias("leaf")).select("code", "leaf.*")


def resources(previous: DataFrame, incoming: DataFrame | None) -> DataFrame:
    """The incoming resource row if there is one, else the previous; never a mixture."""
    if incoming is None:
        return previous
    ranked = incoming.withColumn("_o", F.lit(0)).unionByName(previous.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    return ranked.orderBy("_o").limit(1).drop("_o")


def load_model(records: DataFrame) -> DataFrame:
    """The browse side's view: prefixes in upper case, rows without a code skipped, the first of a code kept."""
    w = Window.partitionBy("code").orderBy("series", "number")
    good = records.where("code is not null and trim(code) <> ''").withColumn("series", F.upper("series"))
    return good.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def stored_tags(from_file: DataFrame | None, snapshot: DataFrame) -> DataFrame:
    """The tag file if there is a valid one, else the snapshot's tags.

    A file is valid if every row has a positive id of its own, a group and a name.
    """
    if from_file is None:
        return snapshot
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    wrong = from_file.where(F.coalesce(F.col("id") <= 0, F.lit(True)) | blank("group") | blank("name")).select("id")
    again = from_file.groupBy("id").count().where("count > 1").select("id")
    return from_file if wrong.unionByName(again).isEmpty() else snapshot


def legacy_records(documents: DataFrame) -> DataFrame:
    """Records of JSON documents (value), each a list or groups of lists; gaps and bad codes drop out."""
    one = "array<map<string,string>>"
    as_list = documents.where(F.startswith(F.trim("value"), F.lit("["))).select(F.explode(F.from_json("value", one)).alias("r"))
    as_groups = documents.where(F.startswith(F.trim("value"), F.lit("{"))).select(F.explode(F.from_json("value", f"map<string,{one}>")).alias("k", "v")).select(F.explode("v").alias("r"))
    rows = as_list.unionByName(as_groups).where("r is not null")
    return rows.select(normalize_code(F.col("r")["code"]).alias("code"), F.col("r")["title"].alias("title"), F.coalesce(F.col("r")["releaseDate"], F.col("r")["date"]).alias("release_date"), F.col("r")["cover"].alias("cover")).where("code is not null")


def legacy_links(documents: DataFrame) -> DataFrame:
    """Links of JSON documents (value) by code and provider, provider names renewed, blanks dropped."""
    names = F.create_map(*[F.lit(x) for pair in LEGACY_PROVIDERS.items() for x in pair])
    pairs = documents.select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("code", "m"))
    links = pairs.select(normalize_code(F.col("code")).alias("code"), F.explode("m").alias("p", "url")).where("code is not null and trim(url) <> ''")
    return links.select("code", F.lit("").alias("scope"), F.coalesce(F.element_at(names, F.col("p")), F.col("p")).alias("provider"), F.trim("url").alias("url"))


def read_legacy(spark: SparkSession, records_path: str, links_path: str) -> tuple[DataFrame, DataFrame]:
    """Records and links of an old export."""
    return legacy_records(spark.read.text(records_path, wholetext=True)), legacy_links(spark.read.text(links_path, wholetext=True))


def override_map(documents: DataFrame) -> DataFrame:
    """(key, value) of flat reviewed maps in JSON (value)."""
    return documents.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def read_override_map(spark: SparkSession, path: str) -> DataFrame:
    return override_map(spark.read.text(path, wholetext=True))


def prior_state(documents: DataFrame) -> DataFrame:
    """(inputs, last_audit) of JSON state (value): a time that cannot be read counts as none."""
    return documents.select(F.from_json(F.get_json_object("value", "$.inputs"), "map<string,string>").alias("inputs"), F.try_to_timestamp(F.get_json_object("value", "$.official.lastAuditAt")).alias("last_audit"))


def read_prior_state(spark: SparkSession, path: str) -> DataFrame:
    return prior_state(spark.read.text(path, wholetext=True))
