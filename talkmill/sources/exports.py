"""Reading export archives, and the curation store.

Zips are read member by member as streams (``archives``); their conversations are dealt out right after. JSON Lines are read by
Spark itself, as are bare JSON arrays, each of which is one value of at most 2 GB. What is no export raises a ValueError, or
Spark's error, that says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.sources.archives import read_archives

CURATION = "struct<version:int,conversations:map<string,struct<locked:boolean,tags:map<string,struct<confidence:double,method:string>>>>>"


def read_export(spark: SparkSession, path: str, partitions: int = 64) -> DataFrame:
    """(raw): a row for each conversation of zips (``*.zip``), JSON Lines (``*.jsonl``) or JSON arrays."""
    if path.endswith(".zip"):
        return read_archives(spark, path, "conversations").select("raw").repartition(partitions)
    if path.endswith(".jsonl"):
        return spark.read.text(path).select(F.col("value").alias("raw")).filter("raw != ''")
    whole = spark.read.text(path, wholetext=True)
    found = F.from_json("value", "array<string>")
    wrong = F.raise_error(F.lit(f"{path}: no export, since it holds no JSON array of conversations")).cast("array<string>")
    return whole.select(F.explode(F.when(found.isNotNull() & F.ltrim(F.regexp_replace("value", r"^\s+", "")).startswith("["), found).otherwise(wrong)).alias("raw"))


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(kind, uuid, raw) of the side files of zips: ``dir/x.json`` is (dir, x), ``k.json`` is (k, '')."""
    return read_archives(spark, path, "files").select("kind", "uuid", "raw")


def read_curation(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tags and curation of the store's JSON (``value``); missing members have their defaults."""
    records = text.select(F.explode(F.from_json("value", CURATION)["conversations"]).alias("conv_uuid", "r"))
    curation = records.select("conv_uuid", F.coalesce("r.locked", F.lit(False)).alias("locked"))
    tags = records.select("conv_uuid", F.explode("r.tags").alias("slug", "t")).select("conv_uuid", "slug", F.coalesce("t.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("t.method", F.lit("")).alias("method"))
    return tags, curation


def curation_records(tags: DataFrame, curation: DataFrame) -> DataFrame:
    """(conv_uuid, value): the JSON of each record, a line each; the inverse of ``read_curation`` record by record."""
    entry = F.struct(F.col("slug").alias("key"), F.struct("confidence", "method").alias("value"))
    own = tags.groupBy("conv_uuid").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("tags"))
    rows = curation.join(own, "conv_uuid", "left")
    return rows.select("conv_uuid", F.to_json(F.struct(F.lit(1).alias("version"), F.create_map("conv_uuid", F.struct("locked", "tags")).alias("conversations"))).alias("value"))


def write_index(tables: dict[str, DataFrame], path: str, partitions: int = 64) -> None:
    """The tables as Parquet; those with ``conv_uuid`` are clustered by it, so later joins on it read less."""
    for name, df in tables.items():
        out = df.repartition(partitions, "conv_uuid").sortWithinPartitions("conv_uuid") if "conv_uuid" in df.columns else df
        out.write.mode("overwrite").parquet(f"{path}/{name}")
