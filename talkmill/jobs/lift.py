"""The archive model lifted from the tables at hand: one row per message, with trees, dates, vectors and tags."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.functions.text import content_sha256, strip


@dataclass
class Archive:
    """The tables of an archive, as DataFrames that are read only when used."""

    messages: DataFrame
    conversations: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    tags: DataFrame
    curation: DataFrame
    taxonomy: DataFrame


def taxonomy(spark: SparkSession) -> DataFrame:
    windows = {"cat-0": ("2024-01-01", "2024-02-15"), "cat-1": ("2024-01-20", "2024-01-31")}
    rows = [(f"cat-{i}", *windows.get(f"cat-{i}", (None, None)), {"cat-2": 0.12}.get(f"cat-{i}")) for i in range(10)]
    flat = spark.createDataFrame(rows, "slug string, date_start string, date_end string, semantic_threshold double")
    return flat.withColumns({c: F.to_date(c) for c in ("date_start", "date_end")})


def lift(spark: SparkSession, sf_dir: str) -> Archive:
    source = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    parent = F.when(F.col("turn") == 0, None).when((F.col("conv_id") % 10 == 0) & (F.col("turn") == 2), None).when((F.col("turn") >= 2) & ((F.col("conv_id") + F.col("turn")) % 4 == 0), F.col("turn") - 2).otherwise(F.col("turn") - 1)
    conv = F.col("conv_id").cast("string")
    messages = source.select(
        F.concat_ws(":", conv, F.col("turn").cast("string")).alias("uuid"),
        conv.alias("conv_uuid"),
        F.col("turn").cast("int").alias("seq"),
        F.when(parent.isNotNull(), F.concat_ws(":", conv, parent.cast("string"))).alias("parent_uuid"),
        F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("sender"),
        F.when((F.col("conv_id") + F.col("turn")) % 37 != 0, F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(cast(conv_id % 365 as int), 0, cast(turn as int), 0)")).alias("created_at"),
        "text",
        F.when((F.col("conv_id") % 5 == 0) & (F.col("role") == "assistant"), F.substring("text", 1, 100)).alias("tool_text"),
    )
    number = F.col("conv_uuid").cast("int")
    meta = messages.groupBy("conv_uuid").agg(
        F.max(F.when(F.col("seq") == 0, F.substring("text", 1, 60))).alias("name"),
        F.max(F.when(F.col("seq") == 1, F.substring("text", 1, 200))).alias("summary"),
        F.min("created_at").alias("created_at"),
        F.max("created_at").alias("updated_at"),
        F.count("*").cast("int").alias("n_messages"),
    )
    meta = meta.select(F.col("conv_uuid").alias("uuid"), F.when(number % 11 != 0, F.col("name")).alias("name"), F.when(number % 7 != 0, F.col("summary")).alias("summary"), "created_at", "updated_at", "n_messages")
    chunks = messages.filter(F.length(strip(F.col("text"))) >= 12).select(F.col("uuid").alias("msg_uuid"), "conv_uuid", F.lit(0).alias("seq"), "sender", "created_at", "text", content_sha256(F.col("text")).alias("text_sha256"), F.col("seq").alias("turn"))
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    # a subquery: counted only where vectors are used
    size = embeddings.agg(F.greatest(F.count("*"), F.lit(1))).scalar()
    placed = chunks.select("text_sha256", (number * 31 + F.col("turn")).alias("place")).withColumn("place", F.col("place") % size)
    keyed = placed.groupBy("text_sha256").agg(F.min("place").cast("bigint").alias("vec_id"))
    vectors = keyed.join(embeddings, "vec_id").select("text_sha256", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    first = chunks.filter("turn = 0").join(vectors, "text_sha256").select("conv_uuid", F.concat(F.lit("cat-"), F.col("label").cast("string")).alias("slug"), (number % 5).alias("kind"))
    tags = first.filter("kind < 4").select(
        "conv_uuid",
        "slug",
        F.element_at(F.array(F.lit(0.9), F.lit(0.78), F.lit(1.0), F.lit(0.7)), F.col("kind") + 1).alias("confidence"),
        F.element_at(F.array(F.lit("keyword"), F.lit("topic"), F.lit("user"), F.lit("keyword-purpose")), F.col("kind") + 1).alias("method"),
    )
    curation = tags.select("conv_uuid", (F.col("method") == "user").alias("locked"))
    return Archive(messages, meta, chunks.drop("turn"), vectors.drop("label"), tags, curation, taxonomy(spark))


#: The same lift in SQL, as common table expressions.
LIFT_SQL = """
with recursive messages as (
  select concat(cast(conv_id as varchar), ':', cast(turn as varchar)) as uuid, cast(conv_id as varchar) as conv_uuid, cast(turn as int) as seq,
    case when turn = 0 then null when conv_id % 10 = 0 and turn = 2 then null
      when turn >= 2 and (conv_id + turn) % 4 = 0 then concat(cast(conv_id as varchar), ':', cast(turn - 2 as varchar))
      else concat(cast(conv_id as varchar), ':', cast(turn - 1 as varchar)) end as parent_uuid,
    case when role = 'user' then 'human' else role end as sender,
    case when (conv_id + turn) % 37 = 0 then null else timestamp '2024-01-01 00:00:00' + interval 1 day * cast(conv_id % 365 as int) + interval 1 minute * cast(turn as int) end as created_at,
    text, case when conv_id % 5 = 0 and role = 'assistant' then substr(text, 1, 100) end as tool_text
  from conversations),
convs as (
  select conv_uuid as uuid, case when cast(conv_uuid as int) % 11 = 0 then null else max(case when seq = 0 then substr(text, 1, 60) end) end as name,
    case when cast(conv_uuid as int) % 7 = 0 then null else max(case when seq = 1 then substr(text, 1, 200) end) end as summary,
    min(created_at) as created_at, max(created_at) as updated_at, cast(count(*) as int) as n_messages
  from messages group by conv_uuid),
chunks as (select uuid as msg_uuid, conv_uuid, seq as turn, sender, created_at, text, sha256(text) as text_sha256 from messages where length(trim(text)) >= 12),
vectors as (
  select k.text_sha256, list_transform(e.embedding, lambda x: cast(x as double)) as embedding, e.label
  from (select text_sha256, min((cast(conv_uuid as int) * 31 + turn) % (select count(*) from embeddings)) as vec_id from chunks group by text_sha256) k join embeddings e using (vec_id)),
tags as (
  select conv_uuid, 'cat-' || label as slug, [0.9, 0.78, 1.0, 0.7][cast(conv_uuid as int) % 5 + 1]::double as confidence,
    ['keyword', 'topic', 'user', 'keyword-purpose'][cast(conv_uuid as int) % 5 + 1] as method
  from chunks join vectors using (text_sha256) where turn = 0 and cast(conv_uuid as int) % 5 < 4),
taxonomy as (
  select 'cat-' || i as slug, case i when 0 then date '2024-01-01' when 1 then date '2024-01-20' end as date_start,
    case i when 0 then date '2024-02-15' when 1 then date '2024-01-31' end as date_end, case i when 2 then 0.12 end::double as semantic_threshold
  from range(10) r(i))
"""
