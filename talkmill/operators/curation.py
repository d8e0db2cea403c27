"""The curated tags: merging proposals, clearing, manual edits, and the review queue.

``tags`` is (conv_uuid, slug, confidence, method); ``curation`` is (conv_uuid, locked), also of records without a tag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TAG = ["conv_uuid", "slug", "confidence", "method"]


def resolve(proposals: DataFrame) -> DataFrame:
    """One tag for each conversation and slug: of the highest confidence, of the later pass among equals.

    ``proposals`` has a column ``pass`` beside those of tags; what is stored already comes with the smallest one.
    """
    best = proposals.groupBy("conv_uuid", "slug").agg(F.max_by(F.struct("confidence", "method"), F.struct("confidence", "pass")).alias("b"))
    return best.select("conv_uuid", "slug", F.round("b.confidence", 4).alias("confidence"), "b.method")


def locked(curation: DataFrame) -> DataFrame:
    return curation.filter("locked").select("conv_uuid")


def apply_proposals(tags: DataFrame, curation: DataFrame, proposals: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Tags after the proposals (with ``pass`` above 0): unknown slugs are dropped, locked records stay as they are."""
    known = proposals.join(vocabulary.select("slug"), "slug", "left_semi").join(locked(curation), "conv_uuid", "left_anti")
    return resolve(tags.select(*TAG, F.lit(0).alias("pass")).unionByName(known.select(*TAG, "pass")))


def clear_unlocked(tags: DataFrame, curation: DataFrame, methods: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Tags and curation without the tags of these methods (or any) in unlocked records; emptied records go."""
    gone = F.col("method").isin(methods) if methods else F.lit(True)
    held = locked(curation).withColumn("held", F.lit(True))
    kept = tags.join(held, "conv_uuid", "left").filter(F.col("held").isNotNull() | ~gone).select(*TAG)
    own = kept.select("conv_uuid").union(locked(curation)).distinct()
    return kept, curation.join(own, "conv_uuid", "left_semi")


def set_user_tags(tags: DataFrame, curation: DataFrame, edits: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """After manual edits (conv_uuid, slugs, edited_at): the latest edit replaces the tags and locks the record."""
    order = Window.partitionBy("conv_uuid").orderBy(F.desc_nulls_last("edited_at"), "slugs")
    last = edits.withColumn("n", F.row_number().over(order)).filter("n = 1").select("conv_uuid", "slugs")
    new = last.select("conv_uuid", F.explode(F.array_distinct("slugs")).alias("slug")).join(vocabulary.select("slug"), "slug", "left_semi")
    new = new.select("conv_uuid", "slug", F.lit(1.0).alias("confidence"), F.lit("user").alias("method"))
    out = tags.join(last.select("conv_uuid"), "conv_uuid", "left_anti").select(*TAG).unionByName(new)
    return out, curation.join(last, "conv_uuid", "left_anti").select("conv_uuid", "locked").union(last.select("conv_uuid", F.lit(True)))


def method_map(tags: DataFrame) -> DataFrame:
    return tags.groupBy("conv_uuid").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("slug", "method")))).alias("methods"))


def tags_for(tags: DataFrame, curation: DataFrame) -> DataFrame:
    """(conv_uuid, slugs, locked), the slugs sorted."""
    own = tags.groupBy("conv_uuid").agg(F.sort_array(F.collect_set("slug")).alias("slugs"))
    return curation.join(own, "conv_uuid", "left").select("conv_uuid", F.coalesce("slugs", F.array().cast("array<string>")).alias("slugs"), F.coalesce("locked", F.lit(False)).alias("locked"))


def proposal_counts(tags: DataFrame, curation: DataFrame) -> DataFrame:
    """Semantic proposals of each category in unlocked records."""
    return tags.filter("method = 'semantic'").join(locked(curation), "conv_uuid", "left_anti").groupBy("slug").agg(F.count("*").alias("n"))


def proposal_queue(tags: DataFrame, curation: DataFrame) -> DataFrame:
    """(conv_uuid, proposed, others, score) of unlocked records with a semantic tag; callers sort by score."""
    entry = F.struct("slug", F.struct("confidence", "method"))
    semantic = F.col("method") == "semantic"
    pick = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.when(c, entry))))
    return tags.join(locked(curation), "conv_uuid", "left_anti").groupBy("conv_uuid").agg(pick(semantic).alias("proposed"), pick(~semantic).alias("others"), F.max(F.when(semantic, F.col("confidence"))).alias("score")).filter("score is not null")


def review_filter(queue: DataFrame, conversations: DataFrame, slug: str | None = None, start: str | None = None, end: str | None = None, title: str = "") -> DataFrame:
    """The queue by proposed category, by day of creation (both ends included) and by a part of the title."""
    day = F.to_date("created_at")
    out = queue.join(conversations.select(F.col("uuid").alias("conv_uuid"), "name", "created_at"), "conv_uuid")
    if slug:
        out = out.filter(F.array_contains(F.map_keys("proposed"), slug))
    if start:
        out = out.filter(day >= F.lit(start).cast("date"))
    if end:
        out = out.filter(day <= F.lit(end).cast("date"))
    return out.filter(F.instr(F.lower(F.coalesce("name", F.lit(""))), title.lower()) > 0) if title else out
