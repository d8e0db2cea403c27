"""Browsing: filters, sorts, pages, facets and counts of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Sort orders of hits and of browsed conversations, as columns and whether they descend; nulls come last in all of them, and
#: every order ends in the key, so that pages are stable.
HIT_SORTS = {"best": [("score", True), ("updated_at", True)], "newest": [("created_at", True)], "oldest": [("created_at", False)], "title": [("name", False)]}
BROWSE_SORTS = {"recent": [("updated_at", True)], "created": [("created_at", True)], "oldest": [("created_at", False)], "title": [("name", False)], "messages": [("n_messages", True)]}


def order_of(columns: list[tuple[str, bool]], key: str) -> list[Column]:
    return [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in columns] + [F.asc(key)]


def sorted_page(df: DataFrame, orders: dict, sort: str, fallback: str, key: str, limit: int, offset: int = 0) -> DataFrame:
    """One page; Spark keeps only the best ``offset + limit`` rows of each partition. An unknown sort falls back."""
    return df.orderBy(*order_of(orders.get(sort, orders[fallback]), key)).offset(offset).limit(limit)


def beyond(columns: list[tuple[str, bool]], key: str, cursor: Row) -> Column:
    """Whether a row comes after the cursor, a row with the values of the sort's columns and the key."""
    after, same = F.lit(False), F.lit(True)
    for name, down in columns:
        value = cursor[name]
        # nothing but nulls comes after a null
        if value is not None:
            later = F.col(name) < F.lit(value) if down else F.col(name) > F.lit(value)
            after = after | (same & (F.coalesce(later, F.lit(False)) | F.col(name).isNull()))
        same = same & F.col(name).eqNullSafe(F.lit(value))
    return after | (same & (F.col(key) > F.lit(cursor[key])))


def page_after(df: DataFrame, orders: dict, sort: str, fallback: str, key: str, limit: int, cursor: Row | None = None) -> DataFrame:
    """The page that follows the ``cursor``, the last row of the page before; the first page without one.

    However far a page lies, each partition keeps ``limit`` rows only. Keys must not be null.
    """
    columns = orders.get(sort, orders[fallback])
    rows = df if cursor is None else df.filter(beyond(columns, key, cursor))
    return rows.orderBy(*order_of(columns, key)).limit(limit)


def date_window(ts: Column, start: str | None, end: str | None) -> Column:
    """From ``start`` to ``end``, both days included; a null timestamp is outside of any bounded window."""
    inside = F.lit(True)
    if start:
        inside = inside & (ts >= F.lit(start).cast("date"))
    if end:
        inside = inside & (ts < F.date_add(F.lit(end).cast("date"), 1))
    return inside if not (start or end) else F.coalesce(inside, F.lit(False))


def sender_scope(fields: set[str]) -> Column | None:
    """The predicate for 'you' and 'assistant': both together filter nothing, neither means no prose (None)."""
    if {"you", "assistant"} <= fields:
        return F.lit(True)
    if "you" in fields:
        return F.col("sender") == "human"
    return F.col("sender") == "assistant" if "assistant" in fields else None


def with_categories(conversations: DataFrame, tags: DataFrame) -> DataFrame:
    """Conversations with their sorted tags; an empty array without any, tags of unknown conversations ignored."""
    own = tags.groupBy(F.col("conv_uuid").alias("uuid")).agg(F.sort_array(F.collect_set("slug")).alias("categories"))
    return conversations.join(own, "uuid", "left").withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))


def browse_filter(conversations: DataFrame, messages: DataFrame, category: str | None = None, untagged: bool = False, start: str | None = None, end: str | None = None) -> DataFrame:
    """By category, or without any; by whether a message lies in the date window."""
    if untagged:
        conversations = conversations.filter(F.size("categories") == 0)
    elif category:
        conversations = conversations.filter(F.array_contains("categories", category))
    if start or end:
        inside = messages.filter(date_window(F.col("created_at"), start, end)).select(F.col("conv_uuid").alias("uuid"))
        conversations = conversations.join(inside, "uuid", "left_semi")
    return conversations


def facets(conversations: DataFrame) -> DataFrame:
    """Conversations of each category; those without any under null."""
    return conversations.select(F.explode_outer("categories").alias("slug")).groupBy("slug").agg(F.count("*").alias("n"))


def index_stats(conversations: DataFrame, messages: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Five counts, as (name, n)."""
    told = chunks.join(vectors.select("text_sha256"), "text_sha256", "left_semi")
    parts = {"conversations": conversations, "messages": messages, "chunks": chunks, "chunks_with_vector": told, "vectors": vectors}
    out = None
    for name, df in parts.items():
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.union(n)
    return out


def lookup(conversations: DataFrame, keys: DataFrame) -> DataFrame:
    return conversations.join(keys, "uuid", "left_semi")
