"""Merging a later export into the index: what is new, grown, changed, unchanged or stale, and the tables after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REBUILT = ("NEW", "GREW", "CHANGED")


def import_status(incoming: DataFrame, indexed: DataFrame, incoming_ids: DataFrame, known_ids: DataFrame, reimport: bool = False) -> DataFrame:
    """``incoming`` with ``status``, by uuid, updated_at and digest.

    STALE: known, and older than what is indexed. NEW: not known. UNCHANGED: equal digest. GREW: holds a message uuid
    (conv_uuid, uuid; null where the export gives none) that isn't known. Else CHANGED.
    """
    known = indexed.select("uuid", F.col("updated_at").alias("known_at"), F.col("digest").alias("known_digest"), F.lit(True).alias("known"))
    fresh = incoming_ids.join(known_ids.select("conv_uuid", "uuid"), ["conv_uuid", "uuid"], "left_anti").select(F.col("conv_uuid").alias("uuid"), F.lit(True).alias("fresh")).distinct()
    both = incoming.join(known, "uuid", "left").join(fresh, "uuid", "left")
    same = F.lit(not reimport) & F.col("digest").eqNullSafe(F.col("known_digest"))
    status = F.when(F.col("known").isNotNull() & (F.col("updated_at") < F.col("known_at")), "STALE").when(F.col("known").isNull(), "NEW").when(same, "UNCHANGED").when(F.col("fresh").isNotNull(), "GREW").otherwise("CHANGED")
    return both.withColumn("status", status).drop("known", "known_at", "known_digest", "fresh")


def upsert_conversations(indexed: DataFrame, status: DataFrame) -> DataFrame:
    """Metadata after the merge: the incoming row unless it is STALE; nothing is deleted. Columns are those of indexed."""
    columns = indexed.columns
    new = status.filter("status != 'STALE'").select(*columns, F.lit(1).alias("order"))
    rows = indexed.select(*columns, F.lit(0).alias("order")).unionByName(new)
    last = Window.partitionBy("uuid").orderBy(F.desc("order"), F.desc_nulls_last("updated_at"))
    return rows.withColumn("n", F.row_number().over(last)).filter("n = 1").select(*columns)


def won(incoming: DataFrame, status: DataFrame, held: DataFrame) -> DataFrame:
    """The messages of rebuilt conversations that stay in the import.

    A message uuid that another conversation holds (uuid, conv_uuid), which isn't rebuilt itself, stays with it; within the
    import the first by conversation and position wins.
    """
    rebuilt = status.filter(F.col("status").isin(*REBUILT)).select(F.col("uuid").alias("conv_uuid")).distinct()
    taken = held.join(rebuilt, "conv_uuid", "left_anti").select("uuid")
    new = incoming.join(rebuilt, "conv_uuid", "left_semi").join(taken, "uuid", "left_anti")
    first = Window.partitionBy("uuid").orderBy("conv_uuid", "seq")
    return new.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")


def rebuild_messages(messages: DataFrame, incoming: DataFrame, status: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Messages after the merge: rebuilt conversations have the incoming ones, the others keep theirs.

    ``held`` (uuid, conv_uuid) are the messages of all conversations, where ``messages`` are a part of them only.
    """
    rebuilt = status.filter(F.col("status").isin(*REBUILT)).select(F.col("uuid").alias("conv_uuid")).distinct()
    kept = messages.join(rebuilt, "conv_uuid", "left_anti")
    new = won(incoming, status, messages.select("uuid", "conv_uuid") if held is None else held)
    return kept.select(*messages.columns).unionByName(new.select(*messages.columns))


def import_report(before: DataFrame, status: DataFrame) -> DataFrame:
    """(what, n): conversations by status, and those of the index that the export lacks."""
    untouched = before.join(status.select("uuid"), "uuid", "left_anti").select(F.lit("untouched").alias("what"))
    return status.select(F.lower("status").alias("what")).unionByName(untouched).groupBy("what").agg(F.count("*").alias("n"))


def gains(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(what, n, gained): how many conversations and messages there are, and how many more than before."""
    rows = [t.select(F.lit(name).alias("what"), F.lit(n).alias("side")) for n, tables in enumerate((before, after)) for name, t in tables.items()]
    told = rows[0]
    for more in rows[1:]:
        told = told.unionByName(more)
    n = F.coalesce(F.sum("side"), F.lit(0))
    # a table without rows on either side has no line
    return told.groupBy("what").agg(n.alias("n"), (2 * n - F.count("*")).alias("gained"))


def set_difference(exported: DataFrame, before: DataFrame) -> DataFrame:
    """(uuid, side): added, present in both, or only indexed."""
    a, b = exported.select("uuid").distinct(), before.select("uuid").distinct()
    return a.join(b, "uuid", "left_anti").select("uuid", F.lit("added").alias("side")).union(a.join(b, "uuid", "left_semi").select("uuid", F.lit("present"))).union(b.join(a, "uuid", "left_anti").select("uuid", F.lit("untouched")))


def upsert_artifacts(stored: DataFrame, loaded: DataFrame) -> DataFrame:
    """Side files (kind, uuid, raw) after a load: the loaded one replaces the stored one of its key."""
    rows = stored.select("kind", "uuid", "raw", F.lit(0).alias("load")).unionByName(loaded.select("kind", "uuid", "raw", F.lit(1).alias("load")))
    return rows.groupBy("kind", "uuid").agg(F.max_by("raw", F.struct("load", "raw")).alias("raw"))
