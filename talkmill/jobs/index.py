"""The import job: an export merged into the index tables, in memory or in a folder of hashed partitions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from talkmill.operators import merge, normalize
from talkmill.sources.shared import cut

#: Partitions of an index, by the hash of a conversation's uuid, and of a message's uuid.
PARTS = 64
#: Rows of a partition that go to one file, about.
FILE = 100_000
TABLES = ("conversations", "messages", "chunks")
#: The table of what each message uuid belongs to, and that of the versions.
UUIDS, VERSIONS = "uuids", "versions"
VERSION = "version long, batch long, touched int, conversations long, messages long, gained_conversations long, gained_messages long"


def latest(raw: DataFrame) -> DataFrame:
    """Conversations with their ``raw`` row, one for each uuid: of a uuid twice in an export the later by date, then by digest.

    The export is read and parsed once, into a written table. Only the keys are grouped; the raw rows meet the few uuids that stand
    twice.
    """
    own = cut(normalize.conversations(raw.select("raw"), keep_raw=True).withColumn("rank", F.struct("updated_at", "source_sha256", F.sha2("raw", 256).alias("all"))), "parsed")
    twice = own.groupBy(F.col("uuid").alias("twice")).agg(F.max("rank").alias("last"), F.count("*").alias("n")).filter("n > 1")
    met = own.join(twice, F.col("uuid") == F.col("twice"), "left")
    once = met.filter("twice is null")
    last = met.filter(F.col("rank").eqNullSafe(F.col("last")) & F.col("twice").isNotNull()).dropDuplicates(["uuid"])
    return once.unionByName(last).drop("rank", "twice", "last", "n")


def incoming_tables(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations (with ``digest``), messages, and the (conv_uuid, uuid) that the export itself gives (a message without one
    has null, and counts as new)."""
    chosen = cut(latest(raw), "chosen")
    found = normalize.message_texts(normalize.explode_messages(chosen.select("raw")))  # a conversation and place once
    ids = found.select("conv_uuid", normalize.member(F.col("raw"), "uuid").alias("uuid"))
    return chosen.drop("raw").withColumn("digest", F.col("source_sha256")), found, ids


def import_export(raw: DataFrame, conversations: DataFrame, messages: DataFrame, chunks: DataFrame, reimport: bool = False) -> dict[str, DataFrame]:
    """The tables after importing raw conversations (``raw``), the ``report``, and the ``gains``.

    Nothing is deleted; an older copy of a conversation changes nothing, so the order of imports doesn't matter. Of a uuid
    twice in one export the later by date, then by digest, counts, with its own messages only.
    """
    incoming, found, ids = incoming_tables(raw)
    status = merge.import_status(incoming, conversations.withColumn("digest", F.col("source_sha256")), ids, messages.select("conv_uuid", "uuid"), reimport)
    new_messages = merge.rebuild_messages(messages, found.select(*messages.columns), status)
    rebuilt = status.filter(F.col("status").isin(*merge.REBUILT)).select(F.col("uuid").alias("conv_uuid"))
    new_chunks = chunks.join(rebuilt, "conv_uuid", "left_anti").unionByName(normalize.derive_chunks(new_messages.join(rebuilt, "conv_uuid", "left_semi")).select(*chunks.columns))
    new_conversations = merge.upsert_conversations(conversations, status)
    report = merge.import_report(conversations, status)
    gained = merge.gains({"conversations": conversations, "messages": messages}, {"conversations": new_conversations, "messages": new_messages})
    return {"conversations": new_conversations, "messages": new_messages, "chunks": new_chunks, "report": report, "gains": gained}


def part_of(uuid: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(uuid), F.lit(parts).cast("long")).cast("int")


def empty_index(raw: DataFrame) -> dict[str, DataFrame]:
    messages = normalize.message_texts(normalize.explode_messages(raw)).limit(0)
    return {"conversations": normalize.conversations(raw).limit(0), "messages": messages, "chunks": normalize.derive_chunks(messages).limit(0)}


class PartitionedIndex:
    """An index in a folder: each table partitioned by the hash of its conversation, message uuids by their own.

    A merge reads and writes the partitions of the conversations that change, and of their messages' uuids; all other files stay as
    they are. Tables are written after all is decided, conversations last: by their digests a merge that was interrupted
    begins anew and comes to the same result.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts
        self.empty = {t: df.schema for t, df in empty_index(spark.createDataFrame([], "raw string")).items()} | {UUIDS: spark.createDataFrame([], "uuid string, conv_uuid string").schema}

    def exists(self, name: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def table(self, name: str, parts: Iterable[int] | None = None) -> DataFrame:
        """A table, or the given partitions of it."""
        if not self.exists(name):
            return self.spark.createDataFrame([], self.empty[name])
        found = self.spark.read.schema(StructType([*self.empty[name].fields, StructField("part", IntegerType())])).parquet(f"{self.path}/{name}")
        return (found if parts is None else found.filter(F.col("part").isin(sorted(parts)))).drop("part")

    def versions(self) -> DataFrame:
        """A row for each merge: batch, partitions touched, rows of the index and how many more than before."""
        return self.spark.read.schema(VERSION).parquet(f"{self.path}/{VERSIONS}") if self.exists(VERSIONS) else self.spark.createDataFrame([], VERSION)

    def put(self, name: str, rows: DataFrame, touched: set[int], key: str) -> None:
        """Replace the touched partitions of a table; those that have no rows any more go."""
        placed = rows.withColumn("part", part_of(F.col(key), self.parts))
        # a partition of many rows is not one task's
        files = -(-placed.count() // (FILE * max(1, len(touched))))
        dealt = placed.repartition("part", F.pmod(F.xxhash64(F.lit(1), F.col(key)), F.lit(max(1, files)).cast("long")))
        dealt.sortWithinPartitions("part", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.path}/{name}")
        full = {r.part for r in placed.select("part").distinct().collect()}
        for part in touched - full:
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/part={part}")
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def merge(self, raw: DataFrame, batch: int = 0, reimport: bool = False) -> DataFrame:
        """Merge raw conversations; the report (what, n)."""
        incoming, found, ids = incoming_tables(raw)
        found = cut(found, "incoming-messages")
        among = lambda key, rows: {r.part for r in rows.select(part_of(F.col(key), self.parts).alias("part")).distinct().collect()}  # noqa: E731  at most ``parts``
        known = self.table("conversations", among("uuid", incoming)).withColumn("digest", F.col("source_sha256"))
        ids = found.select("conv_uuid", normalize.member(F.col("raw"), "uuid").alias("uuid"))
        old = self.table("messages", among("uuid", incoming))
        status = cut(merge.import_status(incoming, known, ids, old.select("conv_uuid", "uuid"), reimport), "status")
        rebuilt = status.filter(F.col("status").isin(*merge.REBUILT)).select(F.col("uuid").alias("conv_uuid"))
        touched = among("conv_uuid", rebuilt)
        renamed = among("uuid", status.filter("status != 'STALE'"))
        # who holds the uuids that come in
        coming = found.join(rebuilt, "conv_uuid", "left_semi")
        held = self.table(UUIDS, among("uuid", coming))
        own = self.table("messages", touched)
        new = cut(merge.rebuild_messages(own, found.select(*own.columns), status, held), "new-messages")
        owned = new.join(rebuilt, "conv_uuid", "left_semi")
        chunks = self.table("chunks", touched)
        chunks = cut(chunks.join(rebuilt, "conv_uuid", "left_anti").unionByName(normalize.derive_chunks(owned).select(*chunks.columns)), "new-chunks")
        # uuids of the rebuilt conversations, as they were and as they are now
        gone = own.join(rebuilt, "conv_uuid", "left_semi").select("uuid", "conv_uuid")
        places = among("uuid", gone.select("uuid").unionByName(owned.select("uuid")))
        uuids = cut(self.table(UUIDS, places).join(rebuilt, "conv_uuid", "left_anti").select("uuid", "conv_uuid").unionByName(owned.select("uuid", "conv_uuid")), "new-uuids")
        meta = self.table("conversations", renamed)
        changed = cut(merge.upsert_conversations(meta, status), "new-conversations")
        everything = self.table("conversations").select("uuid")
        report = cut(merge.import_report(everything, status), "report")
        before = self.versions().orderBy(F.desc("version"), F.desc("batch")).limit(1).collect()
        if touched:
            self.put(UUIDS, uuids, places, "uuid")
            self.put("messages", new, touched, "conv_uuid")
            self.put("chunks", chunks, touched, "conv_uuid")
        if renamed:
            self.put("conversations", changed, renamed, "uuid")
        # counted from the files' footers, so that a merge that runs again tells the same
        totals = (self.table("conversations").count(), self.table("messages").count())
        then = (before[0].conversations, before[0].messages) if before else (0, 0)
        row = (before[0].version + 1 if before else 0, batch, len(touched), *totals, totals[0] - then[0], totals[1] - then[1])
        self.spark.createDataFrame([row], VERSION).write.mode("append").parquet(f"{self.path}/{VERSIONS}")
        return report
