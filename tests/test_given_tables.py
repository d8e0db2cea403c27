"""Queries against their SQL on small tables with what the given ones hold at larger sizes only."""

import os
import shutil

import duckdb
import pytest

import __spark_entry__
from talkmill.jobs import queries
from tests.oracle import differences

SF = "/root/testdata/sf0.001"


@pytest.fixture
def same(spark, tmp_path):
    """Whether a query and its SQL agree over the smallest tables with other conversations (conv_id, turn, role, text)."""

    def run(name, rows):
        for table in os.listdir(SF):
            shutil.copyfile(f"{SF}/{table}", tmp_path / table)
        con = duckdb.connect()
        con.execute("create table c (conv_id bigint, turn bigint, role varchar, text varchar)")
        con.executemany("insert into c values (?, ?, ?, ?)", rows)
        (tmp_path / "conversations.parquet").unlink()
        con.execute(f"copy c to '{tmp_path}/conversations.parquet' (format parquet)")
        return differences(spark, str(tmp_path), __spark_entry__.queries()[name], queries.SQL[name])

    return run


def test_texts_keep_line_ends_at_their_ends(same):
    texts = ["x" * 99 + "\nmore", "y" * 98 + " \nmore", "z" * 98 + "  more", "\t w\u00a0", "\u00a0 v\n", "  "]
    told = same("message_texts", [(5, turn, "assistant", t) for turn, t in enumerate(texts)])
    assert told is None, told


def test_or_is_a_word_of_a_search(same):
    opening = {0: "a or c d word f", 1: "or b c or e f", 2: "a b or d e f", 3: "a or or c e f", 4: "a or c d e f", 5: "a word c d or f", 6: "word b or d e f"}
    told = [(conv, 0, "user", t) for conv, t in opening.items()] + [(7, turn, "user", t) for turn, t in enumerate(["word", "or", "or or c", "word OR", "b c", "word or or d", "d or word", "x"])]
    told = same("search_batch", told)
    assert told is None, told


def test_kinds_have_a_row_for_each_item(spark):
    run = __spark_entry__.queries()
    kinds, blocks = run["transcript_kinds"](spark, SF), run["transcript_blocks"](spark, SF)
    columns = ["conv_uuid", "uuid", "kind", "title", "body"]
    assert kinds.select(columns).exceptAll(blocks.select(columns)).isEmpty() and kinds.count() == blocks.count() > 300


def test_a_merge_reads_the_export_once(spark, tmp_path):
    """Each raw row is read once for each merge, however many tables come of it; a uuid twice counts once."""
    from pyspark.sql import functions as F

    from talkmill.jobs.index import PartitionedIndex

    read = spark.sparkContext.accumulator(0)

    def told(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    row = '{"uuid":"%s","name":"%s","updated_at":"2024-01-0%dT00:00:00Z","chat_messages":[{"uuid":"%s-0","content":[{"type":"text","text":"%s"}]}]}'
    rows = [(row % (c, d, d, c, d),) for c, d in (("a", 1), ("a", 2), ("b", 1), ("b", 1))]
    raw = spark.createDataFrame(rows, "raw string").mapInPandas(told, "raw string")
    found = PartitionedIndex(spark, str(tmp_path / "i"), 2)
    assert {(r.what, r.n) for r in found.merge(raw).collect()} == {("new", 2)}
    assert read.value == len(rows)
    assert {(r.uuid, r.text) for r in found.table("messages").select("uuid", F.col("text")).collect()} == {("a-0", "2"), ("b-0", "1")}


def test_vectors_are_read_once_for_all_queries(spark, monkeypatch):
    """Whatever the passes; scores are those of double precision at the limit itself."""
    import numpy as np

    from talkmill.operators import search

    read = spark.sparkContext.accumulator(0)

    def told(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    rng = np.random.default_rng(3)
    own = rng.normal(size=(6, 8))
    own[0], own[1] = [0.6, 0.8, 0, 0, 0, 0, 0, 0], [0.6 - 1e-9, 0.8, 0, 0, 0, 0, 0, 0]
    texts = [(f"t{n}", own[n % 6].tolist()) for n in range(60)]
    vectors = spark.createDataFrame(texts, "text_sha256 string, embedding array<double>").mapInPandas(told, "text_sha256 string, embedding array<double>")
    chunks = spark.createDataFrame([(t, f"c{n % 7}", f"m{n:02}", "human", None) for n, (t, _) in enumerate(texts)], "text_sha256 string, conv_uuid string, msg_uuid string, sender string, created_at timestamp")
    asked = [(1, [1.0] + [0.0] * 7), (2, own[3].tolist()), (3, own[4].tolist())]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<double>")
    monkeypatch.setattr(search, "QUERIES", 1)
    got = {(r.query_id, r.conv_uuid): (r.score, r.msg_uuid) for r in search.semantic_batch(chunks, vectors, queries, {"you"}, least=0.6).collect()}
    assert read.value == len(texts)
    want = {}
    for q, v in asked:
        for n, (_, e) in enumerate(texts):
            s = float(np.dot(v, e) / np.linalg.norm(v) / np.linalg.norm(e))
            if s >= 0.6:
                want[q, f"c{n % 7}"] = max(want.get((q, f"c{n % 7}"), (0, "")), (round(s, 9), f"m{n:02}"))
    assert {k: (round(s, 9), m) for k, (s, m) in got.items()} == want
    assert (1, "c0") in got and got[1, "c0"][1] == "m42"
