"""Single rules on rows made by hand."""

import datetime as dt
import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkmill.functions.chunk import chunk_text, chunked
from talkmill.functions.text import cosine, l2_normalize, parse_ts, strip, word_pattern
from talkmill.jobs.index import import_export
from talkmill.operators import classify, curation, merge, normalize, search, semantic, transcript, tree
from talkmill.functions.english import stem
from talkmill.sources import exports


@pytest.mark.parametrize(
    "text, chunks",
    [("aaaa bbbb cccc", ["aaaa bbbb", "cccc"]), ("abcdefghijklm", ["abcdefghij", "klm"]), ("ab cdefghijklm", ["ab cdefghi", "jklm"]), ("abcde fghijk", ["abcde", "fghijk"]), ("  ", []), (None, [])],
)
def test_chunks(spark, text, chunks):
    assert chunk_text(text, 10) == chunks
    df = spark.createDataFrame([(text,)], "t string").select(chunked(F.col("t"), 10).alias("c"))
    assert (df.first().c or []) == chunks


def test_timestamps(spark):
    rows = spark.createDataFrame([("2024-01-05T10:00:00Z",), ("2024-01-05T10:00:00+02:00",), ("",), ("nope",), (None,)], "t string")
    assert [r.x for r in rows.select(F.date_format(parse_ts(F.col("t")), "HH:mm").alias("x")).collect()] == ["10:00", "08:00", None, None, None]


def test_websearch():
    q = search.parse_websearch('one "two three" or four -five or')
    assert q.clauses == [[["one"]], [["two", "three"], ["four"]]] and q.without == [["five"]]


def test_seed_patterns(spark):
    rows = spark.createDataFrame([("C++ code",), ("dé",), ("a d b",), ("D",)], "t string")
    assert [r.x for r in rows.select(F.col("t").rlike(word_pattern(["C++"])).alias("x")).collect()] == [False] * 4
    assert [r.x for r in rows.select(F.col("t").rlike(word_pattern(["d"])).alias("x")).collect()] == [False, False, True, True]
    assert word_pattern([]) is None


def test_strip_and_vectors(spark):
    df = spark.createDataFrame([("  a b \n", [3.0, 4.0], [0.0, 0.0])], "t string, v array<double>, z array<double>")
    r = df.select(strip(F.col("t")).alias("t"), l2_normalize(F.col("v")).alias("v"), l2_normalize(F.col("z")).alias("z"), cosine(F.col("v"), F.col("z")).alias("c")).first()
    assert (r.t, r.v, r.z, r.c) == ("a b", [0.6, 0.8], [0.0, 0.0], None)


def raw(uuid, messages, **more):
    return (json.dumps({"uuid": uuid, "name": "", "created_at": "2024-01-01T00:00:00Z", "updated_at": "2024-01-02T00:00:00Z", "chat_messages": messages} | more, ensure_ascii=False),)


CASES = {
    "two texts": ({"content": [{"type": "text", "text": "a"}, {"type": "thinking", "text": "t"}, {"type": "text", "text": "b"}]}, "a\nb", None),
    "odd blocks": ({"content": ["x", 5, {"type": "text", "text": "hi"}]}, "hi", None),
    "call": ({"content": [{"type": "tool_use", "name": "search", "input": {"q": "é: ,x"}}]}, "", 'search\n{"q": "é: ,x"}'),
    "result": ({"content": [{"type": "tool_result", "content": [{"title": "t", "text": "x", "url": "u", "metadata": {"site_name": "s"}}]}]}, "", "t\nx\ns"),
    "result address": ({"content": [{"type": "tool_result", "content": [{"text": "x", "url": "u"}, "plain"]}]}, "", "x\nu\nplain"),
    "result text": ({"content": [{"type": "tool_result", "content": "[1, 2]"}]}, "", "[1, 2]"),
    "upload": ({"content": [{"type": "tool_use", "id": "i", "name": "view", "input": {"path": "/mnt/user-data/uploads/a.txt"}}, {"type": "tool_result", "tool_use_id": "i", "content": "  1\tfoo\n  2\tbar"}]}, "[uploaded file: a.txt]\nfoo\nbar", 'view\n{"path": "/mnt/user-data/uploads/a.txt"}'),
    "attachments": ({"attachments": [{"file_type": "TXT", "file_name": "q", "extracted_content": "p"}, {"file_name": "x.py", "extracted_content": "c"}, {"extracted_content": " "}]}, "[attachment: q]\np", "[attachment: x.py]\nc"),
    "flat": ({"text": " hello "}, "hello", None),
    "nothing": ({}, "", None),
}


def test_message_texts(spark):
    rows = spark.createDataFrame([raw(k, [m]) for k, (m, _, _) in CASES.items()], "raw string")
    got = {r.conv_uuid: (r.text, r.tool_text) for r in normalize.message_texts(normalize.explode_messages(rows)).collect()}
    assert got == {k: (t, tool) for k, (_, t, tool) in CASES.items()}


def test_conversations_and_rejects(spark):
    rows = spark.createDataFrame([raw("c1", None), raw("c2", [{"uuid": ""}, {"sender": "human", "parent_message_uuid": "00000000-0000-4000-8000-000000000000"}]), ("{}",), ("no json",)], "raw string")
    got = {r.uuid: (r.n_messages, r.name) for r in normalize.conversations(rows).collect()}
    assert got == {"c1": (0, None), "c2": (2, None)}
    assert normalize.rejected(rows).count() == 2
    assert [(r.uuid, r.parent_uuid) for r in normalize.explode_messages(rows).orderBy("seq").collect()] == [("c2:0", None), ("c2:1", None)]


def test_zip_reader(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/conversations.json", json.dumps([{"uuid": "c"}, {"uuid": "d"}]))
        z.writestr("users.json", "[1]")
        z.writestr("projects/p1.json", "{}")
        z.writestr("bad.json", "{")
        z.writestr("a.txt", "x")
    path = str(tmp_path / "*.zip")
    assert sorted(r.raw for r in exports.read_export(spark, path).collect()) == ['{"uuid":"c"}', '{"uuid":"d"}']
    assert sorted((r.kind, r.uuid, r.raw) for r in exports.read_artifacts(spark, path).collect()) == [("projects", "p1", "{}"), ("users", "", "[1]")]
    (tmp_path / "c.json").write_text('[{"uuid":"e"}]')
    assert [r.raw for r in exports.read_export(spark, str(tmp_path / "c.json")).collect()] == ['{"uuid":"e"}']


def test_curation_store(spark):
    text = '{"version":1,"conversations":{"a":{"locked":true,"tags":{"s":{"confidence":0.5,"method":"m"}}},"b":{}}}'
    tags, cur = exports.read_curation(spark.createDataFrame([(text,)], "value string"))
    assert [tuple(r) for r in tags.collect()] == [("a", "s", 0.5, "m")]
    assert sorted(tuple(r) for r in cur.collect()) == [("a", True), ("b", False)]
    again, _ = exports.read_curation(exports.curation_records(tags, cur).select("value"))
    assert [tuple(r) for r in again.collect()] == [("a", "s", 0.5, "m")]


T = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)]


@pytest.mark.parametrize(
    "known, new, ids, known_ids, again, status",
    [
        (None, (T[0], "d"), ["m1"], [], False, "NEW"),
        ((T[1], "d"), (T[0], "e"), ["m2"], ["m1"], False, "STALE"),
        ((T[0], "d"), (T[1], "d"), ["m1"], ["m1"], False, "UNCHANGED"),
        ((T[0], "d"), (T[1], "e"), ["m1", "m2"], ["m1"], False, "GREW"),
        ((T[0], "d"), (T[1], "e"), ["m1"], ["m1"], False, "CHANGED"),
        ((T[0], "d"), (T[0], "d"), ["m1"], ["m1"], True, "CHANGED"),
        ((T[0], "d"), (T[1], "e"), [None], ["c:0"], False, "GREW"),
        ((None, "d"), (T[1], "e"), ["m1"], ["m1"], False, "CHANGED"),
    ],
)
def test_import_status(spark, known, new, ids, known_ids, again, status):
    schema = "uuid string, updated_at timestamp, digest string"
    indexed = spark.createDataFrame([("c", *known)] if known else [], schema)
    found = merge.import_status(spark.createDataFrame([("c", *new)], schema), indexed, spark.createDataFrame([("c", i) for i in ids], "conv_uuid string, uuid string"), spark.createDataFrame([("c", i) for i in known_ids], "conv_uuid string, uuid string"), again)
    assert found.first().status == status


def test_import_twice_changes_nothing(spark):
    rows = spark.createDataFrame([raw("c1", [{"uuid": "m1", "text": "hello there, you"}]), raw("c2", [{"uuid": "m2", "text": "something long enough"}])], "raw string").cache()
    meta, messages = normalize.conversations(rows), normalize.message_texts(normalize.explode_messages(rows))
    empty = (meta.limit(0), messages.limit(0), normalize.derive_chunks(messages).limit(0))
    once = import_export(rows, *empty)
    assert {r.what: r.n for r in once["report"].collect()} == {"new": 2}
    twice = import_export(rows, once["conversations"], once["messages"], once["chunks"])
    assert {r.what: r.n for r in twice["report"].collect()} == {"unchanged": 2}
    assert sorted(map(tuple, twice["messages"].collect())) == sorted(map(tuple, once["messages"].collect()))
    assert twice["chunks"].count() == 2


def tags(spark, rows):
    return spark.createDataFrame(rows, "conv_uuid string, slug string, confidence double, method string")


def test_tag_merge(spark):
    vocabulary = spark.createDataFrame([("s",)], "slug string")
    cur = spark.createDataFrame([("a", False), ("l", True), ("t", False)], "conv_uuid string, locked boolean")
    proposals = spark.createDataFrame([("a", "s", 0.7, "keyword-purpose", 2), ("a", "s", 0.75, "keyword", 3), ("l", "s", 0.9, "keyword", 1), ("t", "s", 0.75, "keyword", 3), ("a", "unknown", 1.0, "keyword", 1)], "conv_uuid string, slug string, confidence double, method string, pass int")
    out = curation.apply_proposals(tags(spark, [("t", "s", 0.78, "topic")]), cur, proposals, vocabulary)
    assert sorted(map(tuple, out.collect())) == [("a", "s", 0.75, "keyword"), ("t", "s", 0.78, "topic")]


def test_deep_chain_and_cycle(spark):
    n = 3000
    rows = [("c", f"m{i}", f"m{i - 1}" if i else None, None, i) for i in range(n)] + [("x", "a", "b", None, 0), ("x", "b", "a", None, 1)]
    df = spark.createDataFrame(rows, "conv_uuid string, uuid string, parent_uuid string, created_at timestamp, seq int").withColumn("text", F.lit(""))
    paths = tree.default_paths(df).groupBy("conv_uuid", "leaf").count().collect()
    assert sorted(((r.conv_uuid, r.leaf, r["count"]) for r in paths), key=str) == [("c", f"m{n - 1}", n), ("x", None, 2)]
    assert tree.newest_leaf_per_node(df).filter(f"leaf = 'm{n - 1}'").count() == n


def test_split_group_takes_the_narrow_window(spark):
    scores = spark.createDataFrame([("c", "A", 0.7), ("c", "B", 0.6), ("d", "A", 0.59996)], "conv_uuid string, slug string, sim double")
    convs = spark.createDataFrame([("c", T[0]), ("d", T[1])], "uuid string, created_at timestamp")
    kinds = spark.createDataFrame([("A", dt.date(2023, 12, 1), dt.date(2024, 1, 15), None), ("B", dt.date(2023, 12, 31), dt.date(2024, 1, 1), None)], "slug string, date_start date, date_end date, semantic_threshold double")
    out = classify.semantic_decisions(scores, convs, kinds, [["A", "B"]])
    assert sorted(map(tuple, out.collect())) == [("c", "B", 0.7), ("d", "A", 0.6)]
    assert classify.semantic_proposals(out, kinds).count() == 2


def test_backfill_is_idempotent(spark):
    chunks = spark.createDataFrame([("h1", "text one"), ("h1", "text one"), ("h2", "two")], "text_sha256 string, text string")
    vectors = spark.createDataFrame([], "text_sha256 string, embedding array<double>")
    model = lambda texts: np.array([[len(t), 1.0] for t in texts])
    once = semantic.backfill(chunks, vectors, model).cache()
    assert once.count() == 2 and semantic.backfill(chunks, once, model).count() == 2
    assert once.select(F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 6).alias("n")).distinct().collect()[0].n == 1.0


def test_transcript_parts(spark):
    rows = spark.createDataFrame([raw("c", [{"uuid": "m", "content": [{"type": "image"}, {"type": "tool_use", "name": "n", "message": "go"}, {"type": "text", "text": "hi"}], "attachments": [{"file_size": 2048, "extracted_content": "x"}], "files": ["a.png", {"name": "b"}]}])], "raw string")
    messages = normalize.explode_messages(rows)
    assert [(r.kind, r.title, r.note, [x.body for x in r["items"]]) for r in transcript.blocks(messages).orderBy("pos").collect()] == [("call", "n", "go", []), ("text", None, None, ["hi"])]
    assert sorted((r["name"], r["size"]) for r in transcript.attachments(messages).collect() if r["size"]) == [("document", "2.0 KB")]
    assert transcript.attachments(messages).count() == 3


def shown_blocks(spark, content, **message):
    rows = spark.createDataFrame([raw("c", [{"uuid": "m", "content": content, **message}])], "raw string")
    return [(r.kind, r.title, r.note, [tuple(x) for x in r["items"]]) for r in transcript.blocks(normalize.explode_messages(rows)).orderBy("pos").collect()]


def test_display_blocks(spark):
    text = lambda x: ("text", x, None, None)
    call = {"type": "tool_use", "id": "t9", "name": "bash", "message": "runs", "input": {"cmd": "ls, a", "n": 2}}
    assert shown_blocks(spark, [call]) == [("call", "bash", "runs", [("json", '{"cmd": "ls, a", "n": 2}', None, None)])]
    assert shown_blocks(spark, [{"type": "tool_use"}]) == [("call", "tool", None, [])]
    long = "x" * 5000
    assert shown_blocks(spark, [{"type": "tool_result", "tool_use_id": "t9", "content": long}]) == [("result", "result", None, [text(long)])]
    listed = [{"type": "text", "text": long}, "plain", {"type": "knowledge", "title": "T", "url": "http://a", "metadata": {"site_domain": "a"}}, {"url": "http://b"}, {"type": "image", "data": "y" * 5000}]
    kind, title, note, items = shown_blocks(spark, [{"type": "tool_result", "name": "web", "tool_use_id": "t9", "content": listed}])[0]
    assert (kind, title, note) == ("result", "web", None)
    assert items[:4] == [text(long), text("plain"), ("link", "T", "http://a", "a"), ("link", "http://b", "http://b", "")]
    assert items[4][0] == "json" and len(items[4][1]) == 4000 and items[4][1].startswith('{"type": "image", "data": "yyy')
    assert shown_blocks(spark, [{"type": "tool_result", "content": '["a text"]'}]) == [("result", "result", None, [text('["a text"]')])]
    assert shown_blocks(spark, [{"type": "tool_result", "content": {"text": "one"}}, {"type": "tool_result"}]) == [("result", "result", None, [text("one")]), ("result", "result", None, [])]
    assert shown_blocks(spark, [{"type": "flag", "flag": "f"}]) == [("other", "flag", None, [("json", '{"type": "flag", "flag": "f"}', None, None)])]
    assert shown_blocks(spark, [{"type": "image"}, "no object", {"type": "token_budget"}], text="flat") == [("text", None, None, [text("flat")])]
    assert shown_blocks(spark, [{"type": "thinking", "text": "hm"}, {"type": "text", "text": ""}]) == [("thinking", None, None, [text("hm")])]


def test_zip_that_is_no_list_raises(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("conversations.json", "{}")
    (tmp_path / "a.zip").write_bytes(buffer.getvalue())
    with pytest.raises(Exception, match="not a list"):
        exports.read_export(spark, str(tmp_path / "a.zip")).collect()


def files_of(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_exports_that_arrive_in_a_folder(spark, tmp_path):
    from talkmill.jobs.index import PartitionedIndex
    from talkmill.streaming.watch import watch

    drop, index, state = tmp_path / "drop", tmp_path / "index", str(tmp_path / "state")
    drop.mkdir()
    first = [raw(f"c{i}", [{"uuid": f"m{i}", "text": f"hello there, number {i}"}], updated_at="2024-01-02T00:00:00Z")[0] for i in range(12)]
    grown = raw("c3", [{"uuid": "m3", "text": "hello there, number 3"}, {"uuid": "m3b", "text": "one more message"}], updated_at="2024-01-03T00:00:00Z")[0]
    older = raw("c4", [{"uuid": "m4", "text": "what it was before"}], updated_at="2024-01-01T00:00:00Z")[0]
    (drop / "0.jsonl").write_text("\n".join(first) + "\n")
    watch(spark, str(drop), str(index), state, 8).awaitTermination()
    before = files_of(index)
    (drop / "1.jsonl").write_text(f"{grown}\n{older}\n")
    watch(spark, str(drop), str(index), state, 8).awaitTermination()
    found = PartitionedIndex(spark, str(index), 8)
    assert sorted(r.text for r in found.table("chunks").collect()) == sorted([f"hello there, number {i}" for i in range(12)] + ["one more message"])
    versions = [(r.version, r.batch, r.conversations, r.messages, r.gained_conversations, r.gained_messages) for r in found.versions().orderBy("version").collect()]
    assert versions == [(0, 0, 12, 12, 12, 12), (1, 1, 12, 13, 0, 1)]
    # only the partition of the conversation that grew, and those of its messages' uuids, have other files
    after = files_of(index)
    part = lambda uuid: spark.range(1).select(F.pmod(F.xxhash64(F.lit(uuid)), F.lit(8)).alias("p")).first().p
    changed = {f.split("/")[0] + "/" + f.split("/")[1] for f in before.keys() ^ after.keys() if not f.startswith("versions")}
    assert changed == {f"{t}/part={part('c3')}" for t in ("conversations", "messages", "chunks")} | {f"uuids/part={part(u)}" for u in ("m3", "m3b")}
    assert all(after[f] == t for f, t in before.items() if f in after)


def indexes(spark, tmp_path, exports):
    """The tables after merging the exports one by one: in partitions, and in memory."""
    from talkmill.jobs.index import TABLES, PartitionedIndex, empty_index

    parts = PartitionedIndex(spark, str(tmp_path / "parts"), 4)
    known = empty_index(spark.createDataFrame([], "raw string"))
    for n, rows in enumerate(exports):
        frame = spark.createDataFrame(rows, "raw string")
        report = {r.what: r.n for r in parts.merge(frame, n).collect()}
        done = import_export(frame, *[known[t] for t in TABLES])
        assert {r.what: r.n for r in done["report"].collect()} == report
        known = {t: spark.createDataFrame(done[t].collect(), done[t].schema) for t in TABLES}
    told = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    for t in TABLES:
        assert told(parts.table(t)) == told(known[t])
    return parts, known, done


def test_partitions_and_tables_in_memory_agree(spark, tmp_path):
    one = [raw(f"c{i}", [{"uuid": f"m{i}.{k}", "text": f"message {k} of conversation {i}"} for k in range(3)], updated_at="2024-01-02T00:00:00Z") for i in range(9)]
    # a message of c1 in a new conversation stays with c1; c2 loses all its messages; c3 is older; c4 grows
    two = [
        raw("new", [{"uuid": "m1.0", "text": "taken from another one"}, {"uuid": "n", "text": "a message of its own"}], updated_at="2024-01-05T00:00:00Z"),
        raw("c2", [], updated_at="2024-01-05T00:00:00Z"),
        raw("c3", [{"uuid": "m3.0", "text": "how it was before that"}], updated_at="2024-01-01T00:00:00Z"),
        raw("c4", [{"uuid": f"m4.{k}", "text": f"message {k} of conversation 4"} for k in range(4)], updated_at="2024-01-05T00:00:00Z"),
    ]
    # m1.0 goes from c1 to new, when both are rebuilt
    three = [raw("c1", [{"uuid": "m1.1", "text": "message 1 of conversation 1"}], updated_at="2024-01-06T00:00:00Z"), raw("new", [{"uuid": "m1.0", "text": "taken from another one"}], updated_at="2024-01-06T00:00:00Z")]
    parts, known, done = indexes(spark, tmp_path, [one, two, three])
    own = {(r.uuid, r.conv_uuid) for r in parts.table("messages").collect()}
    assert ("m1.0", "new") in own and ("n", "new") not in own and not {c for _, c in own} & {"c2"} and ("m4.3", "c4") in own and ("m3.2", "c3") in own
    assert {(r.uuid, r.conv_uuid) for r in parts.table("uuids").collect()} == own
    assert {r.what: (r.n, r.gained) for r in done["gains"].collect()} == {"conversations": (10, 0), "messages": (24, -2)}


def test_a_message_stays_with_the_conversation_that_holds_it(spark, tmp_path):
    one = [raw("a", [{"uuid": "m", "text": "the first to hold it"}])]
    two = [raw("b", [{"uuid": "m", "text": "another one with its uuid"}, {"uuid": "x", "text": "held twice in one export"}]), raw("c", [{"uuid": "x", "text": "the later conversation"}])]
    parts, _, _ = indexes(spark, tmp_path, [one, two])
    assert {(r.uuid, r.conv_uuid) for r in parts.table("messages").collect()} == {("m", "a"), ("x", "b")}


def test_a_uuid_twice_in_one_export(spark, tmp_path):
    old = raw("c", [{"uuid": "m1", "text": "old text of the first"}, {"uuid": "m2", "text": "a second message"}, {"uuid": "m3", "text": "a third message"}], updated_at="2024-01-01T00:00:00Z")
    new = raw("c", [{"uuid": "m1", "text": "new text of the first"}, {"uuid": "m4", "text": "another second one"}], updated_at="2024-01-02T00:00:00Z")
    for rows in ([old, new], [new, old], [new, old, new]):
        parts, known, _ = indexes(spark, tmp_path / str(len(list(tmp_path.iterdir()))), [rows])
        assert sorted((r.seq, r.uuid, r.text) for r in known["messages"].collect()) == [(0, "m1", "new text of the first"), (1, "m4", "another second one")]
        assert known["conversations"].first().n_messages == 2 and parts.table("chunks").count() == 2


def test_what_is_no_export_raises(spark, tmp_path):
    (tmp_path / "b.zip").write_bytes(b"no zip")
    with pytest.raises(Exception, match="damaged zip"):
        exports.read_export(spark, str(tmp_path / "b.zip")).collect()
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("other.json", "[]")
    with pytest.raises(Exception, match="holds no conversations.json but other.json"):
        exports.read_export(spark, str(tmp_path / "c.zip")).collect()
    for name, text in (("d.json", '{"uuid":"e"}'), ("e.json", "no json")):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception, match="no JSON array"):
            exports.read_export(spark, str(tmp_path / name)).collect()


def test_english_lexemes(spark):
    pairs = {"consigned": "consign", "knackeries": "knackeri", "hopping": "hop", "hoping": "hope", "generously": "generous", "relational": "relat", "argument": "argument", "sensibility": "sensibl", "agreed": "agre", "sky": "sky", "dying": "die", "kiwis": "kiwi", "happily": "happili", "databases": "databas"}
    assert {w: stem(w) for w in pairs} == pairs
    rows = spark.createDataFrame([(1, "She looked at the databases of the year"), (2, "looking for a database"), (3, "nothing")], "id int, text string")
    source = rows.select(F.col("id").cast("string").alias("conv_uuid"), F.col("id").cast("string").alias("msg_uuid"), F.lit("prose").alias("field"), "text")
    found = lambda q: {r.conv_uuid for r in search.fulltext_hits(source, search.parse_websearch(q), stemmed=True).collect()}
    assert found("looks database") == {"1", "2"} and found('"database of the years"') == {"1"} and found("the") == set() and found("database -years") == {"2"}
    assert found('"looked the databases"') == set() and found("looked OR nothing") == {"1", "2", "3"}


def test_search_modes():
    assert search.resolved("word", None) == ("word", {"you", "assistant"})
    assert search.resolved("nope", ["title", "bad"]) == ("word", {"title"})
    assert search.resolved("semantic", ["title"]) == ("semantic", {"you", "assistant"})
    assert [search.total_pages(n) for n in (0, 1, 50, 51)] == [0, 1, 1, 2]
