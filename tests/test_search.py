"""Fuzzy and semantic searches, fragments, and archives that are read as streams, against plain versions."""

import io
import json
import os
import random
import subprocess
import sys
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkmill.operators import search
from talkmill.sources import archives, exports

SF = "/root/testdata/sf0.001"


def plain_similarities(query, text):
    """All stretches of trigrams: of whole words, and those that begin and end with one of the query's."""
    wanted, grams = {g for g, _, _ in search.word_trigrams(query)}, search.word_trigrams(text)
    strict = loose = 0.0
    for i, (gram, begins, _) in enumerate(grams):
        seen, common = set(), 0
        if not begins and gram not in wanted:
            continue
        for g, _, ends in grams[i:]:
            if g not in seen:
                seen.add(g)
                common += g in wanted
            found = common / (len(wanted) + len(seen) - common) if wanted else 0.0
            if begins and ends:
                strict = max(strict, found)
            if gram in wanted and g in wanted:
                loose = max(loose, found)
    return tuple(x if x >= 0.5 else 0.0 for x in (strict, loose))


def test_word_similarity():
    assert search.word_similarities("word", "two words") == pytest.approx((0.571429, 0.8), abs=1e-6)
    assert search.word_similarities("", "x") == search.word_similarities("abc", "") == (0.0, 0.0)


def test_similarities_equal_all_stretches(spark):
    rng = random.Random(2)
    some = lambda n: " ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(n))
    cases = [(some(rng.randrange(1, 4)), some(rng.randrange(0, 14))) for _ in range(1500)]
    texts = [r.text[:1500] for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    cases += [(q, t) for q in ("tionand", "the other one", texts[0][:20]) for t in texts]
    cases += [("tion", "tion " * 40), ("a b", "a a a b b a " * 9)]
    assert any(plain_similarities(*c) > (0, 0) for c in cases)
    for query, text in cases:
        assert search.word_similarities(query, text) == pytest.approx(plain_similarities(query, text)), (query, text)


def test_a_long_text_takes_seconds():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(85_000))
    began = time.time()
    search.word_similarities("some words here", text)
    assert time.time() - began < 20
    began = time.time()
    search.snippet(text, {text[:5], text[6:11], text[-5:]}, False, 22, 8, 2)
    assert time.time() - began < 10


def test_fuzzy_hits_equal_the_plain_rules(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select(F.concat_ws(":", "conv_id", "turn").alias("msg_uuid"), F.col("conv_id").cast("string").alias("conv_uuid"), F.when(F.col("turn") == 0, "title").otherwise("prose").alias("field"), F.substring("text", 1, 900).alias("text"))
    for query in ("tionand", "and the"):
        want = set()
        for r in rows.collect():
            strict, loose = plain_similarities(query, r.text)
            if strict:
                want.add((r.msg_uuid, round(loose * (1.5 if r.field == "title" else 1), 9)))
        assert {(r.msg_uuid, round(r.score, 9)) for r in search.fuzzy_hits(rows, query).collect()} == want


def test_fuzzy_batch_equals_the_plain_rules(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select(F.concat_ws(":", "conv_id", "turn").alias("key"), F.substring("text", 1, 400).alias("text"))
    texts = {r.key: r.text for r in rows.collect()} | {"none": None, "blank": " "}
    source = spark.createDataFrame([*texts.items()], "key string, text string")
    asked = {i: t for i, t in enumerate([list(texts.values())[0][:30], list(texts.values())[9][5:60], "the", "tionand", "zzzzz", "", "of the and", None])}
    found = {(r.query_id, r.key, round(r.score, 9)) for r in search.fuzzy_batch(source, spark.createDataFrame([*asked.items()], "query_id int, text string")).collect()}
    want = set()
    for i, query in asked.items():
        for key, text in texts.items():
            strict, loose = plain_similarities(query or "", text or "")
            if strict:
                want.add((i, key, round(loose, 9)))
    assert found == want and len({i for i, _, _ in want}) > 2


def plain_lexemes(query, text):
    """Whether a text satisfies a parsed query, lexeme by lexeme."""
    words = [search.lexeme(w) for w in search.re.findall(r"[^\W_]+", text.lower())]
    has = lambda phrase: any(all(not w or (i + j < len(words) and words[i + j] == w) for j, w in enumerate(phrase)) for i in range(len(words)))
    return bool(query.clauses or query.without) and all(any(map(has, c)) for c in query.clauses) and not any(map(has, query.without))


def test_english_searches_equal_the_plain_rules(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select(F.concat_ws(":", "conv_id", "turn").alias("msg_uuid"), F.col("conv_id").cast("string").alias("conv_uuid"), F.lit("prose").alias("field"), "text")
    texts = {r.msg_uuid: r.text for r in rows.collect()}
    some = [w for t in texts.values() for w in t.split() if len(w) > 4][::97]
    for asked in ("the eres OR things -onre", f"{some[0]} OR {some[1]}", f"-{some[2]}", f'"{" ".join(texts["3:0"].split()[2:5])}"', f"{some[3]}s the {some[4]}ing OR eres"):
        query = search.english(search.parse_websearch(asked))
        want = {k for k, t in texts.items() if plain_lexemes(query, t)}
        assert {r.msg_uuid for r in search.fulltext_hits(rows, search.parse_websearch(asked), stemmed=True).collect()} == want, asked


def test_covers_are_the_smallest_stretches():
    rng = random.Random(4)
    for _ in range(300):
        hits = [(i, rng.choice("abc")) for i in range(rng.randrange(1, 14)) if rng.random() < 0.7]
        words = {w for _, w in hits}
        every = [(a, b) for a, _ in hits for b, _ in hits if a <= b and {w for i, w in hits if a <= i <= b} == words]
        want = sorted(c for c in every if not any(d != c and c[0] <= d[0] and d[1] <= c[1] for d in every))
        assert sorted(search.covers(hits)) == want


def test_fragments(spark):
    filler = " ".join(f"w{i}" for i in range(40))
    text = f"The cat, {filler} a dog and the cat! {filler} dog"
    made = lambda words, **more: search.snippet(text, set(words), False, **{"around": 6, "before": 2, "most": 2} | more)
    assert made(["cat", "dog"], most=1) == "w39 a [dog] and the [cat]"
    assert made(["cat", "dog"]) == "The [cat], w0 w1 w2 w3 … w39 a [dog] and the [cat]"
    assert made(["zzz"]) == "The cat w0 w1 w2 w3"
    rows = spark.createDataFrame([("The cats ran",), ("",), (None,)], "text string")
    found = rows.select(search.headline(stemmed=True)("text", F.array(F.lit("cat"), F.lit("run")))).collect()
    assert [r[0] for r in found] == ["The [cats] ran", "", ""]


def test_semantic_batch_equals_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors, asked = rng.normal(size=(60, 5)), rng.normal(size=(23, 5))
    asked[4] = 0
    rows = [(f"h{i}", v.tolist()) for i, v in enumerate(vectors)] + [("none", None), ("zero", [0.0] * 5)]
    table = spark.createDataFrame(rows, "text_sha256 string, embedding array<double>")
    chunks = spark.createDataFrame([(f"m{i}", f"c{i % 9}", "human" if i % 4 else "system", None, f"h{i % 60}") for i in range(90)], "msg_uuid string, conv_uuid string, sender string, created_at timestamp, text_sha256 string")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)] + [(99, None)], "query_id long, embedding array<double>")
    want = {}
    for q, v in enumerate(asked):
        for i in range(90):
            if i % 4 and v.any():
                score = float(v @ vectors[i % 60] / np.linalg.norm(v) / np.linalg.norm(vectors[i % 60]))
                if score >= 0.4:
                    want[q, f"c{i % 9}"] = max(want.get((q, f"c{i % 9}"), (0, "")), (round(score, 9), f"m{i}"))
    got = lambda: {(r.query_id, r.conv_uuid): (round(r.score, 9), r.msg_uuid) for r in search.semantic_batch(chunks, table, queries, {"you"}).collect()}
    assert got() == want
    monkeypatch.setattr(search, "QUERIES", 7)
    assert got() == want
    assert search.semantic_batch(chunks, table, queries.limit(0), {"you"}).count() == 0 == search.semantic_batch(chunks, table, queries, {"title"}).count()


def parts_of(text, size):
    stream = io.StringIO(text)
    return list(archives.elements(stream.read, size))


def test_elements_of_a_list():
    rng = random.Random(6)
    values = [None, True, 3, "", 'a"b\\', "x,]}[{", [], {}, [1, [2, {"k": "]"}]], {"a": {"b": ['",', "\\\""]}}, "é\n"]
    for _ in range(60):
        own = rng.choices(values, k=rng.randrange(6))
        text = json.dumps(own, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5)
        for size in (1, 2, 7, 1000):
            assert [json.loads(x) for x in parts_of(f" {text}\n", size)] == own
    for text, why in (("{}", "not a list"), ("", "empty"), ("[1", "ends within"), ('["a', "ends within"), ("[1] x", "follows"), ("nothing", "Expecting")):
        for size in (1, 1000):
            with pytest.raises(ValueError, match=why if size > 1 or why != "Expecting" else "not a list|Expecting"):
                parts_of(text, size)


def test_zips_are_written_and_read(spark, tmp_path):
    raws = [json.dumps({"uuid": f"c{i}", "name": 'a "name", é', "chat_messages": []}, ensure_ascii=False, separators=(",", ":")) for i in range(500)]
    written = archives.write_archives(spark.createDataFrame([(r,) for r in raws], "raw string").repartition(3), str(tmp_path / "z")).collect()
    assert sum(r.n for r in written) == 500 and len(written) == 3
    assert sorted(r.raw for r in exports.read_export(spark, str(tmp_path / "z" / "*.zip"), 4).collect()) == sorted(raws)
    with zipfile.ZipFile(tmp_path / "side.zip", "w") as z:
        z.writestr("export/conversations.json", "[]")
        z.writestr("export/projects/p1.json", '{"a": 1}')
        z.writestr("users.json", "[1, 2]")
        z.writestr("export/broken.json", "{")
    assert sorted(tuple(r) for r in exports.read_artifacts(spark, str(tmp_path / "side.zip")).collect()) == [("projects", "p1", '{"a":1}'), ("users", "", "[1,2]")]
    assert exports.read_export(spark, str(tmp_path / "side.zip")).count() == 0
    with zipfile.ZipFile(tmp_path / "cut.zip", "w") as z:
        z.writestr("conversations.json", '[{"uuid": "a"}, {"uuid"')
    with pytest.raises(Exception, match="conversations.json is not JSON"):
        exports.read_export(spark, str(tmp_path / "cut.zip")).collect()


MEASURE = """
import resource, sys
sys.path.insert(0, {here!r})
from talkmill.sources import archives
reader = archives.ArchiveReader({{"path": {path!r}}})
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = sum(b.num_rows for m in reader.partitions() for b in reader.read(m))
print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_a_large_archive_needs_little_memory(tmp_path):
    path, one = str(tmp_path / "large.zip"), json.dumps({"uuid": "u", "text": "some words " * 9000})
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z, z.open("conversations.json", "w", force_zip64=True) as f:
        f.write(b"[")
        for i in range(4000):  # 400 MB
            f.write((b"," if i else b"") + one.encode())
        f.write(b"]")
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", MEASURE.format(here=here, path=path)], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) == 4000 and int(out[1]) < 150
