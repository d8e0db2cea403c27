"""Searches against the stored index, and searches of texts: the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkmill.functions.english import lexeme
from talkmill.operators import postings, search

TEXTS = {
    "a": "The cat sat on the mat. The cats were running!", "b": "running dogs run; a runner runs", "c": "", "d": None, "e": "mat cat the of the dog " * 60, "f": "Ünïcode wörter und the MAT",
    "g": "of the", "h": "the of", "i": "dog dog dog cat " + "filler " * 300 + "mat", "j": "on-the-mat, on the other mat",
}
ASKED = ["cat", "the of", '"of the"', "cat OR dog", "cat -dog", '"on the mat"', "-the", '-"the mat" -dog', "mat OR zzz", "zzz", "zzz cat", '"cat zzz" OR dog', "", "OR", 'the "cat sat" OR running', "cat mat dog", '"the mat" -cats', "the the", '"the the"', '"dog dog dog"']


@pytest.fixture(scope="module")
def source(spark):
    return spark.createDataFrame([*TEXTS.items()], "key string, text string")


def plain(source, text, stemmed):
    rows = source.select(F.col("key").alias("conv_uuid"), F.col("key").alias("msg_uuid"), F.lit("prose").alias("field"), "text")
    return {(r.msg_uuid, round(r.score, 9)) for r in search.fulltext_hits(rows, search.parse_websearch(text), stemmed).collect()}


@pytest.mark.parametrize("stemmed", [False, True])
def test_the_same_rows_as_a_search_of_texts(spark, source, tmp_path, stemmed):
    index = postings.write_index(source, str(tmp_path / "k"), stemmed=stemmed, buckets=4, part=3)
    queries = spark.createDataFrame([*enumerate(ASKED)], "query_id long, text string")
    found = {}
    for r in postings.search_batch(index, queries).collect():
        found.setdefault(r.query_id, set()).add((r.key, round(r.score, 9)))
    for i, text in enumerate(ASKED):
        assert found.get(i, set()) == plain(source, text, stemmed), text
    again = postings.read_index(spark, str(tmp_path / "k"))
    assert (again.buckets, again.stemmed) == (4, stemmed) and again.postings.count() == index.postings.count()


def test_the_index_has_each_place(spark, source, tmp_path):
    index = postings.write_index(source, str(tmp_path / "k"), buckets=3, part=2)
    want = {}
    for key, text in TEXTS.items():
        for pos, word in enumerate(search.re.findall(r"[^\W_]+", (text or "").lower())):
            want.setdefault((word, key), []).append(pos)
    got = {(r.term, r.key): r.positions for r in index.postings.filter("term != ''").collect()}
    assert got == want
    assert {r.key for r in index.postings.filter("term = ''").collect()} == set(TEXTS)
    assert {r.term: r.texts for r in index.terms.filter("term != ''").collect()} == {t: len({k for w, k in want if w == t}) for t, _ in want}


def test_no_text_is_read_and_few_buckets(spark, source, tmp_path):
    index = postings.write_index(source, str(tmp_path / "k"), buckets=8)
    queries = spark.createDataFrame([(1, "cat mat")], "query_id long, text string")
    found = postings.search_batch(index, queries)
    plan = found._jdf.queryExecution().toString()
    assert found.inputFiles() and all(f"{tmp_path}/k/" in f for f in found.inputFiles())
    assert "dynamicpruning" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("stemmed", [False, True])
def test_searches_in_shares_and_passes(spark, source, tmp_path, monkeypatch, stemmed):
    for name, n in (("SHARE", 9), ("SEARCHES", 5), ("ROWS", 2), ("PAIRS", 4)):
        monkeypatch.setattr(postings, name, n)
    index = postings.write_index(source, str(tmp_path / "k"), stemmed=stemmed, buckets=4)
    found = {}
    for r in postings.search_batch(index, spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(ASKED)], "query_id string, text string")).collect():
        found.setdefault(r.query_id, []).append((r.key, round(r.score, 9)))
    for i, text in enumerate(ASKED):
        assert sorted(found.get(f"q{i}", [])) == sorted(plain(source, text, stemmed)), text


def test_no_pair_of_search_and_text_is_shuffled(spark, source, tmp_path):
    """What a search without any wanted word finds grows with searches times texts."""
    index = postings.write_index(source, str(tmp_path / "k"))
    found = postings.search_batch(index, spark.createDataFrame([(1, "-cat"), (2, "cat -mat")], "query_id long, text string"))
    assert found.filter("query_id = 1").count() == 7
    moved = search.re.findall(r"Exchange hashpartitioning\(([^)]*)\)", found._jdf.queryExecution().executedPlan().toString())
    assert moved and not any("query_id" in m for m in moved)


def test_an_empty_archive_and_no_queries(spark, source, tmp_path):
    index = postings.write_index(source.limit(0), str(tmp_path / "k"))
    assert postings.search_batch(index, spark.createDataFrame([(1, "cat"), (2, "-cat")], "query_id long, text string")).count() == 0
    full = postings.write_index(source, str(tmp_path / "f"))
    assert postings.search_batch(full, spark.createDataFrame([], "query_id long, text string")).count() == 0


def test_all_terms_of_a_table(spark, source, tmp_path):
    index = postings.write_index(source, str(tmp_path / "k"))
    asked = spark.createDataFrame([(1, "the"), (1, "mat"), (1, "the"), (2, "zzz"), (2, "the"), (3, "dog")], "query_id long, term string")
    got = {(r.query_id, r.key) for r in postings.match_all(index, asked).collect()}
    assert got == {(1, "a"), (1, "e"), (1, "f"), (1, "j"), (3, "e"), (3, "i")}


def test_the_rarest_clause_is_looked_up(spark):
    clauses = [{"without": False, "phrases": [["the"]]}, {"without": False, "phrases": [["the", "rare"], ["odd"]]}, {"without": True, "phrases": [["x"]]}]
    row = spark.createDataFrame([(clauses, {"the": 900, "rare": 2, "odd": 5, "x": 1})], f"clauses {postings.CLAUSES}, texts map<string,bigint>")
    assert sorted(row.select(postings.anchors(F.col("clauses"), F.col("texts")).alias("a")).first().a) == ["odd", "rare"]


def test_nearness_equals_all_pairs():
    rng = np.random.default_rng(1)
    for n, m, span in ((3, 4, 20), (200, 50, 400), (1, 1, 5), (500, 700, 1500)):
        a, b = (np.sort(rng.choice(span * 2, k, replace=False)) for k in (n, m))
        gaps = np.abs(a[:, None] - b[None])
        near = np.where(gaps > 100, 1e-30, 1 / (1.005 + 0.05 * np.exp(np.minimum(gaps, 400) / 1.5 - 2)))
        assert search.nearness(a, b) == pytest.approx(float(np.prod(1 - 0.1 * np.sqrt(near))), rel=1e-9)


def test_scores_of_a_long_text_take_little_time(spark):
    places = [list(range(0, 400_000, 2)), list(range(1, 400_000, 2))]
    row = spark.createDataFrame([(places,)], "p array<array<int>>")
    assert row.select(search.near_score("p").alias("s")).first().s == pytest.approx(1.0)


def test_lexemes_of_a_source_are_stemmed_once(source):
    forms = search.written_forms(source.withColumn("conv_uuid", F.col("key")), search.english(search.parse_websearch("runs cats -dog")))
    assert forms == {w: lexeme(w) for w in ("running", "run", "runs", "cat", "cats", "dog", "dogs")}


def test_texts_that_lack_a_word_are_left_out_before_places_are_read(spark, tmp_path):
    texts = [(f"k{n}", f"rare a{n // 7} b{n % 7} and more") for n in range(49)]
    index = postings.write_index(spark.createDataFrame([*texts, ("old", None)], "key string, text string"), str(tmp_path / "k"))
    asked = spark.createDataFrame([(n, f'b{n % 7} "rare a{n // 7}"') for n in range(49)] + [(99, "rare OR zzz"), (98, "-rare")], "query_id long, text string")
    met = {(r.query_id, r.key) for r in postings.candidates(index, postings.parsed(asked, False)).collect()}
    sure = {(n, f"k{n}") for n in range(49)}
    # each word of a search stands in seven texts
    assert sure | {(99, k) for k, _ in texts} | {(98, "old")} <= met and len(met) < 2 * 49 + 49 + 50
    table = spark.createDataFrame([(n, w) for n in range(49) for w in ("rare", f"a{n // 7}", f"b{n % 7}")], "query_id long, term string")
    assert {(r.query_id, r.key) for r in postings.match_all(index, table).collect()} == sure
    # an index of before has no signatures
    bare = postings.KeywordIndex(index.terms, index.postings.withColumns({"low": F.lit(None).cast("long"), "high": F.lit(None).cast("long")}), index.buckets, False)
    assert {(r.query_id, r.key) for r in postings.match_all(bare, table).collect()} == sure
