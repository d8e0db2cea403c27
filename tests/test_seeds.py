"""The automaton of all seeds against the patterns of each category."""

import random
import time

from pyspark.sql import functions as F

from talkmill.operators import classify, seeds

SF = "/root/testdata/sf0.001"


def archive(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    messages = rows.select(F.col("conv_id").cast("string").alias("conv_uuid"), "text")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 60).cast("int"))
    meta = rows.groupBy("conv_id").agg(texts.alias("t")).select(F.col("conv_id").cast("string").alias("uuid"), F.substring(F.get("t", F.lit(0)), 1, 80).alias("name"), F.get("t", F.lit(1)).alias("summary"), F.when(F.col("conv_id") % 7 != 0, day.cast("timestamp")).alias("created_at"))
    return meta.cache(), messages.cache()


def made(rng, words, n):
    some = lambda k: [rng.choice(words).upper() if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(k))]
    dates = lambda: rng.choice([(None, None), ("2024-01-10", "2024-02-10"), ("2024-01-10", None)])
    return [classify.Seeds(f"s{i}", some(4), some(4), some(4), rng.choice(["title", "meta", "all"]), *dates()) for i in range(n)]


def proposals(df):
    return {(r.conv_uuid, r.slug, r.confidence, r.method, r["pass"]) for r in df.collect()}


def test_equals_the_patterns(spark):
    meta, messages = archive(spark)
    rng = random.Random(3)
    words = sorted({w for r in messages.collect() for w in r.text.split()})
    words = [*rng.sample(words, 150), "the", "of", "the of", "(x", "x)", "+", ""]
    categories = made(rng, words, 30)
    want = proposals(classify.keyword_proposals(meta, messages, categories))
    assert want and proposals(seeds.seed_proposals(meta, messages, categories)) == want


def test_odd_words_and_borders(spark):
    terms = ["straße", "Kelvin", "İstanbul", "naïve", "a b", "c++", "_x", "ſet", "café", "x\u0301y"]
    texts = ["STRASSE straße", "Straße!", "\u212aelvin", "kelvins", "istanbul İSTANBUL", "NAÏVE.", "a  b, a b", "c++ c", "_x _X y_x", "set", "cafe\u0301", "caféx café", "", None, "x\u0301y", "ax\u0301y"]
    rows = spark.createDataFrame([(str(i), t, None, None) for i, t in enumerate(texts)], "uuid string, name string, summary string, created_at timestamp")
    none = spark.createDataFrame([], "conv_uuid string, text string")
    for term in terms:
        own = [classify.Seeds("s", [term], [], [])]
        assert proposals(seeds.seed_proposals(rows, none, own)) == proposals(classify.keyword_proposals(rows, none, own)), term
    assert seeds.seed_proposals(rows, none, []).count() == 0


def test_time_hardly_grows_with_the_categories():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    text = " ".join(word() for _ in range(200_000))
    taken = []
    for n in (10, 500):
        machine = seeds.Automaton([classify.Seeds(f"s{i}", [word() for _ in range(5)], [], [word() for _ in range(5)]) for i in range(n)])
        machine.found("")
        machine.found("x")
        began = time.process_time()
        machine.found(text)
        taken.append(time.process_time() - began)
    assert taken[1] < 4 * taken[0] + 0.2
