"""Operator 1: benchmark decontamination by SimHash windows, Hamming blocks and exact verification.

Built-in functions only. Shingles are five consecutive words, lower-cased, without punctuation; an item of fewer
words is one shingle. A window has as many words as the item (all words of a shorter document) and its shingles weigh
as often as they stand there; the similarity of two weighted sets is the sum of minima over the sum of maxima.

1. Positions of a document whose shingle stands in some benchmark item are kept (a join with the items' shingles).
2. A window can reach the similarity only if that share of the item's shingles is kept in it; such windows are
   listed, for every length of an item, and get a SimHash of 448 bits of their kept shingles.
3. Fingerprints fall into 28 blocks of 16 bits. If two differ in at most 55 bits, some block differs in at most one;
   items are indexed under each block value and those one bit away, so no fingerprint within the radius is missed. An unrelated
   fingerprint meets an item with a probability of 28 * 17 / 65536, which is 0.7 % (0.95 % where ties favour zeros).
4. Candidates, those that a block finds beyond the radius, too, are verified exactly.

At a similarity of 0.8 at least eight ninths of an item's shingles stand in a window of its length, so a bit differs with a
probability of 0.15 at most. Then a block differs in at most one bit with a probability of 0.28, and no block does in 0.0001
of the cases. Items of fewer than ``FEW`` shingles are indexed without each one of their shingles, too, by their whole
fingerprint: these are all the sets that a window at 0.8 can keep of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.llm.common import SHINGLE_WORDS, SIMILARITY, cut, native_shingles, native_words, only, sized

#: Numbers of 64 bits of a fingerprint, blocks of each, and bits of a block.
NUMBERS, BLOCKS, BLOCK_BITS = 7, 4, 16
FEW = 10


def simhash(shingles: Column) -> Column:
    """64-bit SimHash of an array of 64-bit hashes, each weighing as often as it stands there."""
    shift = lambda x, n: F.call_function("shiftrightunsigned", x, n)
    none, one, n = F.lit(0).cast("bigint"), F.lit(1).cast("bigint"), F.size(shingles)

    def told(width: int) -> Column:
        # ``width`` sums, each of them counters of so many bits, hold the counts of all 64 bits
        ones = F.lit(sum(1 << at for at in range(0, 64, width)))
        sums = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.aggregate(shingles, none, lambda a, x: a + shift(x, j).bitwiseAND(ones)))
        most = lambda s, b: shift(F.get(s, b % width), (F.floor(b / width) * width).cast("int")).bitwiseAND(F.lit((1 << width) - 1)) * 2 > n
        return F.transform(F.array(sums), lambda s: F.aggregate(F.sequence(F.lit(0), F.lit(63)), none, lambda a, b: a.bitwiseOR(F.when(most(s, b), F.call_function("shiftleft", one, b)).otherwise(none))))[0]

    return F.when(n < 2**16, told(16)).otherwise(told(32))


def fingerprint(shingles: Column) -> Column:
    """``NUMBERS`` SimHashes of an array of hashes, each of other bits of them."""
    again = lambda i: F.transform(shingles, lambda x: F.xxhash64(x, F.lit(i)))
    return F.array(*[simhash(again(i)) for i in range(NUMBERS)])


def blocks(prints: Column, changes: list[int]) -> Column:
    """(block, value) of every block, with each of the changes."""
    number, at = lambda b: F.floor(b / BLOCKS).cast("int"), lambda b: b % BLOCKS * BLOCK_BITS
    value = lambda b: F.call_function("shiftrightunsigned", F.get(prints, number(b)), at(b)).bitwiseAND(F.lit(2**BLOCK_BITS - 1))
    each = lambda b: F.transform(F.lit(changes), lambda x: F.struct(b.alias("block"), value(b).bitwiseXOR(x.cast("bigint")).alias("value")))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(NUMBERS * BLOCKS - 1)), each))


def whole(prints: Column) -> Column:
    """The fingerprint as the value of one more block."""
    return F.struct(F.lit(-1).alias("block"), F.xxhash64(prints).alias("value"))


def numbered(shingles: Column) -> Column:
    """The array as a set: the second and further occurrences of a hash are told apart by their number."""

    def each(w: Column) -> Column:
        plain = F.transform(w, lambda x: F.xxhash64(x, F.lit(0)))
        counted = F.transform(w, lambda x, i: F.xxhash64(x, F.size(F.filter(F.slice(w, F.lit(1), i), lambda y: y == x))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), plain).otherwise(counted)

    return F.transform(F.array(shingles), each)[0]


def benchmark_items(bench: DataFrame) -> DataFrame:
    """(item_id, words, k, shingles, fingerprint, members) of each item; items without words are left out."""
    items = only(bench, item_id="long", text="string").dropna(subset=["item_id"]).select("item_id", native_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    items = items.select("item_id", F.size("w").alias("words"), F.least(F.size("w"), F.lit(SHINGLE_WORDS)).alias("k"), native_shingles(F.col("w")).alias("shingles"))
    return items.select("*", fingerprint(F.col("shingles")).alias("fingerprint"), numbered(F.col("shingles")).alias("members"))


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n, words, k, pos, h): where a shingle of an item of so many words stands in a document of n words."""
    wanted = cut(items.select(F.explode("shingles").alias("h"), "words", "k").distinct().groupBy("h").agg(F.collect_set(F.struct("words", "k")).alias("lengths")), "item-shingles")
    sizes = [r.k for r in items.select("k").distinct().collect()] or [SHINGLE_WORDS]  # at most five numbers

    def counted(words: Column) -> Column:
        at = [F.transform(native_shingles(words, k), lambda h, i: F.struct(i.alias("pos"), h.alias("h"))) for k in sizes]
        return F.struct(F.size(words).alias("n"), F.concat(*at).alias("at"))

    base = only(docs, doc_id="long", text="string").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.transform(F.array(native_words(F.col("text"))), counted)[0].alias("r"))
    at = base.select("doc_id", "text_hash", "r.n", F.explode("r.at").alias("x")).select("doc_id", "text_hash", "n", "x.pos", "x.h")
    return at.join(sized(wanted), "h").select("doc_id", "text_hash", "n", "pos", "h", F.explode("lengths").alias("l")).select("doc_id", "text_hash", "n", "l.words", "l.k", "pos", "h")


def windows(found: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, text_hash, words, start, total, kept): windows with enough kept shingles; total counts all its shingles."""
    grouped = found.groupBy("doc_id", "text_hash", "n", "words", "k").agg(F.array_sort(F.collect_set(F.struct("pos", "h"))).alias("hit"))
    span = F.col("words") - F.col("k")
    grouped = grouped.select("*", span.alias("span"), F.ceil(F.lit(similarity) * (span + 1) - 1e-9).cast("int").alias("least")).filter(F.size("hit") >= F.col("least"))
    last = F.greatest(F.col("n") - F.col("words"), F.lit(0))

    def starts(j: Column) -> Column:
        before = F.when(j > 0, F.get("hit", j - 1)["pos"] + 1).otherwise(F.lit(0))
        low = F.greatest(before, F.get("hit", j + F.col("least") - 1)["pos"] - F.col("span"), F.lit(0))
        high = F.least(F.get("hit", j)["pos"], last)
        # of a document shorter than the item, the only window begins at its first word
        low = F.when(last == 0, F.when(j == 0, F.lit(0)).otherwise(F.lit(1))).otherwise(low)
        none = F.array().cast("array<struct<start:int,first:int>>")
        return F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), lambda s: F.struct(s.alias("start"), j.alias("first")))).otherwise(none)

    all_starts = F.flatten(F.transform(F.sequence(F.lit(0), F.size("hit") - F.col("least")), starts))
    each = grouped.select("doc_id", "text_hash", "n", "words", "k", "span", F.explode(F.transform(all_starts, lambda s: F.struct(s["start"].alias("start"), F.filter(F.slice("hit", s["first"] + 1, F.col("span") + 1), lambda x: x["pos"] <= s["start"] + F.col("span")).alias("w")))).alias("x"))
    return each.select("doc_id", "text_hash", "words", F.col("x.start").alias("start"), (F.least("n", "words") - F.col("k") + 1).alias("total"), F.col("x.w.h").alias("kept"))


def candidates(seen: DataFrame, items: DataFrame) -> DataFrame:
    """(window, item_id) of windows (window, words, print) and items of their length that meet in a block."""
    changes = [0, *[1 << i for i in range(BLOCK_BITS)]]
    without = lambda i: F.concat(F.slice("shingles", F.lit(1), i), F.slice("shingles", i + 2, F.size("shingles")))
    few = (F.size("shingles") > 1) & (F.size("shingles") < FEW)
    parts = F.when(few, F.transform(F.sequence(F.lit(0), F.size("shingles") - 1), lambda i: whole(fingerprint(without(i))))).otherwise(F.array().cast("array<struct<block:int,value:bigint>>"))
    index = items.select("item_id", F.col("words").alias("item_words"), F.explode(F.concat(blocks(F.col("fingerprint"), changes), parts)).alias("p"))
    index = cut(index.select("item_id", "item_words", "p.*"), "item-index")
    probes = seen.select("window", "words", F.explode(F.concat(blocks(F.col("print"), [0]), F.array(whole(F.col("print"))))).alias("p")).select("window", "words", F.col("p.block").alias("at"), F.col("p.value").alias("v"))
    same = (F.col("words") == F.col("item_words")) & (F.col("at") == F.col("block")) & (F.col("v") == F.col("value"))
    return probes.join(sized(index), same).select("window", "item_id").distinct()


def leaks(docs: DataFrame, bench: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, item_id, similarity, start_word, n_words): the best window of each leaked item in a text.

    Of equal windows the first counts. Null and empty texts and items leak nothing; so do items without an item_id.
    Rows with a null doc_id are found under null; repeated rows give one row. Other columns are left out. Without
    documents or items there are no rows.
    """
    items = cut(benchmark_items(bench), "items")
    seen = windows(hits(docs, items), similarity)
    seen = cut(seen.select("*", fingerprint(F.col("kept")).alias("print"), F.monotonically_increasing_id().alias("window")), "windows")
    # only ids and blocks meet in the index; the shingles are fetched for what has met
    met = cut(candidates(seen, items), "candidates")
    told = met.join(sized(items.select("item_id", "members")), "item_id").join(seen.select("window", "doc_id", "text_hash", "start", "words", "total", "kept"), "window")
    common = F.size(F.array_intersect(numbered(F.col("kept")), F.col("members"))).cast("double")
    scored = told.select("doc_id", "text_hash", "item_id", "start", "words", (common / (F.col("total") + F.size("members") - common)).alias("similarity")).filter(F.col("similarity") >= similarity - 1e-9)
    best = scored.groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct("similarity", -F.col("start"), "words")).alias("b"))
    return best.select("doc_id", "text_hash", "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.col2")).alias("start_word"), F.col("b.words").alias("n_words"))


def clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item.

    Rows with null or empty texts stay, as do all rows where there are no items; repeated rows stay or go together. An empty
    table stays empty.
    """
    bad = cut(leaks(docs, bench).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct(), "leaks")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("own_hash"))
    return whole.join(sized(bad), F.col("own_id").eqNullSafe(F.col("bad_id")) & (F.col("own_hash") == F.col("bad_hash")), "left_anti").select("row.*")
