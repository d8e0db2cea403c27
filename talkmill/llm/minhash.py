"""Operator 5: near duplicates by ProbMinHash sketches, banding, exact verification and connected components.

Texts are weighted sets of five-word shingles, in the candidates as in the links: a shingle weighs as often as it stands.
Each shingle of a text sends a Poisson process of arrivals, at a rate equal to its weight, to random registers; a
register keeps the earliest one. An element stops as soon as its next arrival comes later than the latest register, so
a sketch costs about ``m ln m`` arrivals for any length of text. Two registers agree with the probability Jaccard of
the weighted sets, which is at least their weighted Jaccard, the sum of minima over the sum of maxima.

Exact copies are one node from the start. In each bucket of a band, every member is compared with the bucket's
pivot, never with all others. Members of one bucket that this leaves in different components meet again in finer
buckets, with pivots of their own. Whoever is in different components still is settled by an exact join: every pair
of these texts at 0.8 or more shares one of its rarest shingles. No bucket, however large, is capped or dropped.
Links need a weighted Jaccard of at least 0.8. It is that of plain sets in which the second and further occurrences
of a shingle are elements of their own, and is verified so.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.llm.common import SIMILARITY, WordHashes, cut, mix, only, sample, shingle_hashes, sized

#: Bands and registers in a band: a pair at similarity 0.8 is missed with probability (1 - 0.8**6)**26 < 0.0004.
BANDS, ROWS = 26, 6
#: Finer buckets of each text for each band, and the pivots drawn for them.
FINER, PIVOTS = 3, 2
#: Texts and slots that the order of shingles by frequency is counted on; any order gives the same pairs.
ORDERED, SLOTS = 5_000, 2**20
#: Texts with one shingle in a block; a shingle with more is the work of several tasks.
GROUP = 256
#: Shingles sketched together.
CHUNK = 200_000
#: Partners of a pivot for each copy of its shingles.
PARTNERS = 512
WORD = re.compile(r"[^\W_]+")


def word_hashes(text: str, known: WordHashes) -> np.ndarray:
    words = WORD.findall(text.lower())
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def uniform(x: np.ndarray) -> np.ndarray:
    """A number in (0, 1] of each 64-bit value."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def probminhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, m: int) -> np.ndarray:
    """Sketches of ``docs`` weighted sets, (docs, m): the element whose arrival came first in each register."""
    first, owner = np.full(docs * m, np.inf), np.zeros(docs * m, np.uint64)
    state = mix(element)
    time = -np.log(uniform(state)) / weight
    while len(doc):
        state = mix(state + np.uint64(0x9E3779B97F4A7C15))
        at = doc * m + (state % np.uint64(m)).astype(np.int64)
        better = time < first[at]
        np.minimum.at(first, at[better], time[better])
        won = time == first[at]
        owner[at[won]] = element[won]
        last = first.reshape(docs, m).max(axis=1)
        state = mix(state + np.uint64(0x9E3779B97F4A7C15))
        time = time - np.log(uniform(state)) / weight
        on = time < last[doc]
        doc, element, weight, state, time = doc[on], element[on], weight[on], state[on], time[on]
    return owner.reshape(docs, m)


def band_hashes(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.tile(np.arange(bands, dtype=np.uint64), (len(sketches), 1))
    parts = sketches.reshape(len(sketches), bands, rows)
    for j in range(rows):
        out = mix(out * np.uint64(31) + parts[:, :, j] + np.uint64(0x9E3779B97F4A7C15))
    return out.view(np.int64)


def sketched(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, key, bands) of each row of (doc_id, text, key); texts without words have no bands."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for frame in frames:
            made: list[np.ndarray | None] = []
            sets: list[tuple[np.ndarray, np.ndarray]] = []

            def flush() -> None:
                full = [s for s in sets if len(s[0])]
                if full:
                    doc = np.repeat(np.arange(len(full)), [len(s) for s, _ in full])
                    element, weight = (np.concatenate(x) for x in zip(*full, strict=True))
                    found = iter(band_hashes(probminhash(doc, element, weight.astype(np.float64), len(full), bands * rows), bands, rows))
                    made.extend(next(found) if len(s) else None for s, _ in sets)
                else:
                    made.extend(None for _ in sets)
                sets.clear()

            size = 0
            for text in frame["text"]:
                sets.append(np.unique(shingle_hashes(word_hashes(text, known)), return_counts=True))
                size += len(sets[-1][0])
                if size > CHUNK:
                    flush()
                    size = 0
            flush()
            yield pd.DataFrame({"doc_id": frame["doc_id"], "key": frame["key"], "bands": made})

    return docs.mapInPandas(run, "doc_id long, key binary, bands array<long>")


def occurrences(shingles: np.ndarray) -> np.ndarray:
    """A set of as many elements: the first occurrence of each hash is itself, the others are told apart by their number."""
    values = np.sort(shingles)
    place = np.arange(len(values))
    first = np.r_[True, values[1:] != values[:-1]] if len(values) else np.empty(0, bool)
    number = (place - np.maximum.accumulate(np.where(first, place, 0))).astype(np.uint64)
    return np.sort(np.where(first, values, mix(values + number * np.uint64(0x9E3779B97F4A7C15))))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(key, shingles) of each row of (key, text): the occurrences of shingles, as an array of different numbers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for frame in frames:
            found = [occurrences(shingle_hashes(word_hashes(t, known))).view(np.int64) for t in frame["text"]]
            yield pd.DataFrame({"key": frame["key"], "shingles": found})

    return docs.mapInPandas(run, "key binary, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard of at least ``least``. A hot ``a`` is spread over copies of its set."""
    # written, so that the joins with it are either a broadcast or can be split where a key is hot
    copies = sized(cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("copies")), "copies"))
    left = sets.join(copies, sets.key == F.col("a")).select("a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col("shingles").alias("of_a"))
    spread = pairs.join(copies, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("copies").cast("bigint")).cast("int").alias("copy"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("of_b"))
    both = spread.join(right, "b").join(left, ["a", "copy"])
    common = F.size(F.array_intersect("of_a", "of_b"))
    # a pair whose sizes alone rule it out is dropped before its sets are compared
    small, large = F.least(F.size("of_a"), F.size("of_b")), F.greatest(F.size("of_a"), F.size("of_b"))
    return both.filter(small >= least * large - 1e-9).filter(common >= least * (F.size("of_a") + F.size("of_b") - common) - 1e-9).select("a", "b")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(key, label): each key of the links (a, b) and the smallest key of its component.

    Each round every key takes the smallest label among itself and its neighbours, then its label's label; rounds
    are written tables and end when no label changes. Labels are broadcast while they are few; the smallest label of
    a key with many neighbours is found on the map side first.
    """
    ends = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"{name}-ends")
    labels = cut(ends.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("key"), F.least("a", "b").alias("label")), f"{name}-labels")
    while True:
        told = sized(labels).withColumnsRenamed({"key": "near", "label": "seen"})
        near = ends.join(told, ends.b == told.near).select(F.col("a").alias("key"), F.col("seen").alias("label"), F.lit(None).cast(labels.schema["label"].dataType).alias("old"))
        step = near.union(labels.select("key", "label", F.col("label").alias("old"))).groupBy("key").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        jump = sized(labels).withColumnsRenamed({"key": "at", "label": "beyond"})
        moved = cut(step.join(jump, step.label == jump["at"], "left").select("key", "old", F.least("label", "beyond").alias("label")), f"{name}-labels")
        labels = moved.select("key", "label")
        if not moved.filter("label != old").limit(1).count():
            return labels


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after further links, whose components are found among the labels alone."""
    for end in ("a", "b"):
        own = sized(labels).withColumnsRenamed({"key": "own", "label": "own_label"})
        links = links.join(own, links[end] == own["own"], "left").withColumn(end, F.coalesce("own_label", end)).select("a", "b")
    over = components(links.filter("a != b").distinct(), "merged").withColumnsRenamed({"key": "at", "label": "beyond"})
    new = over.join(sized(labels), over["at"] == labels["key"], "left_anti").select(F.col("at").alias("key"), F.col("beyond").alias("label"))
    old = labels.join(sized(over), labels["label"] == over["at"], "left").select("key", F.coalesce("beyond", "label").alias("label"))
    return cut(old.union(new), "labels")


def opened(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, label) of the texts that met another one in a bucket and are in a different component so far."""
    placed = buckets.join(sized(labels), "key", "left").select("bucket", "key", F.coalesce("label", "key").alias("label"))
    mixed = cut(placed.groupBy("bucket").agg((F.min("label") != F.max("label")).alias("mixed")).filter("mixed").select("bucket"), "mixed")
    return cut(placed.join(sized(mixed), "bucket").select("key", "label").distinct(), "open")


def finer_pairs(open_texts: DataFrame, sketches: DataFrame, bands: int) -> DataFrame:
    """Pairs of the open texts that meet in finer buckets, of two bands each: every one and the finer bucket's pivots.

    So a pair within a crowd of less similar texts has a bucket nearly to itself.
    """
    told = sketches.join(sized(open_texts), "key").groupBy("key", "label").agg(F.first("bands").alias("bands"))
    two = F.transform(F.sequence(F.lit(0), F.lit(bands * FINER - 1)), lambda i: F.xxhash64(F.get("bands", i % bands), F.get("bands", (i + 1 + F.floor(i / bands).cast("int")) % bands), i))
    finer = told.select("key", "label", F.explode(two).alias("bucket"))
    drawn = [F.min_by(F.struct("key", "label"), F.xxhash64("bucket", "key", F.lit(i))) for i in range(PIVOTS)]
    pivots = finer.groupBy("bucket").agg(F.array_distinct(F.array(*drawn)).alias("pivots"), (F.min("label") != F.max("label")).alias("mixed")).filter("mixed").select("bucket", F.explode("pivots").alias("pivot"))
    met = finer.join(pivots, "bucket").filter("label != pivot.label").select(F.col("pivot.key").alias("a"), F.col("key").alias("b"))
    return met.distinct()


def frequencies(sets: DataFrame) -> np.ndarray:
    """How often each slot of shingles stands in a sample of (id, shingles); 0 for once too. The driver gets two columns, not an object for each slot."""
    slots = sample(sets, F.col("id"), ORDERED).select(F.explode("shingles").alias("s")).select(F.col("s").bitwiseAND(F.lit(SLOTS - 1)).cast("int").alias("slot"))
    some = slots.groupBy("slot").agg(F.count("*").cast("int").alias("n")).filter("n > 1").toArrow()
    often = np.zeros(SLOTS, np.int32)
    often[some["slot"].to_numpy()] = some["n"].to_numpy()
    return often


def rarest(shingles: np.ndarray, often: np.ndarray, least: float) -> np.ndarray:
    """Those of the rarest shingles of which a text at ``least`` or more to this one, and not smaller, shares one."""
    ordered = shingles[np.lexsort((shingles, often[shingles & (SLOTS - 1)]))]
    return ordered[: len(ordered) - int(np.ceil(least * len(ordered) - 1e-9)) + 1]


def meetings(group: np.ndarray, ids: np.ndarray, sides: np.ndarray, at: np.ndarray, n: np.ndarray, block: np.ndarray, least: float) -> np.ndarray:
    """Pairs of ids (rows of two) within a group, sorted by it, that may reach ``least`` if this is the first shingle
    they share: of different sides, alike in size, with enough shingles left, and in blocks that meet here."""
    found = []
    near = least / (1 + least)
    inner = at <= n - np.ceil(2 * near * n - 1e-9)
    left, d = np.arange(len(group) - 1), 1
    while len(left):
        left = left[left + d < len(group)]
        left = left[group[left] == group[left + d]]
        i, j = left, left + d
        swap = (n[i] > n[j]) | ((n[i] == n[j]) & (ids[i] > ids[j]))
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        good = inner[i] & (sides[i] != sides[j]) & (n[i] >= least * n[j] - 1e-9) & ((block[i] < 0) | (block[i] != block[j]))
        i, j = i[good], j[good]
        good = np.minimum(n[i] - at[i], n[j] - at[j]) >= np.ceil(near * (n[i] + n[j]) - 1e-9)
        found.append(np.stack([ids[i[good]], ids[j[good]]], axis=1))
        d += 1
    return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)


def exact_pairs(open_texts: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of the open texts, of different labels, among which all at ``least`` or more are.

    With shingles in one order, rarest first, the first that such a pair shares stands among the first 1 - ``least`` of
    the larger text, and nearer the front of the smaller one. Pairs are made from there only, where sizes and places allow.
    """
    texts = cut(open_texts.withColumn("id", F.monotonically_increasing_id()), "numbered")
    told = cut(sets.join(sized(texts), "key").select("id", F.xxhash64("label").alias("side"), "shingles"), "open-sets")
    often = frequencies(told)

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held, size = [], 0
            for k, s in enumerate(frame["shingles"]):
                held.append(rarest(np.asarray(s), often, least))
                size += len(held[-1])
                if size > CHUNK or k + 1 == len(frame):
                    own = frame.iloc[k + 1 - len(held) : k + 1]
                    times = [len(h) for h in held]
                    yield pd.DataFrame({"term": np.concatenate(held), "id": np.repeat(own["id"].to_numpy(), times), "side": np.repeat(own["side"].to_numpy(), times), "at": np.concatenate([np.arange(t, dtype=np.int32) for t in times]), "n": np.repeat(own["shingles"].map(len).to_numpy(np.int32), times)})
                    held, size = [], 0

    rows = cut(told.mapInPandas(spread, "term long, id long, side long, at int, n int"), "terms")
    shared = rows.groupBy("term").agg(F.count("*").alias("times"), (F.min("side") != F.max("side")).alias("mixed")).filter("mixed")
    shared = cut(shared.select("term", F.ceil(F.col("times") / GROUP).cast("int").alias("blocks")), "shared-terms")
    # each block of a term meets each other one, and itself, in a group of its own
    dealt = rows.join(sized(shared), "term").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = dealt.groupBy("term", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y")).agg(F.collect_list(F.struct("id", "side", "at", "n", F.when(F.col("block") == F.col("with"), -1).otherwise(F.col("block")).alias("block"))).alias("r"))
    groups = groups.filter(F.size("r") > 1).select(*[F.col(f"r.{c}").alias(c) for c in ("id", "side", "at", "n", "block")])

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                group = np.repeat(np.arange(len(frame)), frame["id"].map(len))
                found = meetings(group, *[np.concatenate(frame[c].to_numpy()) for c in ("id", "side", "at", "n", "block")], least)
                yield pd.DataFrame({"i": found[:, 0], "j": found[:, 1]})

    pairs = cut(groups.mapInPandas(meet, "i long, j long").distinct(), "met")
    names = texts.select("id", "key")
    for end, name in (("i", "a"), ("j", "b")):
        pairs = pairs.join(sized(names).withColumnsRenamed({"id": end, "key": name}), end)
    return pairs.select("a", "b")


def labelled(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, key, label) of each row: key is the MD5 of its text, label the smallest key of its class."""
    rows_in = only(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    rows_in = rows_in.withColumn("key", F.unhex(F.md5("text")))
    sketches = cut(sketched(rows_in, bands, rows), "sketches")
    # the rows of a text come together by key, with its bands once: many exact copies are few rows after the map side
    texts = sketches.groupBy("key").agg(F.first("bands", ignorenulls=True).alias("bands"))
    buckets = texts.select("key", F.explode("bands").alias("bucket"))
    # keys are hashes, so the smallest one is a random member, and buckets with many members in common share it
    pivots = cut(buckets.groupBy("bucket").agg(F.min("key").alias("pivot"), F.count("*").alias("n")).filter("n > 1").drop("n"), "pivots")
    buckets = cut(buckets.join(sized(pivots), "bucket").select("bucket", "key", "pivot"), "buckets")
    pairs = cut(buckets.filter("key != pivot").select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct(), "pairs")
    wanted = cut(pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct(), "wanted")
    # one row stands for each wanted text: that of its smallest doc_id
    chosen = sketches.join(sized(wanted), "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("of"))
    chosen = cut(chosen, "chosen").withColumnRenamed("key", "of_key")
    told = rows_in.join(sized(chosen), (F.col("key") == F.col("of_key")) & F.col("doc_id").eqNullSafe(F.col("of"))).select("key", "text")
    sets = cut(shingle_sets(told).dropDuplicates(["key"]), "sets")
    links = cut(verified(pairs, sets, similarity), "links")
    labels = components(links)
    for pairs_of in (lambda left: finer_pairs(left, sketches, bands), lambda left: exact_pairs(left, sets, similarity)):
        left = opened(buckets, labels)
        more = cut(verified(cut(pairs_of(left), "pairs"), sets, similarity), "links")
        if more.limit(1).count():
            labels = joined(labels, more)
    return sketches.select("doc_id", "key").join(sized(labels), "key", "left").select("doc_id", "key", F.coalesce("label", "key").alias("label"))


def near_duplicates(docs: DataFrame, *, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id, class_size.

    class_id is the smallest doc_id of the class (null if all its doc_ids are null), class_size its rows. A null text counts as empty; texts without words are
    alike only if they are equal; texts under five words have one shingle. Repeated rows and ties are in one class;
    null doc_ids keep their rows. Other columns are left out. An empty table gives no rows.
    """
    members = cut(labelled(docs, similarity, bands, rows), "members")
    classes = cut(members.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "classes")
    return members.join(sized(classes), "label").select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: that of its smallest doc_id (nulls last), then of the smallest MD5.

    Of repeated rows, equal in doc_id and text, one stays. Null and empty texts are one class; texts without words are alike
    only if they are equal. An empty table stays empty.
    """
    rows = labelled(docs).groupBy("label", "doc_id", "key").agg(F.count("*").alias("copies"))
    order = F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), "key")
    kept = rows.groupBy("label").agg(F.min_by(F.struct("doc_id", "key", "copies"), order).alias("kept")).select("kept.*")
    kept = cut(kept, "kept").select(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key"), "copies")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("own_key"))
    found = whole.join(kept, F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_key") == F.col("kept_key")))
    once = found.filter("copies > 1").dropDuplicates(["own_id", "own_key"])
    return found.filter("copies = 1").union(once).select("row.*")
