"""Operator 4: repeated passages, by MinHash banding of paragraphs, exact verification and components.

A text is one stream of words (lower-cased, without punctuation). Two kinds of units are looked at:

* Paragraphs, which are met as near copies: lines of ``NEAR_WORDS`` or more, and runs of shorter lines that have as many
  together. MinHash of their five-word shingles, bands that let a pair at similarity 0.8 slip with a probability of
  0.003, exact Jaccard of every member of a bucket and its pivot; members that this leaves apart are settled in
  finer buckets and then by an exact join on their rarest shingles.
* Pieces between the words where the hash of two words is the smallest around, whatever the lines, so that a passage
  is met in any surroundings and however it is wrapped. Pieces must be equal.

Equal units are one node; linked ones are one component, whose first occurrence stays. Adjacent repeated units of a
document make a passage. Its ends, which lie within a piece, are found by comparing the words around it with those
around other occurrences, the first and the last one. Passages of fewer words than asked for are left alone. In a
stretch that repeats the same words over and over no pair is the smallest around: it is one piece with what surrounds it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.llm.bpe import batches, once
from talkmill.llm.common import SHINGLE_WORDS, SIMILARITY, cut, mix, only, shingle_hashes, sized
from talkmill.llm.minhash import WORD, components, exact_pairs, finer_pairs, joined, opened, verified

NEAR_WORDS, PASSAGE_WORDS = 20, 16
#: Words from which a passage counts wherever it repeats; a shorter one must be as common as asked for.
SURE_WORDS = 50
#: Words on either side among which a cut has the smallest hash; words compared beyond the ends of a passage.
AROUND, REACH = 5, 40
BANDS, ROWS = 8, 3
CHUNK_CHARS = 2_000_000
UNIT = "doc_id long, text_hash long, k1 long, k2 long, start int, n int, near boolean, closes boolean, " + ", ".join(f"b{i} long" for i in range(BANDS))


def told_lines(text: str) -> list[list[str]]:
    """The lower-cased words of each line, as many as the text itself has (lower-casing a whole text may add some)."""
    low = text.lower()
    if len(low) == len(text):
        return [WORD.findall(line) for line in low.split("\n")]
    return [[w.lower() for w in WORD.findall(line)] for line in text.split("\n")]


def told_words(text: str) -> list[str]:
    return list(chain.from_iterable(told_lines(text)))


@lru_cache(maxsize=1)
def word_letters() -> np.ndarray:
    """Whether each code point is part of a word, as ``WORD`` has it."""
    return np.fromiter(map(str.isalnum, map(chr, range(0x110000))), bool, 0x110000)


#: Fixed values of XXH64.
X1, X2, X3, X4, X5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def stretches_xxh64(raw: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The XXH64 of each stretch of ``raw``; all those under 32 bytes together, longer ones by the library."""
    held = raw + bytes(8)
    ones = np.frombuffer(held, np.uint8)
    fours, eights = (np.ndarray(len(raw) + 1, t, held, strides=(1,)) for t in ("<u4", "<u8"))
    h, at, left = sizes.astype(np.uint64) + X5, starts.copy(), np.where(sizes < 32, sizes, 0)
    while len(on := np.flatnonzero(left >= 8)):
        h[on] = turned(h[on] ^ turned(eights[at[on]] * X2, 31) * X1, 27) * X1 + X4
        at[on] += 8
        left[on] -= 8
    on = np.flatnonzero(left >= 4)
    h[on] = turned(h[on] ^ fours[at[on]].astype(np.uint64) * X1, 23) * X2 + X3
    at[on] += 4
    left[on] -= 4
    while len(on := np.flatnonzero(left)):
        h[on] = turned(h[on] ^ ones[at[on]].astype(np.uint64) * X5, 11) * X1
        at[on] += 1
        left[on] -= 1
    h = (h ^ h >> np.uint64(33)) * X2
    h = (h ^ h >> np.uint64(29)) * X3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(sizes >= 32).tolist():
        h[i] = xxhash.xxh64_intdigest(raw[starts[i] : starts[i] + sizes[i]])
    return h


def told_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """The hashes of the words of all texts, end to end; how many each text has, and each of its lines.

    The words are those of ``told_lines``, found and hashed for all texts at once.
    """
    low = [t.lower() for t in texts]
    odd = [i for i, (a, b) in enumerate(zip(texts, low, strict=True)) if len(a) != len(b)]
    for i in odd:
        low[i] = ""
    joined = "".join(chain.from_iterable((t, "\n") for t in low))
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    edges = np.diff(word_letters()[codes].view(np.int8), prepend=np.int8(0))
    starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    breaks = np.searchsorted(starts, np.flatnonzero(codes == 10))
    raw = joined.encode("utf-8", "surrogatepass")
    if len(raw) > len(codes):
        wide = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000).astype(np.int64), out=wide[1:])
        starts, stops = wide[starts], wide[stops]
    hashes = stretches_xxh64(raw, starts, stops - starts)
    last = np.cumsum([t.count("\n") + 1 for t in low])
    counts = np.diff(breaks[last - 1], prepend=0)
    sizes, a, lines = np.diff(breaks, prepend=0).tolist(), 0, []
    for b in last.tolist():
        lines.append(sizes[a:b])
        a = b
    if odd:
        own = np.split(hashes, np.cumsum(counts)[:-1])
        for i in odd:
            told = told_lines(texts[i])
            own[i] = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in chain.from_iterable(told)], np.uint64)
            lines[i], counts[i] = list(map(len, told)), len(own[i])
        hashes = np.concatenate(own)
    return hashes, counts, lines


def cuts(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places whose hash with the next word is smaller than those of all places around in the same text; only these words decide."""
    if len(hashes) <= 2 * AROUND + 1:
        return np.empty(0, np.int64)
    two = mix(hashes[:-1] * np.uint64(3) + hashes[1:])
    n = len(two) - 2 * AROUND
    middle, least = two[AROUND : AROUND + n], np.ones(n, bool)
    for d in [*range(AROUND), *range(AROUND + 1, 2 * AROUND + 1)]:
        least &= middle < two[d : d + n]
    at, ends = np.flatnonzero(least) + AROUND, np.cumsum(counts)
    text = np.searchsorted(ends, at, side="right")
    return at[(at - AROUND >= (ends - counts)[text]) & (at + AROUND + 2 <= ends[text])]


def sums(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums, modulo 2**64, of the stretches of ``values``."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
    return total[starts + lengths] - total[starts]


def stretch_hash(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """A hash of the words of each stretch, in their order."""
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.repeat(starts, lengths) + place
    mixed = mix(mix(hashes[at] + np.uint64(seed)) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return mix(sums(mixed, np.cumsum(lengths) - lengths, lengths) + lengths.astype(np.uint64))


#: Odd factors that order the shingles anew for each register.
FACTORS = mix(np.arange(1, BANDS * ROWS + 1)) | np.uint64(1)


def sketches(shingles: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Band hashes (n, BANDS) of the sets of shingles, which stand end to end: the smallest under each order."""
    starts = np.cumsum(lengths) - lengths
    out = np.tile(np.arange(BANDS, dtype=np.uint64), (len(lengths), 1))
    for j, factor in enumerate(FACTORS):
        least = np.minimum.reduceat(shingles * factor, starts)
        out[:, j // ROWS] = mix(out[:, j // ROWS] * np.uint64(31) + least + np.uint64(0x9E3779B97F4A7C15))
    return out.view(np.int64)


def paragraph_places(sizes: list[int]) -> list[tuple[int, int]]:
    """(start, n) of the paragraphs of a text, of the words of its lines; a line without words ends a run of short ones."""
    out, at, run = [], 0, 0
    for n in [*sizes, 0]:
        if n == 0 or n >= NEAR_WORDS:
            if run >= NEAR_WORDS:
                out.append((at - run, run))
            run = 0
            if n:
                out.append((at, n))
        else:
            run += n
        at += n
    return out


def units(texts: list[str]) -> dict[str, np.ndarray]:
    """The units of all texts: doc (index of the text), start, n, k1, k2, near (a paragraph), closes (it ends its
    text) and the band hashes."""
    h, counts, lines = told_hashes(texts)
    if not len(h):
        return {}
    begins = np.cumsum(counts) - counts
    s = np.sort(np.concatenate([begins[counts > 0], cuts(h, counts)]))
    blocks = [(d, a, n) for d, sizes in enumerate(lines) for a, n in paragraph_places(sizes)]
    block = np.array(blocks, np.int64).reshape(-1, 3)
    docs = np.concatenate([np.searchsorted(begins + counts, s, side="right"), block[:, 0]])
    isnear = np.arange(len(docs)) >= len(s)
    k = np.concatenate([np.diff(s, append=len(h)), block[:, 2]])
    s = np.concatenate([s, begins[block[:, 0]] + block[:, 1]])
    start = s - begins[docs]
    out = {"doc": docs, "start": start.astype(np.int32), "n": k.astype(np.int32), "near": isnear, "closes": start + k == counts[docs]}
    for name, seed in (("k1", 0x51), ("k2", 0xA7)):
        out[name] = stretch_hash(h, s, k, seed).view(np.int64)
    bands = np.zeros((BANDS, len(s)), np.int64)
    if len(blocks):
        size = k[isnear] - SHINGLE_WORDS + 1
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        every = shingle_hashes(h)  # shingles that run over a paragraph's end are not looked up
        bands[:, isnear] = sketches(every[np.repeat(s[isnear], size) + place], size).T
    return out | {f"b{i}": bands[i] for i in range(BANDS)}


def paragraphs(docs: DataFrame) -> DataFrame:
    """A row for each paragraph of (doc_id, text_hash, text); positions count the words of the text."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts = frame.column("text").to_pylist()
            for a, b in batches(texts, CHUNK_CHARS):
                found = units(texts[a:b])
                if found:
                    doc = pa.array(found.pop("doc") + a)
                    own = [frame.column(c).take(doc) for c in UNIT_NAMES[:2]]
                    yield pa.RecordBatch.from_arrays([*own, *[pa.array(found[c]) for c in UNIT_NAMES[2:]]], names=UNIT_NAMES)

    return docs.mapInArrow(run, UNIT)


UNIT_NAMES = [x.split()[0] for x in UNIT.split(", ")]


def told_shingles(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(key, shingles) of the paragraphs at (key, doc_id, text_hash, start, n)."""
    grouped = places.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("key", "start", "n")).alias("places"))
    grouped = cut(grouped, "places").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "places")
    found = docs.join(sized(grouped), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))).select("text", F.col("places.key").alias("keys"), F.col("places.start").alias("starts"), F.col("places.n").alias("ns"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            for a, b in batches(texts, CHUNK_CHARS):
                hashes, counts, _ = told_hashes(texts[a:b])
                every, own = shingle_hashes(hashes).view(np.int64), frame.iloc[a:b]
                sets = [once(every[f + s : f + s + n - SHINGLE_WORDS + 1]) for f, starts, ns in zip((np.cumsum(counts) - counts).tolist(), own["starts"], own["ns"], strict=True) for s, n in zip(starts.tolist(), ns.tolist(), strict=True)]
                yield pd.DataFrame({"key": np.concatenate(own["keys"].tolist()), "shingles": sets})

    return found.mapInPandas(run, "key long, shingles array<long>")


def near_labels(docs: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """(key, label) of the paragraphs that are near copies of others; keys are the first hashes of paragraphs."""
    texts = lines.groupBy(F.col("k1").alias("key")).agg(*[F.first(f"b{i}").alias(f"b{i}") for i in range(BANDS)])
    texts = cut(texts.select("key", F.array(*[f"b{i}" for i in range(BANDS)]).alias("bands")), "line-texts")
    buckets = texts.select("key", F.explode("bands").alias("bucket"))
    pivots = cut(buckets.groupBy("bucket").agg(F.min("key").alias("pivot"), F.count("*").alias("times")).filter("times > 1").drop("times"), "line-pivots")
    buckets = cut(buckets.join(sized(pivots), "bucket"), "line-buckets")
    pairs = cut(buckets.filter("key != pivot").select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct(), "line-pairs")
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "line-wanted")
    places = lines.join(sized(wanted), F.col("k1") == F.col("key")).groupBy("key").agg(F.min(F.struct("doc_id", "text_hash", "start", "n")).alias("p")).select("key", "p.*")
    sets = cut(told_shingles(docs, cut(places, "line-places")).dropDuplicates(["key"]), "line-sets")
    labels = components(cut(verified(pairs, sets, similarity), "line-links"), "lines")
    # members of a bucket that their pivot leaves apart: first in finer buckets, then exactly
    for pairs_of in (lambda left: finer_pairs(left, texts, BANDS), lambda left: exact_pairs(left, sets, similarity)):
        more = cut(verified(cut(pairs_of(opened(buckets, labels)), "line-pairs"), sets, similarity), "line-links")
        if more.limit(1).count():
            labels = joined(labels, more)
    return labels


def place_key(place: Column) -> Column:
    return F.concat_ws(":", F.coalesce(place["doc_id"].cast("string"), F.lit("-")), place["text_hash"].cast("string"))


def around(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(place, pos, right, words): hashes of the words right of each place of a text, or left of it from there outwards."""
    grouped = wanted.groupBy("place").agg(F.collect_list(F.struct("pos", "right")).alias("ends"))
    texts = docs.withColumn("place", place_key(F.struct("doc_id", "text_hash"))).join(sized(cut(grouped, "ends")), "place").select("place", "text", F.col("ends.pos").alias("pos"), F.col("ends.right").alias("right"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            told = frame["text"].tolist()
            for a, b in batches(told, CHUNK_CHARS):
                hashes, counts, _ = told_hashes(told[a:b])
                own, ends, found = frame.iloc[a:b], np.cumsum(counts).tolist(), []
                words = hashes.astype(np.uint32).view(np.int32)
                for begin, end, pos, right in zip([0, *ends[:-1]], ends, own["pos"], own["right"], strict=True):
                    for p, r in zip(pos.tolist(), right.tolist(), strict=True):
                        at = begin + p
                        found.append(words[at : min(at + REACH, end)] if r else words[max(begin, at - REACH) : at][::-1].copy())
                pos, right = np.concatenate(own["pos"].tolist()), np.concatenate(own["right"].tolist())
                yield pd.DataFrame({"place": np.repeat(own["place"].to_numpy(), own["pos"].map(len)), "pos": pos, "right": right, "words": found})

    return texts.mapInPandas(run, "place string, pos int, right boolean, words array<int>").dropDuplicates(["place", "pos", "right"])


def stretched(docs: DataFrame, islands: DataFrame) -> DataFrame:
    """(place, island, left, right): words by which islands (place, island, s, e, ends) go on at either side.

    ``ends`` are (right, own position, place and position of another occurrence).
    """
    ends = cut(islands.select("place", "island", F.explode("ends").alias("x")).select("place", "island", "x.*"), "island-ends")
    wanted = ends.select("place", F.col("own").alias("pos"), "right").union(ends.select("other", "at", "right")).distinct()
    words = cut(around(docs, wanted), "around")
    own = words.select("place", F.col("pos").alias("own"), "right", F.col("words").alias("a"))
    other = words.select(F.col("place").alias("other"), F.col("pos").alias("at"), "right", F.col("words").alias("b"))
    both = ends.join(own, ["place", "own", "right"]).join(sized(other), ["other", "at", "right"])
    alike = F.zip_with("a", "b", lambda x, y: F.coalesce(x == y, F.lit(False)))
    # a word that differs stands behind the last ones, so the first such place is told by one look
    length = (F.array_position(F.concat(alike, F.array(F.lit(False))), False) - 1).cast("int")
    longest = lambda r: F.coalesce(F.max(F.when(F.col("right") == r, F.col("length"))), F.lit(0))
    told = both.select("place", "island", "right", length.alias("length"))
    return told.groupBy("place", "island").agg(longest(False).alias("before"), longest(True).alias("after"))


def repeats(docs: DataFrame, *, similarity: float = SIMILARITY, words: int = PASSAGE_WORDS, common: int = 2) -> DataFrame:
    """(doc_id, text_hash, start_word, n_words, class_id, class_size, removed): each unit of passages of ``words`` or more.

    Of passages of fewer than ``SURE_WORDS`` only those are told that have a unit standing ``common`` times or more: what a few
    words between the edits of two versions of a text have in common stands twice, a licence line often.

    class_id is the smallest doc_id with a unit of the class, class_size its units; ``removed`` is false for the first
    occurrence only (by doc_id with nulls first, text hash, position). A class has units of at least two different
    documents; rows equal in doc_id and text are one document, so what repeats within one is left alone. Null and empty
    texts have no units; other columns are left out. An empty table gives no rows.
    """
    rows = only(docs, doc_id="long", text="string").dropna(subset=["text"]).withColumn("text_hash", F.xxhash64("text"))
    found = cut(paragraphs(rows.select("doc_id", "text_hash", "text")), "paragraphs")
    labels = near_labels(rows, found.filter("near"), similarity)
    # hashes alone tell which units stand in several documents; only these are looked at further
    of = F.xxhash64("doc_id", "text_hash")
    several = found.groupBy("k1").agg((F.min(of) != F.max(of)).alias("several")).filter("several").select("k1")
    several = cut(several.union(labels.select("key")).distinct(), "several")
    own = F.struct("doc_id", "text_hash", "start")
    several = sized(several, 2_500_000)  # one number a row
    met = cut(found.select("doc_id", "text_hash", "k1", "k2", "start", "n", "closes").join(several, "k1").distinct(), "met")
    each = met.groupBy("k1", "k2").agg(F.count("*").alias("times"), F.min(own).alias("first"), F.max(own).alias("last"))
    each = each.join(sized(labels), each.k1 == labels.key, "left").select("k1", "k2", "times", "first", "last", F.coalesce("label", "k1").alias("class"))
    each = cut(each, "repeated")
    place = lambda x: F.struct(x["doc_id"].alias("doc_id"), x["text_hash"].alias("text_hash"))
    classes = each.groupBy("class").agg(F.min("first").alias("class_first"), F.max("last").alias("class_last"), F.sum("times").alias("class_size")).filter(~place(F.col("class_first")).eqNullSafe(place(F.col("class_last"))))
    each = cut(each.join(classes.drop("class_last"), "class"), "classes")
    marked = met.join(sized(each), ["k1", "k2"])
    order = Window.partitionBy("doc_id", "text_hash").orderBy("start", "n")
    reach = F.max(F.col("start") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = marked.withColumn("opens", F.when(F.col("start") <= reach, 0).otherwise(1))
    islands = cut(opens.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", place_key(F.struct("doc_id", "text_hash"))), "islands")
    # the outermost units of each island that stand in several documents, with their first and last occurrence elsewhere
    exact = ~place(F.col("first")).eqNullSafe(place(F.col("last")))
    unit = F.struct("start", "n", "first", "last")
    spans = islands.groupBy("doc_id", "text_hash", "island").agg(F.first("place").alias("place"), F.min("start").alias("s"), F.max(F.col("start") + F.col("n")).alias("e"), F.max("closes").alias("closes"), F.max("class_size").alias("often"), F.min_by(unit, F.when(exact, F.col("start"))).alias("l"), F.max_by(unit, F.when(exact, F.col("start") + F.col("n"))).alias("r"))

    def sides(u: Column, right: bool, end: Column) -> Column:
        at = u["start"] + u["n"] if right else u["start"]
        some = [F.struct(F.lit(right).alias("right"), end.alias("own"), place_key(u[x]).alias("other"), (u[x]["start"] + (u["n"] if right else 0)).alias("at")) for x in ("first", "last")]
        return F.when(at == end, F.filter(F.array(*some), lambda x: x["other"] != F.col("place"))).otherwise(F.array().cast("array<struct<right:boolean,own:int,other:string,at:int>>"))

    spans = cut(spans, "spans")
    # nothing lies beyond the ends of a text
    none = F.array().cast("array<struct<right:boolean,own:int,other:string,at:int>>")
    left = F.when(F.col("s") > 0, sides(F.col("l"), False, F.col("s"))).otherwise(none)
    right = F.when(~F.col("closes"), sides(F.col("r"), True, F.col("e"))).otherwise(none)
    ends = spans.select("place", "island", F.concat(left, right).alias("ends"))
    beyond = cut(stretched(rows, ends), "beyond")
    length = F.col("e") - F.col("s") + F.col("before") + F.col("after")
    long = (length >= words) & ((length >= SURE_WORDS) | (F.col("often") >= common))
    spans = spans.select("place", "island", "s", "e", "often").join(sized(beyond), ["place", "island"], "left").fillna(0, ["before", "after"]).filter(long).drop("often")
    kept = islands.join(sized(cut(spans, "passages")), ["place", "island"])
    first = F.col("start") == F.col("s")
    start = F.col("start") - F.when(first, F.col("before")).otherwise(0)
    end = F.col("start") + F.col("n") + F.when(F.col("start") + F.col("n") == F.col("e"), F.col("after")).otherwise(0)
    return kept.select("doc_id", "text_hash", start.alias("start_word"), (end - start).alias("n_words"), F.col("class_first.doc_id").alias("class_id"), "class_size", (~own.eqNullSafe(F.col("class_first"))).alias("removed"))


def without_repeats(docs: DataFrame, *, words: int = PASSAGE_WORDS) -> DataFrame:
    """(doc_id, text) with the removed units cut out of the texts; rows equal in doc_id and text are cut alike.

    Null and empty texts stay as they are; an empty table gives no rows.
    """
    gone = repeats(docs, words=words).filter("removed").groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.collect_list(F.struct("start_word", "n_words")).alias("gone"))
    rows = only(docs, doc_id="long", text="string").withColumn("text_hash", F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left").select("doc_id", "text", F.col("gone.start_word").alias("starts"), F.col("gone.n_words").alias("ns"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [t if s is None or t is None else drop_words(t, s, n) for t, s, n in zip(frame["text"], frame["starts"], frame["ns"], strict=True)]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "text": texts})

    return rows.mapInPandas(run, "doc_id long, text string")


def drop_words(text: str, starts: list[int], ns: list[int]) -> str:
    """``text`` without the given stretches of words, and what stands between their words; adjacent ones are one stretch."""
    spans = [m.span() for m in re.finditer(WORD, text)]
    out, at, until = [], 0, -1
    for s, n in sorted(zip(starts, ns, strict=True)):
        if s > until:
            out.append(text[at : spans[s][0]])
        if s + n > until:
            at, until = spans[s + n - 1][1], s + n
    return "".join(out) + text[at:]
