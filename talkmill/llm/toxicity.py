"""Operator 10: toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence scores ``sigmoid(bias + weights of its features)``, or nothing if it has
no learned feature; the sentences' scores combine by noisy-or, ``1 - product(1 - score)``, into the document's. Only
document labels are known in training; the sentences that carry the score are the offending ones.

Features of a word are the word itself and its beginnings of 4 to 7 letters; the second and the third time that one
stands in a document are features of their own (of the sentence where that happens). They are picked by how much more
often toxic documents hold them, and weighed by gradient descent on the document likelihood.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.llm.common import cut, only, sample, sized

#: Labelled documents learned from (about so many, by the hashes of their doc_ids).
TRAIN_DOCS = 20_000
#: Documents that a feature needs, and how many standard errors its share in toxic documents must lie above that in others.
LEAST_DOCS, LEAST_Z = 5, 4.0
PREFIXES = (4, 5, 6, 7)
STEPS, RATE, DECAY = 400, 0.1, 2e-4
THRESHOLD = 0.7
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")
#: Words whose features a task remembers.
MEMO = 500_000


def features(word: str) -> list[str]:
    return ["=" + word, *[word[:n] for n in PREFIXES if len(word) >= n]]


def again(names: list[str], times: Counter[str]) -> list[str]:
    """The features of one word in its place: ``times`` counts them over the document so far."""
    out = []
    for f in names:
        times[f] += 1
        out += [f, "+" + f, "++" + f][: times[f]]
    return out


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of a bounded number of labelled documents outside the held-out third.

    Of rows with one doc_id the smallest text and the larger label count.
    """
    known = only(labels, doc_id="long", toxic="int").filter("toxic in (0, 1)").dropna().filter(~held_out())
    known = cut(sample(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), F.col("doc_id"), TRAIN_DOCS), "toxicity-known")
    texts = only(docs, doc_id="long", text="string").dropna().join(sized(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    # copies of a text would count its words as often as there are copies
    return texts.groupBy(F.md5("text").alias("key")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).drop("key")


def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of each class that hold each feature; the empty feature counts the documents."""
    counts: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
    for frame in frames:
        for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
            times: Counter[str] = Counter()
            for word, n in Counter(WORD.findall(text.lower())).items():
                for f in features(word):
                    times[f] += n
            counts[toxic].update({x for f, n in times.items() for x in (f, "+" + f, "++" + f)[:n]} | {""})
        if sum(map(len, counts.values())) > 2_000_000:
            yield flat(counts)
            counts = {0: Counter(), 1: Counter()}
    yield flat(counts)


def flat(counts: dict[int, Counter[str]]) -> pd.DataFrame:
    names = list(counts[0].keys() | counts[1].keys())
    return pd.DataFrame([(f, counts[1][f], counts[0][f]) for f in names], columns=["feature", "bad", "good"])


def bags(vocabulary: dict[str, int], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The features of each sentence that has any: toxic, sentences (how many features in each), features (end to end)."""
    for frame in frames:
        rows = []
        for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
            sizes, all_features, times = [], [], Counter()
            for sentence in SENTENCE.findall(text.lower()):
                found = sorted({vocabulary[f] for w in WORD.findall(sentence) for f in again(features(w), times) if f in vocabulary})
                if found:
                    sizes.append(len(found))
                    all_features += found
            rows.append((toxic, sizes, all_features))
        yield pd.DataFrame(rows, columns=["toxic", "sentences", "features"])


def end_to_end(lists: pd.Series) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *[np.asarray(x, np.int64) for x in lists]])


def fit(frame: pd.DataFrame, n: int) -> tuple[float, np.ndarray]:
    """Bias and weights that maximise the likelihood of the document labels under noisy-or."""
    toxic = frame["toxic"].to_numpy(np.float64)
    sizes, feature = end_to_end(frame["sentences"]), end_to_end(frame["features"])
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    doc = np.repeat(np.arange(len(frame)), [len(x) for x in frame["sentences"]])
    # the bias is the last parameter; a light pull to a low bias keeps sentences innocent without evidence
    x, mean, square = np.append(np.full(n, 0.5), -3.0), np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, STEPS + 1):
        z = x[n] + np.bincount(sentence, x[feature], len(sizes))
        evidence = np.bincount(doc, np.logaddexp(0, z), len(frame))
        none = np.exp(-evidence)
        slope = np.where(toxic > 0, -none / np.maximum(1 - none, 1e-9), 1.0)
        dz = slope[doc] / (1 + np.exp(-z))
        grad = np.append(np.bincount(feature, dz[sentence], n), dz.sum()) / max(len(frame), 1)
        grad[:n] += DECAY * x[:n]
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        x = x - RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
        x[:n] = np.maximum(x[:n], 0)  # features are evidence for toxicity only
    return float(x[n]), x[:n]


def fitted(names: list[str], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """feature, weight of those that weigh; the empty feature has the bias. The order of the rows makes no difference."""
    frame = pd.concat(list(frames), ignore_index=True)
    # numbers as bytes, the highest first, sort as the numbers do
    keys = [(t, np.asarray(s, ">i4").tobytes(), np.asarray(f, ">i4").tobytes()) for t, s, f in zip(frame["toxic"], frame["sentences"], frame["features"], strict=True)]
    bias, weights = fit(frame.iloc[sorted(range(len(frame)), key=keys.__getitem__)], len(names))
    found = [("", bias), *[(f, float(w)) for f, w in zip(names, weights, strict=True) if w > 1e-3]]
    yield pd.DataFrame(found, columns=["feature", "weight"])


def train(docs: DataFrame, labels: DataFrame) -> tuple[float, dict[str, float]]:
    """The bias and the features' weights. Without toxic or without clean documents nothing is learned."""
    rows = cut(training_rows(docs, labels), "toxicity-train")
    counts = rows.mapInPandas(counted, "feature string, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counts = cut(counts, "toxicity-counts")
    total = counts.filter("feature = ''").collect()
    if not total or not total[0].bad or not total[0].good:
        return -3.0, {}
    bad, good = float(total[0].bad), float(total[0].good)
    p, q = F.col("bad") / bad, F.col("good") / good
    share = (F.col("bad") + F.col("good")) / (bad + good)
    z = (p - q) / F.sqrt(share * (1 - share) * (1 / bad + 1 / good) + 1e-12)
    picked = counts.filter("feature != ''").filter((F.col("bad") + F.col("good") >= LEAST_DOCS) & (z >= LEAST_Z)).select("feature").collect()
    names = sorted(r.feature for r in picked)  # of a bounded sample
    if not names:
        return -3.0, {}
    made = rows.mapInPandas(partial(bags, {f: i for i, f in enumerate(names)}), "toxic int, sentences array<int>, features array<int>")
    # the sample is bounded, so one task fits it; the driver gets the weights only
    found = {r.feature: r.weight for r in made.repartition(1).mapInPandas(partial(fitted, names), "feature string, weight double").collect()}
    return found.pop(""), found


class Scorer:
    def __init__(self, bias: float, weights: dict[str, float]):
        self.bias, self.weights = bias, weights
        self.roots = {f.lstrip("+") for f in weights}
        self.known: dict[str, tuple[str, ...]] = {}

    def of(self, word: str) -> tuple[str, ...]:
        """The features of a word that weigh, once or repeated."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > MEMO:
                self.known.clear()
            found = self.known[word] = tuple(f for f in features(word) if f in self.roots)
        return found

    def score(self, text: str) -> tuple[float, int | None, int | None, float | None]:
        """The document's score, and begin, end and score of its worst sentence."""
        low = text.lower()
        of = self.of
        if not any(map(of, WORD.findall(low))):
            return 0.0, None, None, None
        same = len(low) == len(text)  # lower-casing can lengthen a text; then sentences are cut before it
        evidence, worst, times = 0.0, (-1.0, 0, 0), Counter()
        for m in SENTENCE.finditer(text):
            sentence = low[m.start() : m.end()] if same else m.group().lower()
            found = {f for w in WORD.findall(sentence) for f in again(of(w), times) if f in self.weights}
            if found:
                z = self.bias + sum(self.weights[f] for f in found)
                evidence += max(z, 0) + math.log1p(math.exp(-abs(z)))
                worst = max(worst, (1 / (1 + math.exp(-z)), -m.start(), -m.end()))
        if worst[0] < 0:
            return 0.0, None, None, None
        return 1 - math.exp(-evidence), -worst[1], -worst[2], worst[0]


def scored(docs: DataFrame, bias: float, weights: dict[str, float], columns: str = "doc_id long") -> DataFrame:
    """The given columns with score and the worst sentence's begin, end (code points) and score."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(bias, weights)
        for frame in frames:
            made = pd.DataFrame([scorer.score(t or "") for t in frame["text"]], columns=["score", "sentence_start", "sentence_end", "sentence_score"])
            made[["sentence_start", "sentence_end"]] = made[["sentence_start", "sentence_end"]].astype("Int64")
            yield pd.concat([frame.drop(columns="text").reset_index(drop=True), made], axis=1)

    return docs.mapInPandas(run, columns + ", score double, sentence_start long, sentence_end long, sentence_score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, and the worst sentence (sentence_start, sentence_end, sentence_score).

    Labels are learned only from rows outside the held-out third. A null or empty text, and one without any learned
    feature, scores 0 and has no worst sentence (nulls); of equal sentences the first counts. Null doc_ids stay null
    and are not held out; repeated rows give repeated rows; other columns are left out. An empty table gives no rows.
    """
    bias, weights = train(docs, labels)
    rows = only(docs, doc_id="long", text="string").select(F.col("doc_id").alias("doc_id"), held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    found = scored(rows, bias, weights, "doc_id long, held_out boolean")
    return found.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "sentence_start", "sentence_end", "sentence_score")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that are predicted to be toxic.

    Rows with null or empty texts stay, as do all rows where nothing can be learned; equal texts stay or go together.
    """
    bias, weights = train(docs, labels)
    texts = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("own_hash"))
    rows = only(docs, text="string").select(F.coalesce("text", F.lit("")).alias("text")).select(F.md5("text").alias("bad_hash"), "text")
    bad = cut(scored(rows, bias, weights, "bad_hash string").filter(F.col("score") >= THRESHOLD).select("bad_hash").distinct(), "toxic")
    return texts.join(sized(bad), texts["own_hash"] == bad["bad_hash"], "left_anti").select("row.*")
