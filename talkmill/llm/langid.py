"""Operator 9: language identification in two steps, first the family, then the language within it.

Whole texts become hashed counts of letter pairs and triples (lower-cased, anything but letters is one space). Linear
support vector machines, one against the rest, choose the family; within a family of several languages one machine
for each pair of them votes. All machines are fitted on the driver from a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.llm.common import cut, only, sized

# Families of languages by ISO 639-1 code. A language of no listed family is one by itself.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "baltic": "lt lv",
    "celtic": "ga cy gd br",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "semitic": "ar he mt",
    "indic": "hi bn mr ne pa gu ur",
    "sinitic": "zh",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
#: Size of the hashed counts; labelled documents learned from, in all (shared out evenly among the languages).
WIDTH = 4096
TRAIN_DOCS = 3000
STEPS, PENALTY = 150, 1e-4
#: How steeply margins turn into scores.
STEEP = 4.0
UNKNOWN = "und"
PRIMES = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
#: Which of the first code points are letters; others are looked up one by one.
LETTERS = np.array([chr(c).isalpha() for c in range(0x3000)])


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def vector(text: str) -> np.ndarray | None:
    """Square roots of the hashed counts, of length one; None for a text without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = LETTERS[np.minimum(codes, 0x2FFF)]
    far = np.flatnonzero(codes >= 0x3000)
    if len(far):
        kinds, back = np.unique(codes[far], return_inverse=True)
        letter[far] = np.array([chr(c).isalpha() for c in kinds.tolist()])[back]
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint32(32))
    codes = codes[letter | np.r_[True, letter[:-1]]]  # a run of other characters is one space
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint32)
    a, b, c = (codes * np.uint32(p) for p in PRIMES)
    two = (a[:-1] ^ b[1:]) * np.uint32(0x27D4EB2F)
    three = (a[:-2] ^ b[1:-1] ^ c[2:]) * np.uint32(0x165667B1)
    shift = np.uint32(32 - WIDTH.bit_length() + 1)
    counts = np.bincount(two >> shift, minlength=WIDTH) + np.bincount(three >> shift, minlength=WIDTH)
    x = np.sqrt(counts)
    return (x / np.sqrt((x * x).sum())).astype(np.float32)


def training_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang) of about ``TRAIN_DOCS`` labelled documents: for each language those whose doc_id hashes below
    a share of all hashes, so no language gathers in one task. Of rows with one doc_id the smallest text and language count.
    """
    known = only(docs, doc_id="long", lang="string").dropna().filter(~held_out())
    # a row for each language
    each = known.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("n")).withColumn("share", F.least(F.lit(1.0), F.lit(float(TRAIN_DOCS)) / F.count("*").over(Window.partitionBy()) / F.col("n")))
    place = F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5
    chosen = known.join(sized(each), "lang").filter((F.col("share") == 1.0) | (place < F.col("share"))).groupBy("doc_id").agg(F.min("lang").alias("lang"))
    texts = only(docs, doc_id="long", text="string").dropna().join(sized(cut(chosen, "langid-chosen")), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("lang").alias("lang"))


def examples(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Vectors of whole texts, and of one line of each, so that short texts are known, too."""
    for frame in frames:
        rows = []
        for doc_id, text, lang in zip(frame["doc_id"], frame["text"], frame["lang"], strict=True):
            lines = [x for x in text.split("\n") if x.strip()]
            for part in [text, *lines[doc_id % len(lines) :][:1]] if lines else []:
                if (x := vector(part)) is not None:
                    rows.append((doc_id, lang, x.astype(np.float16).tobytes()))
        yield pd.DataFrame(rows, columns=["doc_id", "lang", "x"])


def machine(x: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Weights (the last one is the bias) of a linear machine with squared hinge loss, classes weighing alike."""
    sign = sign.astype(np.float32)  # one wider operand would widen the whole matrix in each step
    share = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())).astype(np.float32)
    w, at = np.zeros(x.shape[1] + 1, np.float32), np.zeros(x.shape[1] + 1, np.float32)
    for t in range(STEPS):
        short = np.maximum(0, 1 - sign * (x @ at[:-1] + at[-1])) * share * sign
        grad = np.append(-2 * (x.T @ short) + PENALTY * at[:-1], -2 * short.sum())
        new = at - np.float32(0.25) * grad.astype(np.float32)
        at = new + np.float32(t / (t + 3)) * (new - w)
        w = new
    return w


class Model:
    """Machines for families and for pairs of languages within them."""

    def __init__(self, x: np.ndarray, langs: np.ndarray):
        names = sorted(set(langs))
        self.members: dict[str, list[str]] = {}
        for lang in names:
            self.members.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)
        self.families = sorted(self.members)
        family = np.array([FAMILY_OF.get(lang, lang) for lang in langs])
        several = len(self.families) > 1
        self.family_weights = np.array([machine(x, np.where(family == f, 1, -1)) for f in self.families]) if several else None
        self.pair_weights: dict[str, list[tuple[int, int, np.ndarray]]] = {}
        for f, own in self.members.items():
            made = []
            for i, j in combinations(range(len(own)), 2):
                rows = (langs == own[i]) | (langs == own[j])
                made.append((i, j, machine(x[rows], np.where(langs[rows] == own[i], 1, -1))))
            self.pair_weights[f] = made

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        score, family = 1.0, self.families[0]
        if self.family_weights is not None:
            margins = self.family_weights[:, :-1] @ x + self.family_weights[:, -1]
            best, second = np.argsort(-margins, kind="stable")[:2]
            family, score = self.families[best], sigmoid(margins[best] - margins[second])
        own = self.members[family]
        if len(own) > 1:
            wins, sums = np.zeros(len(own)), np.zeros(len(own))
            for i, j, w in self.pair_weights[family]:
                m = float(w[:-1] @ x + w[-1])
                wins[i if m >= 0 else j] += 1
                sums[i] += m
                sums[j] -= m
            best = max(range(len(own)), key=lambda k: (wins[k], sums[k], -k))
            return own[best], score * sigmoid(2 * sums[best] / (len(own) - 1))
        return own[0], score


def sigmoid(margin: float) -> float:
    return float(1 / (1 + np.exp(-STEEP * margin)))


def train(docs: DataFrame) -> Model | None:
    frame = training_rows(docs).mapInPandas(examples, "doc_id long, lang string, x binary").toPandas().sort_values(["doc_id", "x"])
    if not len(frame):
        return None
    x = np.frombuffer(b"".join(frame["x"]), np.float16).reshape(len(frame), WIDTH).astype(np.float32)
    return Model(x, frame["lang"].to_numpy(dtype=object))


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row; only the text is used for a prediction.

    A null text and one without letters are ``und`` with score 0, and so is every text if nothing is labelled. Of
    equal votes the larger sum of margins counts, then the first code. Null doc_ids stay null and are not held out;
    repeated rows give repeated rows; other columns are left out. An empty table gives no rows.
    """
    model = train(docs)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for text in frame["text"]:
                x = vector(text) if text and model else None
                found.append((UNKNOWN, 0.0) if x is None else model.predict(x))
            out = pd.DataFrame(found, columns=["lang_pred", "score"])
            yield pd.concat([frame[["doc_id", "held_out"]].reset_index(drop=True), out], axis=1)

    rows = only(docs, doc_id="long", text="string").select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")
