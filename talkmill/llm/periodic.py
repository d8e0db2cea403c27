"""Operator 12: periodic runs of words, by a vectorised scan of all lags.

The words of a text are numbered; their array is compared with itself, shifted by each lag up to n / ``EXPONENT``. A stretch
of equal places as long as a run needs is a run with that lag as its period, unless a smaller one explains it.

Two steps make this fast without losing any: of a shift, only every fourth of the places that a run needs is compared
first. A run covers at least four neighbouring places of that grid; where there are none, the shift is done, else all
its places are compared and their stretches measured.

A text of many words is the work of several machines: its number array is dealt out with ranges of lags, and what they
find comes together again by document. Other texts are scanned where they are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cmp_to_key
from itertools import compress, count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.llm.common import cut, only

#: Repetitions, and words, that a run has at least.
EXPONENT, LEAST_WORDS = 4, 6
#: Characters from which a text is dealt out, and lags of a range.
LONG_CHARS, LAGS = 60_000, 2_000
RUNS = "array<struct<start:long,length:long,period:long>>"
RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
NAMES = [x.split()[0] for x in RESULT.split(", ")]
#: (start, length, period)
Run = tuple[int, int, int]


def words_of(text: str | None, doc_id: int | None) -> list[bytes]:
    """The words between ASCII white space; of one document in ten, the later ones made to repeat, by a hash of its id."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * -(-(n - a) // p))[: n - a]


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for equal ones."""
    known: defaultdict[bytes, int] = defaultdict(count().__next__)
    return np.fromiter(map(known.__getitem__, words), np.int32, len(words))


def factors(q: int) -> list[int]:
    """The different prime factors."""
    out, f = [], 2
    while f * f <= q:
        if q % f == 0:
            out.append(f)
            while q % f == 0:
                q //= f
        f += 1
    return out + [q] * (q > 1)


def smallest(ids: np.ndarray, start: int, length: int, q: int) -> bool:
    """Whether no smaller period than ``q`` explains the stretch; in one of two periods or more it would divide ``q``."""
    own = ids[start : start + length]
    return not any(np.array_equal(own[q // f :], own[: length - q // f]) for f in factors(q))


def runs_of(ids: np.ndarray, low: int, high: int) -> list[Run]:
    """The runs whose periods are from ``low`` to ``high``."""
    n, out = len(ids), []
    for q in range(low, min(high, n // EXPONENT) + 1):
        need = max(LEAST_WORDS, EXPONENT * q) - q
        if need > n - q:
            continue
        step = max(1, need // 4)
        if (ids[q::step] == ids[: n - q : step]).tobytes().find(b"\1\1\1\1") < 0:
            continue
        same = np.zeros(n - q + 2, np.int8)
        np.equal(ids[q:], ids[: n - q], out=same[1:-1].view(bool))
        turns = np.flatnonzero(np.diff(same))
        begins, ends = turns[::2], turns[1::2]
        for b, e in zip(begins[ends - begins >= need].tolist(), ends[ends - begins >= need].tolist(), strict=True):
            if smallest(ids, b, e - b + q, q):
                out.append((b, e - b + q, q))
    return out


def stronger(x: Run, y: Run) -> int:
    """Order by exact length / period, largest first; ties by start, then period."""
    return (y[1] * x[2] - x[1] * y[2]) or (x[0] - y[0]) or (x[2] - y[2])


def result(doc_id: int | None, words: list[bytes], runs: list[Run]) -> tuple:
    told = "".join(f"{s},{n},{p}\n" for s, n, p in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = words
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for s, n, p in runs:
            change[s + p] += 1
            change[s + n] -= 1
        kept = list(compress(words, (np.cumsum(change[:-1]) == 0).tolist()))
        s, n, p = min(runs, key=cmp_to_key(stronger))
        best = (s, n, p, 1000 * n // p)
    else:
        best = (None,) * 4
    return (doc_id, len(runs), *best, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def frame_of(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=NAMES).astype({c: "Int64" for c in NAMES[:6]})


def ids_of(column: pd.Series) -> list[int | None]:
    return [None if pd.isna(i) else int(i) for i in column]


def short(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for i, text in zip(ids_of(frame["doc_id"]), frame["text"], strict=True):
            words = words_of(text, i)
            ids = numbered(words)
            rows.append(result(i, words, runs_of(ids, 1, len(ids))))
        yield frame_of(rows)


def arrays(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found = [numbered(words_of(t, i)) for i, t in zip(ids_of(frame["doc_id"]), frame["text"], strict=True)]
        yield pd.DataFrame({"key": frame["key"], "n": list(map(len, found)), "ids": [x.tobytes() for x in found]})


def scanned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found = [[{"start": s, "length": n, "period": p} for s, n, p in runs_of(np.frombuffer(ids, np.int32), low, high)] for ids, low, high in zip(frame["ids"], frame["low"].tolist(), frame["high"].tolist(), strict=True)]
        yield pd.DataFrame({"key": frame["key"], "runs": found})


def finished(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        own = [[] if r is None else [(x["start"], x["length"], x["period"]) for x in r] for r in frame["runs"]]
        yield frame_of([result(i, words_of(t, i), r) for i, t, r in zip(ids_of(frame["doc_id"]), frame["text"], own, strict=True)])


def periodic_runs(docs: DataFrame, *, long_chars: int = LONG_CHARS, lags: int = LAGS) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_runs, the strongest run (start, length, period, exponent_milli; nulls
    without any), and the digests of all runs and of the text with repetitions left out.

    A null text has no words, as an empty one; a null doc_id stays null, and its text as it is. Repeated rows give repeated
    rows; other columns are left out. An empty table gives no rows.
    """
    rows = only(docs, doc_id="long", text="string")
    long = F.coalesce(F.length("text") >= long_chars, F.lit(False))
    told = rows.filter(~long).mapInPandas(short, RESULT)
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text"))
    many = rows.filter(long).withColumn("key", key)
    held = many.dropDuplicates(["key"]).mapInPandas(arrays, "key string, n long, ids binary")
    dealt = held.withColumn("low", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.floor(F.col("n") / EXPONENT), F.lit(1)), F.lit(lags).cast("long")))).withColumn("high", F.col("low") + lags - 1)
    found = cut(dealt.repartition("key", "low").mapInPandas(scanned, f"key string, runs {RUNS}").filter(F.size("runs") > 0), "runs")
    runs = found.groupBy("key").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    return told.unionByName(many.join(runs, "key", "left").select("doc_id", "text", "runs").mapInPandas(finished, RESULT))
