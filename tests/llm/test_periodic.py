"""Periodic runs against a plain version of their rules."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from talkmill.llm import periodic

SF = "/root/testdata/sf0.001"


def plain_words(text, doc_id):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def plain_runs(words):
    """Every maximal stretch of each period, without those that a smaller period explains."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            b = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            length = i - b + q
            if length >= max(6, 4 * q):
                own = words[b : b + length]
                if not any(all(own[k] == own[k + p] for k in range(length - p)) for p in range(1, q)):
                    found[b, length, q] = True
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain(doc_id, text):
    words = plain_words(text, doc_id)
    runs = plain_runs(words)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    told = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *four, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def shown(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def wordy(rng, n, kinds):
    return " ".join(rng.choice(kinds) for _ in range(n))


def odd_texts():
    rng = random.Random(7)
    out = [None, "", "   \n\t", "a", "a a a a a", "a a a a a a", "x y x y x y x y", "a b a b a b a", "la " * 50, "a b c " * 30 + "a b", "é é é é\x1cb " * 8, "A a " * 9]
    out += [wordy(rng, rng.randrange(1, 120), "ab") for _ in range(60)] + [wordy(rng, rng.randrange(1, 200), "abcdefgh") for _ in range(30)]
    for _ in range(30):
        unit = wordy(rng, rng.randrange(1, 9), "abcd")
        out.append(f"{wordy(rng, 20, 'abcdxyz')} {' '.join([unit] * rng.randrange(3, 7))} {wordy(rng, 20, 'abcdxyz')}")
    return out


def test_equals_the_plain_rules(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 6000")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = shown(periodic.periodic_runs(docs))
    assert found == sorted((plain(*r) for r in rows), key=repr)
    assert any(r[1] for r in found)


def test_odd_rows_and_ranges_of_lags(spark):
    rows = [(i if i % 9 else None, t, "x", 1) for i, t in enumerate(odd_texts())]
    rows += [(3, "a a a a a a a", "x", 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, runs int")
    want = sorted((plain(r[0], r[1]) for r in rows), key=repr)
    assert shown(periodic.periodic_runs(docs)) == want
    # every text dealt out, in ranges of three lags
    assert shown(periodic.periodic_runs(docs, long_chars=1, lags=3)) == want
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_the_grid_loses_no_run():
    rng = np.random.default_rng(5)
    for _ in range(400):
        ids = rng.integers(0, 2, rng.integers(1, 90)).astype(np.int32)
        assert sorted(periodic.runs_of(ids, 1, len(ids))) == sorted(plain_runs(ids.tolist()))


def test_a_very_long_text(spark):
    rng = random.Random(3)
    filler = [f"w{rng.randrange(5000)}" for _ in range(150_000)]
    unit = [f"u{i}" for i in range(9000)]
    words = filler[:70_000] + unit * 5 + filler[70_000:] + ["z"] * 40
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "a b")], "doc_id long, text string")
    found = {r.doc_id: r for r in periodic.periodic_runs(docs).collect()}
    assert zlib.crc32(b"1") % 10 and (found[1].n_runs, found[1].start, found[1].length, found[1].period) == (2, 195_000, 40, 1)
    kept = filler[:70_000] + unit + filler[70_000:] + ["z"]
    assert found[1].collapsed_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()
