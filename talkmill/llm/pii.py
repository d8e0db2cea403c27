"""Operator 7: personal data by weak supervision.

Fixed patterns give the base spans. Further spans are candidates: looser forms of the same kinds and names. For each
candidate, labelers of three sorts vote yes, no or not at all: a pattern (its shape), a gazetteer (known words beside
or in it) and the context (telling words before it). Expectation-maximisation estimates from the votes alone how
reliable each labeler is and how likely each candidate is personal data; a logistic classifier of the candidates'
features is then trained on those likelihoods, and its spans are added to the base ones.

Besides the votes, the classifier sees the span itself: its length, what stands before and after it. Both fits work on
counts of equal votes and features, gathered from all documents; their number is bounded by the labelers' and the
features' values, whatever the size of the input.
"""

from __future__ import annotations

import re
from bisect import bisect, bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.llm.common import cut, only

# The base kinds in their order, their patterns and limits; then the kinds that the method adds.
KINDS = ("email", "ip", "card", "phone", "at_email", "loose_phone", "account", "name")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits that fails from its first digit fails from each, so runs are entered at their first digit only.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Candidates of the added kinds. The local part of an address has at most 64 characters by its standard.
AT_EMAIL = re.compile(r"\b[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]+(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]+)+")
MASKED_AT = ("(at", "[at", "(AT", "[AT")
LOOSE_PHONE = re.compile(r"(?<![\w+.-])(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-])")
ACCOUNT = re.compile(r"\b(?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|[0-9]{3}-[0-9]{2}-[0-9]{4})\b")
NAME = re.compile(r"(?<!\w)(?:(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame)\.? )?[A-Z][a-z]{2,15} [A-Z][a-z]{2,15}(?!\w)")
#: Words that tell of personal data when they stand shortly before it, and words that tell against it.
TELLING = {
    "at_email": "email mail e-mail contact correo kontakt courriel write",
    "loose_phone": "phone tel telephone call mobile fax telefon cell whatsapp",
    "account": "iban account ssn konto bank compte cuenta social",
    "name": "name by author contact dear signed named called",
}
AGAINST = "version isbn page figure chapter license section table street university"
#: Given names for the gazetteer.
GIVEN = frozenset("james mary john robert michael william david richard linda susan thomas maria anna peter hans klaus jean pierre marie jose juan carlos ana luis carmen paul laura sarah emma".split())
DOMAINS = frozenset("com org net edu gov de fr es uk io info example".split())
BEFORE = 40
ROUNDS, STEPS, RATE, PENALTY = 60, 300, 0.3, 0.01
THRESHOLD = 0.8
SPAN = "array<struct<kind:int,start:int,end:int>>"
CANDIDATES = "array<struct<kind:int,start:int,end:int,code:int>>"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: at each @ the longest local part before it, and a domain after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield start, end
            at = text.find("@", end)
        else:
            end = max(end, at + 1)
            at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, in order."""
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


def votes(kind: str, text: str, start: int, end: int) -> int:
    """The votes of the three labelers (0 none, 1 no, 2 yes) and features of the span, as one code below 27 * 48.

    The features are a colon before it, a line's begin, its length in steps, and what follows: punctuation or an end, a
    word in lower case, anything else.
    """
    span, before = text[start:end], text[max(0, start - BEFORE) : start].lower()
    words = re.findall(r"[\w-]+", before)
    if kind == "at_email":
        shape, known = 2 if re.search(r"(?i)\bat\b", span) else 1, 2 if re.split(r"\W+", span.lower())[-1] in DOMAINS else 1
    elif kind == "loose_phone":
        shape, known = 2 if span.startswith("(") or len(set(re.findall(r"[ .-]", span))) == 1 else 0, 1 if "555" not in span else 2
    elif kind == "account":
        digits = sum(c.isdigit() for c in span)
        shape, known = 2 if digits == 9 or digits >= 12 else 1, 0
    else:
        titled = bool(re.match(r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame)\b", span))
        shape, known = 2 if titled else 0, 2 if any(w in GIVEN for w in span.lower().split()) else 1
    told = set(TELLING[kind].split())
    context = 1 if set(words[-4:]) & set(AGAINST.split()) else 2 if set(words[-4:]) & told else 0
    colon, line = int(before.rstrip(" ").endswith(":")), int(start == 0 or text[start - 1] == "\n")
    length, after = bisect([12, 18, 26], end - start), text[end : end + 2].strip(" ")[:1]
    follows = 1 if after.islower() else 2 if after.isalnum() else 0
    return ((shape * 3 + known) * 3 + context) * 48 + colon * 24 + line * 12 + length * 3 + follows


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, code) of candidates that touch no base span."""
    out, ends = [], []
    for a, _, b in taken:
        ends.append(max(b, ends[-1] if ends else 0))
    for kind, pattern in ((4, AT_EMAIL), (5, LOOSE_PHONE), (6, ACCOUNT), (7, NAME)):
        if kind == 4 and not any(x in text for x in MASKED_AT):
            continue
        for m in pattern.finditer(text):
            before = bisect_left(taken, (m.end(),))  # base spans that begin before the candidate's end
            if before and ends[before - 1] > m.start():
                continue
            code = votes(KINDS[kind], text, m.start(), m.end())
            if code // 48:
                out.append((m.start(), kind, m.end(), code))
    return sorted(out)


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, base, more) of each row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            base, more = [], []
            for text in frame["text"]:
                found = base_spans(text or "")
                base.append([{"kind": k, "start": a, "end": b} for a, k, b in found])
                more.append([{"kind": k, "start": a, "end": b, "code": c} for a, k, b, c in candidates(text or "", found)])
            yield pd.DataFrame({"doc_id": frame["doc_id"], "base": base, "more": more})

    return only(docs, doc_id="long", text="string").mapInPandas(run, f"doc_id long, base {SPAN}, more {CANDIDATES}")


def reliabilities(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The likelihood that a candidate of each code is personal data, by expectation-maximisation over the votes."""
    v = np.stack([codes // 432, codes // 144 % 3, codes // 48 % 3], axis=1)
    yes = np.clip((v == 2).sum(1) - (v == 1).sum(1), -1, 1) * 0.35 + 0.5
    for _ in range(ROUNDS):
        given = []
        for weight in (yes * counts, (1 - yes) * counts):
            table = np.array([[weight[v[:, j] == x].sum() + 1.0 for x in range(3)] for j in range(3)])
            given.append(np.log(table / table.sum(1, keepdims=True)) + 0)
        share = ((yes * counts).sum() + 1) / (counts.sum() + 2)
        score = np.log(share / (1 - share)) + sum(given[0][j, v[:, j]] - given[1][j, v[:, j]] for j in range(3))
        yes = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return yes


def features(kinds: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """One-hot votes, lengths and followers of each kind, the two plain features, and a constant."""
    parts = [np.ones(len(codes)), codes // 24 % 2, codes // 12 % 2]
    for kind in range(4, len(KINDS)):
        for j, values in ((432, 3), (144, 3), (48, 3), (3, 4), (1, 3)):
            for x in range(values):
                parts.append((kinds == kind) & (codes // j % values == x))
    return np.stack(parts, axis=1).astype(np.float64)


def classifier(kinds: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Weights of the span classifier, trained on the likelihoods of the votes, kind by kind."""
    target = np.zeros(len(codes))
    for kind in np.unique(kinds):
        own = kinds == kind
        target[own] = reliabilities(codes[own], counts[own])
    x, w = features(kinds, codes), np.zeros(3 + 16 * (len(KINDS) - 4))
    weight = np.log1p(counts)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= RATE * (x.T @ ((p - target) * weight) / weight.sum() + PENALTY * w)
    return w


def digest(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])))


def personal_data(docs: DataFrame) -> DataFrame:
    """One row for each row: doc_id, base and spans (arrays of kind, start, end by start, then kind).

    A null text counts as empty and has none; without any candidate nothing is added. Null doc_ids stay null;
    repeated rows give repeated rows; other columns are left out. An empty table gives no rows.
    """
    found = cut(scanned(docs), "pii")
    counts = found.select(F.explode("more").alias("m")).groupBy("m.kind", "m.code").agg(F.count("*").alias("n")).orderBy("kind", "code").collect()
    accepted: list[tuple[int, int]] = []
    if counts:
        kinds, codes, n = (np.array([r[i] for r in counts], np.int64) for i in range(3))
        w = classifier(kinds, codes, n.astype(np.float64))
        p = 1 / (1 + np.exp(-features(kinds, codes) @ w))
        accepted = [(int(k), int(c)) for k, c, x in zip(kinds, codes, p, strict=True) if x >= THRESHOLD]
    # kind and code together have a few thousand values
    good = F.lit(sorted(k * 10_000 + c for k, c in accepted)) if accepted else F.array().cast("array<int>")
    more = F.transform(F.filter("more", lambda m: F.array_contains(good, m["kind"] * 10_000 + m["code"])), lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    key = lambda x: F.struct(x["start"], x["kind"])
    spans = F.array_sort(F.concat("base", more), lambda x, y: F.when(key(x) < key(y), -1).when(key(x) > key(y), 1).otherwise(0))
    return found.select("doc_id", "base", spans.alias("spans"))
