"""Operator 13: encoding and decoding with merge-type SentencePiece models, by an agenda of symbol pairs.

A text's symbols are its characters, spaces written as U+2581 and one put before the text. The agenda holds every pair of
adjacent symbols that is a piece, ordered by score and then by place. The best pair becomes one symbol and its new pairs
enter the agenda, until it is empty. Characters that are no piece become bytes. The agendas of short parts are the rows of
a matrix, by place, and the best pairs of all rows merge at once; longer parts have a heap each.

No piece of such a vocabulary has a U+2581 after another character, so no pair ever crosses from a word to the space behind
it: a text is cut there, and each different part is encoded once for all texts of a task (up to a bound), and checked
against the library in the batch that brings it. Where a vocabulary has such pieces, texts are not cut.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame

from talkmill.llm.bpe import Encoder, batches
from talkmill.llm.common import only

#: Distinct parts of texts that a task remembers between batches.
MEMO_PARTS = 500_000
#: Widths of the matrices of short parts, and rows of one; longer parts are merged one by one.
WIDTHS, ROWS = (4, 6, 8, 10, 12, 16, 24, 32), 20_000
NO_PAIR = np.int32(2**31 - 1)
SPACE = "▁"
# Fixed values of the model file's format: kinds of pieces, and the type of models with merges.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGES = 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        elif tag & 7 == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[tag & 7]
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Model:
    """A SentencePiece model of the merge type, with byte fallback and without rules that rewrite texts."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            parts = list(fields(f.read()))
        pieces = [{1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(fields(v)) for k, v in parts if k == 1]
        trainer = dict(fields(next((v for k, v in parts if k == 2), b"")))
        rules = {2: b"", 3: 1, 4: 1, 5: 1} | dict(fields(next((v for k, v in parts if k == 3), b"")))
        kinds = [p[3] for p in pieces]
        if trainer.get(3, 1) != MERGES or not trainer.get(35) or trainer.get(24) or UNUSED in kinds:
            raise ValueError(f"{path}: not a model of merges with byte fallback, spaces in front and all pieces in use")
        if rules[2] or rules[4] or not rules[5]:
            raise ValueError(f"{path}: a model that rewrites texts")
        self.texts = [p[1].decode() for p in pieces]
        self.prefix = SPACE if rules[3] else ""
        # the smaller, the sooner: scores with their signs changed
        self.order = {t: (-struct.unpack("<f", p[2])[0], i) for i, (t, p) in enumerate(zip(self.texts, pieces, strict=True)) if p[3] in (NORMAL, USER_DEFINED)}
        self.of_byte = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.texts, kinds, strict=True)) if k == BYTE}
        self.end = trainer.get(42, 2)
        byte_of = {i: bytes([b]) for b, i in self.of_byte.items()}
        shown = {NORMAL, USER_DEFINED, BYTE}
        self.bytes = [byte_of.get(i, t.replace(SPACE, " ").encode()) if k in shown else b"" for i, (t, k) in enumerate(zip(self.texts, kinds, strict=True))]
        self.numerals = [str(i) for i in range(len(pieces))]
        own = sorted((t for t, k in zip(self.texts, kinds, strict=True) if k == USER_DEFINED), key=len, reverse=True)
        self.own = re.compile("|".join(map(re.escape, own))) if own else None
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", t) for t in self.order)
        self.parts = re.compile("(?s).+" if crossing else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        #: Whether the library, given a part as a text, must encode it as it does within texts.
        self.separable = bool(self.prefix) and not own and not crossing
        #: The ids of parts that ``prepare`` has merged.
        self.ready: dict[str, list[int]] = {}
        # symbols as numbers: a piece's id; behind these the characters, and one that stands for none
        size = len(pieces)
        self.none = size + 0x110000
        self.symbol = np.arange(size, self.none, dtype=np.int32)
        alone = {t: i for t, (_, i) in self.order.items() if len(t) == 1}
        self.symbol[list(map(ord, alone))] = list(alone.values())

        def number(t: str) -> int | None:
            return self.order[t][1] if t in self.order else int(self.symbol[ord(t)]) if len(t) == 1 else None

        pairs = [(a * (self.none + 1) + b, score, made) for t, (score, made) in self.order.items() for k in range(1, len(t)) if (a := number(t[:k])) is not None and (b := number(t[k:])) is not None]
        pairs.sort()
        self.keys = np.array([p[0] for p in pairs] + [2**62], np.int64)  # the last one keeps every lookup inside
        # equal scores are one rank, among which the place decides
        self.ranks = np.append(np.unique([p[1] for p in pairs], return_inverse=True)[1], NO_PAIR).astype(np.int32)
        self.made = np.array([p[2] for p in pairs] + [0], np.int32)

    def looked_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair of symbols and the place of what it makes; no rank where it is no piece."""
        key = a.astype(np.int64) * (self.none + 1) + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NO_PAIR), at

    def side_by_side(self, symbols: np.ndarray) -> np.ndarray:
        """What the agendas leave of parts, the rows of ``symbols``, each filled up with ``none``."""
        out, rows = np.full_like(symbols, self.none), np.arange(len(symbols))
        width = symbols.shape[1]
        agenda = self.looked_up(symbols[:, :-1], symbols[:, 1:])[0]
        place = np.arange(width - 1)
        while len(rows):
            best = agenda.argmin(1)
            on = agenda[np.arange(len(rows)), best] != NO_PAIR
            if not on.all():
                out[rows[~on]] = symbols[~on]
                rows, symbols, agenda, best = rows[on], symbols[on], agenda[on], best[on]
            own, beyond = np.arange(len(rows)), place > best[:, None]
            symbols[own, best] = self.made[self.looked_up(symbols[own, best], symbols[own, best + 1])[1]]
            symbols[:, :-1] = np.where(beyond, symbols[:, 1:], symbols[:, :-1])
            symbols[:, -1] = self.none
            agenda[:, :-1] = np.where(beyond[:, :-1], agenda[:, 1:], agenda[:, :-1])
            agenda[:, -1] = NO_PAIR
            for left in (best - 1, best):
                at = np.flatnonzero((left >= 0) & (left < width - 1))
                agenda[at, left[at]] = self.looked_up(symbols[at, left[at]], symbols[at, left[at] + 1])[0]
        return out

    def prepare(self, parts: list[str]) -> None:
        """Merge all the short parts side by side, so that ``ids`` has them ready."""
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        of = np.searchsorted(WIDTHS, sizes)
        for i, width in enumerate(WIDTHS):
            every = np.flatnonzero((of == i) & (sizes > 0))
            for chosen in np.split(every, range(ROWS, len(every), ROWS)) if len(every) else ():
                own = [parts[k] for k in chosen.tolist()]
                codes = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), "<u4")
                symbols = np.full((len(own), width), self.none, np.int32)
                symbols[np.arange(width) < sizes[chosen][:, None]] = self.symbol[codes]
                found = self.side_by_side(symbols)
                counts = (found != self.none).sum(1)
                flat, ends = found[found != self.none].tolist(), np.cumsum(counts).tolist()
                self.ready.update((t, flat[a:b]) for t, a, b in zip(own, [0, *ends[:-1]], ends, strict=True))
                # characters that are no piece
                for k in np.flatnonzero(((found >= len(self.texts)) & (found != self.none)).any(1)).tolist():
                    self.ready[own[k]] = [i for x in self.ready[own[k]] for i in ((x,) if x < len(self.texts) else self.bytes_of(chr(x - len(self.texts))))]

    def bytes_of(self, text: str) -> list[int]:
        return list(map(self.of_byte.__getitem__, text.encode("utf-8", "replace")))

    def merged(self, text: str) -> list[str]:
        """The symbols that the agenda leaves of a text."""
        order, symbols = self.order, list(text)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(found[0], i, 2) for i in range(n - 1) if (found := order.get(symbols[i] + symbols[i + 1]))]
        heapq.heapify(agenda)
        while agenda:
            _, i, size = heapq.heappop(agenda)
            j = after[i]
            # a pair whose symbols have changed since is out of date
            if j == n or not symbols[i] or len(symbols[i]) + len(symbols[j]) != size:
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := order.get(symbols[i] + symbols[k]):
                    heapq.heappush(agenda, (found[0], i, size + len(symbols[k])))
            if (h := before[i]) >= 0 and (found := order.get(symbols[h] + symbols[i])):
                heapq.heappush(agenda, (found[0], h, size + len(symbols[h])))
        return [s for s in symbols if s]

    def ids(self, text: str) -> list[int]:
        if (done := self.ready.get(text)) is not None:
            return done
        out = []
        for s in self.merged(text):
            found = self.order.get(s)
            out += (found[1],) if found else self.bytes_of(s)
        return out

    def decoded(self, ids: list[int]) -> str:
        """The text of ids that come from an encoded text, without the space put before it."""
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


@lru_cache(maxsize=2)
def library(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


class PieceEncoder(Encoder):
    """Encodes batches of texts; remembers the ids of the parts it has met, up to a bound.

    With ``check`` the sentencepiece library encodes each batch, too: every part when it is first met, or whole texts where
    parts are no texts by themselves. ``agreed`` tells of each text of the last batch whether all was alike.
    """

    def __init__(self, path: str, memo: int = MEMO_PARTS, *, check: bool = False):
        self.model, self.memo, self.check, self.library = model(path), memo, check, library(path) if check else None
        self.agreed: list[bool] = []
        self.forget()

    def forget(self) -> None:
        super().forget()
        self.wrong: set[int] = set()

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        self.model.prepare(words)
        found = list(map(self.model.ids, words))
        self.model.ready.clear()
        if self.check and self.model.separable:
            theirs = self.library.encode([w[1:].replace(SPACE, " ") for w in words], num_threads=1)
            alone = [self.library.piece_to_id(SPACE)]  # as a text it would be empty
            self.wrong.update(len(self.counts) + i for i, (w, a, b) in enumerate(zip(words, found, theirs, strict=True)) if a != (alone if w == SPACE else b))
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.int32, int(counts.sum())), counts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        self.agreed = []
        found = super().encode(texts)
        if self.check and not self.model.separable:
            theirs = self.library.encode(texts, num_threads=1)
            self.agreed = [a.tolist() == b for a, b in zip(found, theirs, strict=True)]
        return found

    def gather(self, at: np.ndarray) -> np.ndarray:
        self.agreed.append(self.wrong.isdisjoint(at.tolist()) if self.wrong else True)
        return super().gather(at)

    def pieces(self, text: str) -> list[str | tuple[int]]:
        """The parts of a text; a piece that the model's user has defined is one by itself and never merged."""
        if not text:
            return []
        m = self.model
        text = m.prefix + text.replace(" ", SPACE)
        if not m.own:
            return m.parts.findall(text)
        out, at = [], 0
        for found in m.own.finditer(text):
            out += m.parts.findall(text[at : found.start()])
            out.append((m.order[found.group()][1],))
            at = found.end()
        return out + m.parts.findall(text[at:])


def encode_decode(docs: DataFrame, path: str, *, with_ids: bool = False, check: bool = False) -> DataFrame:
    """Encode each whole text, with an end id, and decode it again.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded_sha256; with ``with_ids`` the ids and
    the decoded text; with ``check`` ``agrees``: whether the sentencepiece library encodes all parts of the text alike, in the same
    batch, and the decoded text is the text itself. A null text is an empty one, which has the end id only; a null doc_id stays null; repeated rows give
    repeated rows; other columns are left out. An empty table gives no rows. No shuffle: each row is encoded where it is
    read.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids + ", agrees boolean" * check

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = PieceEncoder(path, check=check)
        own = encoder.model
        for frame in frames:
            texts = ["" if t is None else t for t in frame["text"].tolist()]
            for a, b in batches(texts):
                rows = []
                encoded = encoder.encode(texts[a:b])
                for told, found, agreed in zip(texts[a:b], encoded, encoder.agreed, strict=True):
                    ids = [*found.tolist(), own.end]
                    text = own.decoded(ids)
                    row = (len(ids), hashlib.sha256(" ".join(map(own.numerals.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
                    rows.append(row + ((ids, text) if with_ids else ()) + ((agreed and text == told.replace(SPACE, " "),) if check else ()))
                out = pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")[1:]])
                out.insert(0, "doc_id", frame["doc_id"].iloc[a:b].astype("Int64").to_numpy(dtype=object, na_value=None))
                yield out

    return only(docs, doc_id="long", text="string").mapInPandas(run, schema)
