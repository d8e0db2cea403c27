"""Operator 3: byte-level BPE encoding and decoding with a pair occurrence index.

The distinct pre-tokens of a batch lie in one array of symbols, linked left and right. An index maps each rank
(a mergeable pair) to all the positions where that pair stands. Ranks are applied in ascending order: all the
occurrences of the lowest active rank merge at once, and the pairs that this makes are put into the index.
A pair made by a merge always has a higher rank than the merge itself, so one ascending pass ends with the same
tokens as merging each word by itself, lowest rank first and leftmost first.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from talkmill.llm.common import only

#: Fixed value: how byte-level BPE splits text before merging.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII only, in the faster standard module, whose own white space has four characters more.
PRE_TOKEN_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: Characters whose classes the standard module would look up one range after the other.
ASTRAL = re.compile("[\U00010000-\U0010ffff]")
#: Distinct pre-tokens that a task remembers between batches, and characters encoded at once.
MEMO_WORDS = 1_000_000
BATCH_CHARS = 4_000_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others follow from U+0100 in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def pre_token_bmp() -> re.Pattern[str]:
    """``PRE_TOKEN`` for texts without characters beyond U+FFFF, in the standard module, with the classes written out."""
    low = "".join(map(chr, range(2**16)))

    def ranges(kind: str) -> str:
        return "".join(f"\\u{m.start():04x}-\\u{m.end() - 1:04x}" for m in regex.finditer(kind + "+", low))

    letter, number, space = ranges(r"\p{L}"), ranges(r"\p{N}"), ranges(r"\s")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def once(x: np.ndarray) -> np.ndarray:
    """Sorted, each value once."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) > 1 else x


class Vocabulary:
    """A byte-level BPE vocabulary in the tokenizers library's JSON: ids, merges by rank, and added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = byte_letters(), spec["model"]
        vocab, self.added = model["vocab"], {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.of_byte = np.zeros(256, np.int32)
        for letter, b in letters.items():
            self.of_byte[b] = vocab[letter]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.left, self.right, self.size = left, right, size
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = left * size + right
        self.rank_of = np.argsort(keys, kind="stable")
        self.keys = np.append(keys[self.rank_of], np.int64(2**62))  # the last one keeps every lookup inside
        self.split = regex.compile(PRE_TOKEN)
        self.split_ascii = re.compile(PRE_TOKEN_ASCII)
        self.special = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; -1 where the pair doesn't merge."""
        key = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank_of[np.minimum(at, len(self.rank_of) - 1)], -1)

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, end to end, and how many each word has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        n = len(sym)
        word_of = np.repeat(np.arange(len(words)), lengths)
        at = np.arange(n, dtype=np.int64)
        same = np.zeros(n, bool)
        same[:-1] = word_of[1:] == word_of[:-1]
        after = np.where(same, at + 1, -1)
        before = np.full(n, -1, np.int64)
        before[1:][same[:-1]] = at[:-1][same[:-1]]
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(left: np.ndarray) -> None:
            """Index the pairs that begin at ``left``."""
            left = left[after[left] >= 0]
            rank = self.ranks(sym[left], sym[after[left]])
            left, rank = left[rank >= 0], rank[rank >= 0]
            if not len(left):
                return
            order = np.argsort(rank, kind="stable")
            left, rank = left[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, found in zip(rank[np.r_[0, cuts]].tolist(), np.split(left, cuts), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(found)

        enter(at)
        while active:
            r = heapq.heappop(active)
            left = np.concatenate(index.pop(r))
            a, b, made = self.left[r], self.right[r], self.made[r]
            left = left[alive[left] & (sym[left] == a) & (after[left] >= 0)]
            left = once(left[sym[after[left]] == b])
            if a == b and len(left) > 1:  # of overlapping pairs, the first, third, ... of a run merge
                follows = np.r_[False, after[left[:-1]] == left[1:]]
                place = np.arange(len(left))
                first = np.maximum.accumulate(np.where(follows, 0, place))
                left = left[(place - first) % 2 == 0]
            if not len(left):
                continue
            right = after[left]
            sym[left], alive[right] = made, False
            beyond = after[right]
            after[left] = beyond
            before[beyond[beyond >= 0]] = left[beyond >= 0]
            previous = before[left]
            enter(once(np.concatenate([left, previous[previous >= 0]])))
        return sym[alive], np.bincount(word_of[alive], minlength=len(words))

    def pieces(self, text: str) -> list[str]:
        return (self.split_ascii if text.isascii() else self.split if ASTRAL.search(text) else pre_token_bmp()).findall(text)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Places(dict):
    """Numbers the pre-tokens in the order met; ``new`` lists those not yet merged."""

    def __init__(self) -> None:
        self.new: list[str | tuple[int]] = []

    def __missing__(self, word: str | tuple[int]) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class Encoder:
    """Encodes batches of texts; remembers the ids of the pre-tokens it has met, up to a bound."""

    def __init__(self, path: str, memo: int = MEMO_WORDS):
        self.vocab, self.memo = vocabulary(path), memo
        self.forget()

    def forget(self) -> None:
        self.places = Places()
        self.ids, self.starts, self.counts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.vocab.merge_words([w.encode("utf-8", "replace") for w in words])

    def learn(self) -> None:
        """Merge all the new pre-tokens together; an added token, as (id,), is its id."""
        new, self.places.new = self.places.new, []
        if not new:
            return
        ids, counts = self.merge(["" if type(w) is tuple else w for w in new])
        if added := [(i, w[0]) for i, w in enumerate(new) if type(w) is tuple]:
            at, values = map(list, zip(*added, strict=True))
            ids = np.insert(ids, np.cumsum(counts)[at], values)
            counts[at] = 1
        starts = np.cumsum(counts) - counts + len(self.ids)
        self.ids, self.starts, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.starts, starts]), np.concatenate([self.counts, counts])

    def pieces(self, text: str) -> list[str | tuple[int]]:
        """Pre-tokens of a text. Added tokens are found first, as the library does."""
        vocab = self.vocab
        if not vocab.special or not vocab.special.search(text):
            return vocab.pieces(text)
        parts, end = [], 0
        for m in vocab.special.finditer(text):
            parts += vocab.pieces(text[end : m.start()])
            parts.append((vocab.added[m.group()],))
            end = m.end()
        return parts + vocab.pieces(text[end:])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.places) > self.memo:
            self.forget()
        number = self.places.__getitem__
        numbered = []
        for text in texts:
            pieces = self.pieces(text)
            numbered.append(np.fromiter(map(number, pieces), np.int32, len(pieces)))
        self.learn()
        return [self.gather(at) for at in numbered]

    def gather(self, at: np.ndarray) -> np.ndarray:
        counts = self.counts[at]
        if not len(at):
            return np.empty(0, np.int32)
        ends = np.cumsum(counts)
        return self.ids[np.arange(ends[-1]) + np.repeat(self.starts[at] - (ends - counts), counts)]


def decode(ids: np.ndarray, vocab: Vocabulary) -> str:
    """The text of ``ids``; bytes that are no UTF-8 become U+FFFD, ids outside the vocabulary nothing."""
    return b"".join(map(vocab.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def batches(texts: list[str], chars: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about so many characters; a longer text is a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > chars:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def encode_decode(docs: DataFrame, tokenizer: str, *, with_ids: bool = False) -> DataFrame:
    """Encode each whole text and decode it again.

    Returns doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256 and,
    with ``with_ids``, the ids and the decoded text. A null or empty text has no tokens; a null doc_id stays null;
    repeated rows give repeated rows; other columns are left out. No shuffle: each row is encoded where it is read.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(tokenizer)
        for frame in frames:
            texts = ["" if t is None else t for t in frame["text"].tolist()]
            for a, b in batches(texts):
                rows = []
                for ids in encoder.encode(texts[a:b]):
                    text = decode(ids, encoder.vocab)
                    row = (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
                    rows.append(row + ((ids, text) if with_ids else ()))
                out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids)
                out.insert(0, "doc_id", frame["doc_id"].iloc[a:b].astype("Int64").to_numpy(dtype=object, na_value=None))
                yield out

    return only(docs, doc_id="long", text="string").mapInPandas(run, schema)
