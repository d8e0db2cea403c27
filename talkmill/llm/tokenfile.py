"""Operator 8: token ids in binary blocks, by an adaptive context-mixing range coder.

A block holds up to ``BLOCK`` ids, is coded from a fresh state and checked by a CRC. Three predictions of the next id are
mixed into one distribution: order 2 names the id that followed the last two ids before, order 1 the two that followed
the last id, and order 0 gives every id its frequency in the block so far. How much each prediction weighs is learned
for each state of their confidences. One step of a 64-bit range coder then tells the id.

The ids of a block are dealt to lanes, stretches that are coded side by side, one id of each at a time, by one model
that all lanes teach. Everything is integer arithmetic (one quotient is taken as a double, exactly)
and of fixed order, so any machine decodes the same ids.

File format, little-endian: ``TMK5``, ids (u32), bound of the ids (u32), documents (u32), bytes of code (u32), ids of the
part before the block (u64), CRC-32 of all that is before and after it; for each document its number in the part (u64), piece (u32), ids
(u32) and doc_id (i64, with a u8 that is 0 for null); the code: the words of each lane (u32 each), then the words (u32).
Blocks are the rows of a Parquet table, so any executor can write and read them in any store.
"""

from __future__ import annotations

import codecs
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType
from tokenizers import Tokenizer

from talkmill.llm.bpe import Encoder, batches, byte_letters
from talkmill.llm.common import cut, only, sized
from talkmill.llm.pretokens import PAD, Numbers, starts

#: Ids of a block, most lanes, and ids of a lane where there are enough.
BLOCK, LANES, STEPS = 2**21, 8192, 256
#: Characters encoded at once, and distinct pre-tokens that a worker remembers.
BATCH_CHARS, MEMO_WORDS = 1_000_000, 700_000
END = 0
HEAD, ENTRY, CHECK = struct.Struct("<4sIIIIQ"), struct.Struct("<QIIqB"), struct.Struct("<I")
#: Bits of the frequencies: of all, of order 0 among itself; shares that order 0 gets of the mixture.
TOTAL_BITS, WHOLE_BITS, SHARES = 28, 22, 64
#: Steps between renewals of the order-0 frequencies and of the weights; slots of the order-2 table.
RENEW, WEIGH, SLOTS_BITS = 16, 4, 20
ID_BITS = 20
ID_MASK, STATES, SPAN = 2**ID_BITS - 1, 1024, 2**32 - 1
LOW32, U28, U32 = np.uint64(2**32 - 1), np.uint64(TOTAL_BITS), np.uint64(32)


@lru_cache(maxsize=1)
def transitions() -> tuple[np.ndarray, np.ndarray]:
    """What each prediction of a state is worth at first, and what becomes of a context's entries.

    The second has, for each state and prediction that told the id (3: order 0), the confidence of order 2 (from bit 20),
    whether the order-2 id stays (bit 23), the second id of order 1 stays (bit 24) and its two ids change places (bit 25),
    and the confidences of order 1 (from bits 26 and 29).
    """
    state = np.arange(STATES)
    second, first, other = state & 7, state >> 3 & 7, state >> 6 & 3
    same_a, same_b = (state >> 8 & 1) * (second > 0) * (first > 0), (state >> 9) * (second > 0) * (other > 0)
    worth = np.stack([(second > 0) * (1 + 2 * second), ((first > 0) & (same_a == 0)) * (1 + first), (other > 0) & (same_b == 0), np.full(STATES, 4)], axis=1).astype(np.int64)
    told = np.arange(4)
    second, first, other, same_a, same_b = (x[:, None] for x in (second, first, other, same_a, same_b))
    hit2 = (told == 0) & (second >= 0)
    hita, hitb = (told == 1) | hit2 & (same_a > 0), (told == 2) | hit2 & (same_b > 0)
    n2 = np.where(hit2, np.minimum(second + 1, 7), second >> 1)
    na = np.where(hita, np.minimum(first + 1, 7), first)
    nb = np.where(hita, other, np.where(hitb, other + 1, np.where(other > 1, other - 1, 1)))
    held = hita | hitb | (other > 1)
    # a second id that proves right often enough, or meets no first one, comes first
    swap = (first == 0) | (nb > 3)
    na, nb = np.where(swap, np.where(first > 0, 4, 1), na), np.where(swap, np.minimum(na, 3), nb)
    after = np.maximum(n2, 1) << 20 | (n2 > 0) << np.int64(23) | held << np.int64(24) | swap << np.int64(25) | na << 26 | nb << 29
    return worth, after.astype(np.int32).ravel()


class Mixture:
    """The predictions of orders 0 to 2 for all lanes, and what each has been worth.

    Table entries: order 2 an id, its confidence (3 bits) and a tag of the context; order 1 in each half an id and its
    confidence, of 3 and 2 bits. A state is the three confidences and whether order 2 agrees with the ids of order 1.
    """

    def __init__(self, bound: int):
        if not 0 < bound <= 2**ID_BITS:
            raise ValueError(f"ids must be below {2**ID_BITS}")
        self.bound = bound
        self.counts = np.zeros(bound, np.int64)
        self.pairs, self.two = np.zeros(bound, np.int64), np.zeros(2**SLOTS_BITS, np.int32)
        worth, self.after = transitions()
        self.worth = worth.copy()
        self.start, self.size = np.zeros(4 * STATES, np.int64), np.zeros(4 * STATES, np.int64)
        self.ids_met: list[np.ndarray] = []
        self.cells_met: list[np.ndarray] = []
        self.step, self.due = 0, 1
        self.renew()
        self.weigh(np.arange(STATES))

    def renew(self) -> None:
        """The order-0 frequencies from the counts so far; every id keeps one at least."""
        if self.ids_met:
            self.counts += np.bincount(np.concatenate(self.ids_met), minlength=self.bound)
            self.ids_met.clear()
        each = (((2**WHOLE_BITS - self.bound) << 32) // max(int(self.counts.sum()), 1))
        share = (self.counts * each >> 32) + 1
        share[0] += 2**WHOLE_BITS - int(share.sum())
        self.sums = np.concatenate([[0], np.cumsum(share)])
        self.spans = self.sums[:-1] << 32 | share
        # the id at each multiple of 16; the id sought stands there or little further on
        self.near = np.repeat(np.arange(self.bound, dtype=np.int32), np.diff(self.sums + 15 >> 4))

    def weigh(self, states: np.ndarray) -> None:
        """For these states, where the interval of each prediction begins and how wide it is."""
        worth = self.worth[states]
        named, rest = worth[:, 0] + worth[:, 1] + worth[:, 2], worth[:, 3]
        zero = np.where(named == 0, SHARES, np.clip((rest * SHARES + (named + rest) // 2) // (named + rest), 1, SHARES - 1))
        ends = np.zeros((len(states), 4), np.int64)
        whole, named = (SHARES - zero) << WHOLE_BITS, np.maximum(named, 1)
        ends[:, 1] = worth[:, 0] * whole // named
        ends[:, 2] = (worth[:, 0] + worth[:, 1]) * whole // named
        ends[:, 3] = whole  # 0 where no prediction is worth anything
        size = ends.copy()
        size[:, :3], size[:, 3] = ends[:, 1:] - ends[:, :3], zero
        self.start.reshape(STATES, 4)[states], self.size.reshape(STATES, 4)[states] = ends, size

    def look(self, last: np.ndarray, before: np.ndarray) -> None:
        """The predictions after the last id and the one before it, of each lane."""
        mixed = last.astype(np.uint32) * np.uint32(0x9E3779B1) + before.astype(np.uint32) * np.uint32(0x85EBCA6B)
        self.last, self.slot, self.tag = last, (mixed & np.uint32(2**SLOTS_BITS - 1)).astype(np.int64), ((mixed & np.uint32(0xFF << SLOTS_BITS)) << np.uint32(3)).view(np.int32)
        two, pair = self.two[self.slot], self.pairs[last]
        one, other = pair.astype(np.int32), (pair >> 32).astype(np.int32)
        self.c2, self.ca, self.cb = two & ID_MASK, one & ID_MASK, other & ID_MASK
        self.n2, self.na, self.nb = (two & 7 << ID_BITS) * (two ^ self.tag < 2**23), one & ~ID_MASK, other & ~ID_MASK
        k2 = self.n2 > 0
        cell = (self.n2 >> 18) + (self.na >> 15) + (self.nb >> 12) + ((self.c2 == self.ca) & k2) * np.int32(1024) + ((self.c2 == self.cb) & k2) * np.int32(2048)
        self.cell = cell.astype(np.int64)

    def named(self, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lanes whose id a prediction beside order 0 names, and which one; the first of these tells it."""
        hit2, hita, hitb = (now == self.c2) & (self.n2 > 0), (now == self.ca) & (self.na > 0), (now == self.cb) & (self.nb > 0)
        lanes = np.flatnonzero(hit2 | hita | hitb)
        return lanes, np.where(hit2[lanes], 0, np.where(hita[lanes], 1, 2))

    def name(self, lanes: np.ndarray, told: np.ndarray) -> np.ndarray:
        """The ids that these predictions name."""
        return np.where(told == 0, self.c2[lanes], np.where(told == 1, self.ca[lanes], self.cb[lanes]))

    def id_at(self, place: np.ndarray) -> np.ndarray:
        """The ids that order 0 has at these places."""
        found = self.near[place >> 4].astype(np.int64)
        left = np.flatnonzero(self.sums[found + 1] <= place)
        found[left] += 1
        left = left[self.sums[found[left] + 1] <= place[left]]
        found[left] = np.searchsorted(self.sums, place[left], side="right") - 1
        return found

    def learn(self, ids: np.ndarray, now: np.ndarray, cell: np.ndarray) -> None:
        """Take in the id of each lane, in 64 and in 32 bits, and its state and prediction."""
        # x ^ (x ^ y) & mask is y where the mask is set, else x
        after = self.after[cell]
        self.two[self.slot] = now ^ (now ^ self.c2) & -(after >> 23 & 1) | after & 7 << ID_BITS | self.tag
        other = now ^ (now ^ self.cb) & -(after >> 24 & 1)
        change = (self.ca ^ other) & -(after >> 25 & 1)
        one, other = self.ca ^ change | after >> 6 & 7 << ID_BITS, other ^ change | after >> 9 & 3 << ID_BITS
        self.pairs[self.last] = other.astype(np.int64) << 32 | one
        self.ids_met.append(ids)
        self.cells_met.append(cell)
        self.step += 1
        if self.step < RENEW or self.step % WEIGH == 0:
            met = np.bincount(np.concatenate(self.cells_met), minlength=4 * STATES).reshape(STATES, 4)
            self.cells_met.clear()
            self.worth += met
            self.weigh(np.flatnonzero(met.any(axis=1)))
        if self.step == self.due:
            self.renew()
            self.due += min(self.due, RENEW)


def lanes_of(n: int) -> tuple[int, int]:
    """Lanes of a block of ``n`` ids, and ids of each but the last, which may have fewer."""
    steps = -(-n // min(LANES, max(1, n // STEPS)))
    return -(-n // steps), steps


def coded(ids: np.ndarray, bound: int) -> bytes:
    """The code of a block of ids, all below ``bound``."""
    lanes, steps = lanes_of(len(ids))
    rows = np.zeros(lanes * steps, np.int64)
    rows[: len(ids)] = ids
    rows = np.ascontiguousarray(rows.reshape(lanes, steps).T)
    short = len(ids) - (lanes - 1) * steps
    model, room = Mixture(bound), steps + 3
    out = np.zeros(lanes * room, np.uint64)
    base = np.arange(lanes) * room
    every_low, every_at = np.zeros(lanes, np.uint64), base.copy()
    low, at, width = every_low, every_at, np.full(lanes, 2**64 - 1, np.uint64)
    last = before = np.zeros(lanes, np.int64)
    for t in range(steps):
        if t == short:
            low, at, width, last, before = low[:-1], at[:-1], width[:-1], last[:-1], before[:-1]
        now = rows[t, : len(low)]
        model.look(last, before)
        now32 = now.astype(np.int32)
        # as told by order 0, which most are, then those that another prediction names
        cell = model.cell | 3
        start, size, span = model.start[cell], model.size[cell], model.spans[now]
        start += (span >> 32) * size
        size *= span & SPAN
        lanes_named, told = model.named(now32)
        own = model.cell[lanes_named] + told
        cell[lanes_named], start[lanes_named], size[lanes_named] = own, model.start[own], model.size[own]
        part = width >> U28
        add = part * start.astype(np.uint64)
        low += add
        over = np.flatnonzero(low < add)  # a carry goes to the word before, and further at the end
        out[at[over] - 1] += np.uint64(1)
        width = part * size.astype(np.uint64)
        full = np.flatnonzero(width <= LOW32)
        out[at[full]] = low[full] >> U32
        at[full] += 1
        low[full] <<= U32
        width[full] <<= U32
        model.learn(now, now32, cell)
        last, before = now, last
    out[every_at], out[every_at + 1] = every_low >> U32, every_low & LOW32
    out = out.reshape(lanes, room)
    while (carry := out >> U32).any():
        out &= LOW32
        out[:, :-1] += carry[:, 1:]
    lengths = every_at + 2 - base
    return lengths.astype("<u4").tobytes() + out[np.arange(room) < lengths[:, None]].astype("<u4").tobytes()


def decoded(n: int, bound: int, code: bytes) -> np.ndarray:
    """The ``n`` ids of a block again."""
    lanes, steps = lanes_of(n)
    lengths = np.frombuffer(code, "<u4", lanes).astype(np.int64)
    words = np.append(np.frombuffer(code, "<u4", offset=4 * lanes), [0, 0]).astype(np.uint64)
    short = n - (lanes - 1) * steps
    model = Mixture(bound)
    at = np.cumsum(lengths) - lengths
    ahead, width = words[at] << U32 | words[at + 1], np.full(lanes, 2**64 - 1, np.uint64)
    at += 2
    last = before = np.zeros(lanes, np.int64)
    rows = np.zeros((steps, lanes), np.int64)
    for t in range(steps):
        if t == short:
            ahead, at, width, last, before = ahead[:-1], at[:-1], width[:-1], last[:-1], before[:-1]
        model.look(last, before)
        part = width >> U28
        value = np.minimum(ahead // part, np.uint64(2**TOTAL_BITS - 1)).astype(np.int64)
        cell = model.cell | 3
        start, size = model.start[cell], model.size[cell]
        lanes_named = np.flatnonzero(value < start)
        # numbers below 2**28 by numbers below 2**7: the quotient as a double, cut, is exact
        place = ((value - start) / size).astype(np.int64)
        place[lanes_named] = 0
        now = model.id_at(place)
        span = model.spans[now]
        start += (span >> 32) * size
        size *= span & SPAN
        own, given = model.cell[lanes_named], value[lanes_named]
        told = (given >= model.start[own + 1]).astype(np.int64) + (given >= model.start[own + 2])
        own += told
        cell[lanes_named], start[lanes_named], size[lanes_named], now[lanes_named] = own, model.start[own], model.size[own], model.name(lanes_named, told)
        ahead = ahead - part * start.astype(np.uint64)
        width = part * size.astype(np.uint64)
        full = np.flatnonzero(width <= LOW32)
        ahead[full] = ahead[full] << U32 | words[at[full]]
        at[full] += 1
        width[full] <<= U32
        rows[t, : len(now)] = now
        model.learn(now, now.astype(np.int32), cell)
        last, before = now, last
    return rows.T.ravel()[:n]


def packed(ids: np.ndarray, before: int, entries: list[tuple[int, int, int, int | None]]) -> bytes:
    """A block in the file format, of its ids, the ids before, and entries of number, piece, ids, doc_id."""
    bound = int(ids.max()) + 1
    code = coded(ids, bound)
    body = b"".join(ENTRY.pack(a, b, c, d or 0, d is not None) for a, b, c, d in entries) + code
    head = HEAD.pack(b"TMK5", len(ids), bound, len(entries), len(code), before)
    return head + CHECK.pack(zlib.crc32(body, zlib.crc32(head))) + body


def unpacked(block: bytes) -> tuple[np.ndarray, int, list[tuple[int, int, int, int | None]]]:
    """The ids, the ids before and the entries again; a block that fails its checksum raises ValueError."""
    head, start = block[: HEAD.size], HEAD.size + CHECK.size
    if len(block) < start or zlib.crc32(block[start:], zlib.crc32(head)) != CHECK.unpack_from(block, HEAD.size)[0] or head[:4] != b"TMK5":
        raise ValueError("a block of token ids is damaged")
    _, n, bound, docs, size, before = HEAD.unpack(head)
    entries = [ENTRY.unpack_from(block, start + k * ENTRY.size) for k in range(docs)]
    return decoded(n, bound, block[len(block) - size :]), before, [(a, p, c, d if known else None) for a, p, c, d, known in entries]


class LibraryEncoder(Encoder):
    """Splits texts as the tokenizer does, all at once, and has the tokenizers library encode each distinct pre-token once."""

    def __init__(self, path: str):
        super().__init__(path, MEMO_WORDS)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        # the library's own merging of a pre-token, without another search for pre-tokens in it
        self.tokenize = Tokenizer.from_file(path).model.tokenize
        letters = {b: letter for letter, b in byte_letters().items()}
        self.letters = "".join(letters[b] for b in range(256))
        self.splitter = re.compile(f"({self.vocab.special.pattern})") if self.vocab.special else None

    def forget(self) -> None:
        super().forget()
        self.numbers = Numbers()

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.merge_bytes([w.encode("utf-8", "replace") for w in words])

    def merge_bytes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        shown = codecs.charmap_decode(b"".join(words), "strict", self.letters)[0]
        ids: list[int] = []
        counts: list[int] = []
        end = 0
        for w in words:  # no list is kept for a word: Python's search for cycles would visit all of them again and again
            start, end = end, end + len(w)
            found = self.tokenize(shown[start:end])
            counts.append(len(found))
            ids += [t.id for t in found]
        return np.array(ids, np.int32), np.array(counts, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Added tokens are found first, as the library does."""
        if not self.splitter or not any(map(self.splitter.search, texts)):
            return self.encode_plain(texts)
        parts = [self.splitter.split(t) for t in texts]  # every second part is an added token
        flat = iter(self.encode_plain(["" if i % 2 else x for p in parts for i, x in enumerate(p)]))
        own = [[np.array([self.vocab.added[x]], np.int32) if i % 2 else ids for (i, x), ids in zip(enumerate(p), flat)] for p in parts]  # noqa: B905
        return [np.concatenate(ids) for ids in own]

    def encode_plain(self, texts: list[str]) -> list[np.ndarray]:
        if self.numbers.count > self.memo:
            self.forget()
        raw = [t.encode("utf-8", "replace") for t in texts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        joined, begins = b"".join([*raw, bytes(PAD)]), np.cumsum(sizes) - sizes
        at = starts(joined, begins[sizes > 0])
        lengths = np.diff(at, append=len(joined) - PAD)
        number, new = self.numbers.of(joined, at, lengths)
        if new:
            ids, counts = self.merge_bytes(new)
            places = np.cumsum(counts) - counts + len(self.ids)
            self.ids, self.starts, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.starts, places]), np.concatenate([self.counts, counts])
        # pre-tokens before each text, and ids before each of them
        before = np.concatenate([[0], np.cumsum(self.counts[number])])[np.append(np.searchsorted(at, begins), len(at))]
        ids = self.gather(number)
        return [ids[a:b] for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]


@lru_cache(maxsize=1)
def encoder_of(path: str) -> LibraryEncoder:
    """A worker's encoder, which later tasks find with the pre-tokens it has met."""
    return LibraryEncoder(path)


def write_blocks(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(part, n, block): the blocks in order of doc_id (nulls first, then by text hash), as a written table."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, encoder = TaskContext.get().partitionId(), encoder_of(tokenizer)
        number = before = held = 0
        ids_held: list[np.ndarray] = []
        entries: list[tuple[int, int, int, int | None]] = []

        def block() -> pd.DataFrame:
            nonlocal before, held
            ids = np.concatenate(ids_held)
            out = pd.DataFrame({"part": [part], "n": [len(ids)], "block": [packed(ids, before, entries)]})
            before, held = before + len(ids), 0
            ids_held.clear()
            entries.clear()
            return out

        for frame in frames:
            texts = ["" if t is None else t for t in frame["text"].tolist()]
            doc_ids = frame["doc_id"].astype("Int64").tolist()
            for a, b in batches(texts, BATCH_CHARS):
                for doc_id, ids in zip(doc_ids[a:b], encoder.encode(texts[a:b]), strict=True):
                    ids, piece = np.append(ids, END), 0
                    while len(ids):
                        take = ids[: BLOCK - held]
                        ids_held.append(take)
                        entries.append((number, piece, len(take), None if doc_id is pd.NA else int(doc_id)))
                        ids, held, piece = ids[len(take) :], held + len(take), piece + 1
                        if held == BLOCK:
                            yield block()
                    number += 1
        if held:
            yield block()

    rows = only(docs, doc_id="long", text="string").withColumn("of_text", F.xxhash64("text"))
    # texts of one doc_id, and those without one, are dealt by their hashes
    dealt = rows.repartitionByRange("doc_id", "of_text").sortWithinPartitions("doc_id", "of_text").select("doc_id", "text")
    return cut(dealt.mapInPandas(run, "part int, n long, block binary"), "token-blocks")


def times_x(crc: int, count: int) -> int:
    """``crc`` moved by ``count`` zero bytes, as a polynomial over GF(2)."""

    def product(a: int, b: int) -> int:
        out = 0
        for i in range(31, -1, -1):
            if a >> i & 1:
                out ^= b
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        return out

    power, result = 0x00800000, crc  # one zero byte
    while count:
        if count & 1:
            result = product(power, result)
        power, count = product(power, power), count >> 1
    return result


@pandas_udf(LongType())
def combined(crcs: pd.Series, sizes: pd.Series) -> pd.Series:
    """The CRC-32 of pieces that follow each other, of their CRCs and numbers of ids."""
    out = []
    for own, n in zip(crcs, sizes, strict=True):
        crc = int(own[0])
        for c, k in zip(own[1:], n[1:], strict=True):
            crc = times_x(crc, 4 * int(k)) ^ int(c)
        out.append(crc)
    return pd.Series(out, dtype="int64")


def read_blocks(blocks: DataFrame) -> DataFrame:
    """(part, number, piece, doc_id, start, n, crc) of each document's piece, decoded from the blocks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, block in zip(frame["part"], frame["block"], strict=True):
                ids, before, entries = unpacked(block)
                raw, at, rows = ids.astype("<u4"), 0, []
                for number, piece, n, doc_id in entries:
                    rows.append((part, number, piece, doc_id, before + at, n, zlib.crc32(raw[at : at + n].tobytes())))
                    at += n
                out = pd.DataFrame(rows, columns=["part", "number", "piece", "doc_id", "start", "n", "crc"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    return blocks.mapInPandas(run, "part int, number long, piece int, doc_id long, start long, n long, crc long")


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each row, read from the written blocks.

    A null or empty text is the end id alone; null doc_ids come first; rows of one doc_id follow by their text's hash;
    repeated rows are documents of their own. Other columns are left out. An empty table gives no rows.
    """
    blocks = write_blocks(docs, tokenizer)
    # one row for each written part
    parts = blocks.groupBy("part").agg(F.sum("n").alias("ids"))
    offsets = cut(parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("offset")), "token-parts")
    pieces = read_blocks(blocks).groupBy("part", "number").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("piece", "crc", "n"))).alias("p"))
    crc = F.when(F.size("p") == 1, F.col("p")[0]["crc"])
    whole = pieces.withColumn("ids_crc32", F.coalesce(crc, combined(F.col("p.crc"), F.col("p.n"))))
    return whole.join(sized(offsets), "part").select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
