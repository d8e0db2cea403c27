"""Pre-tokens of many texts at once: found in their bytes and numbered by a table, without a Python object for each.

``starts`` splits UTF-8 as ``bpe.PRE_TOKEN`` does. That pattern looks no further than a run of one kind of characters and
its neighbours, so each byte tells by itself whether a pre-token starts there. ``Numbers`` compares whole pre-tokens,
never their hashes alone.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Bytes of a pre-token that its two keys hold; longer ones are kept in a dict.
KEY_BYTES = 15
#: Zero bytes needed behind the texts, so that a key can be read at every place.
PAD = 16
KEEP = np.array([2 ** (8 * k) - 1 for k in range(9)], np.uint64)
#: Odd factors that mix the keys to places in the table.
MIX, MIX_MORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of each code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def kinds_of(joined: bytes, data: np.ndarray) -> np.ndarray:
    """The kind of each byte's character."""
    out = np.frombuffer(bytearray(joined.translate(kinds()[:256].tobytes())), np.uint8)
    if joined.isascii():
        return out
    lead = np.flatnonzero(data >= 0xC0)
    first, second = data[lead].astype(np.int32), data[lead + 1].astype(np.int32) & 0x3F
    point = (first & 0x1F) << 6 | second
    long = np.flatnonzero(first >= 0xE0)
    point[long] = (first[long] & 0x0F) << 12 | second[long] << 6 | data[lead[long] + 2] & 0x3F
    longer = np.flatnonzero(first >= 0xF0)
    at = lead[longer]
    point[longer] = (first[longer] & 0x07) << 18 | second[longer] << 12 | (data[at + 2] & np.int32(0x3F)) << 6 | data[at + 3] & 0x3F
    kind = kinds()[point]
    out[lead] = out[lead + 1] = kind
    out[lead[long] + 2] = kind[long]
    out[at + 3] = kind[longer]
    return out


def starts(joined: bytes, begins: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in texts that lie end to end, begin at ``begins`` and are followed by ``PAD`` zero bytes."""
    n, data = len(joined) - PAD, np.frombuffer(joined, np.uint8)
    kind = kinds_of(joined, data)
    new = np.zeros(len(data), bool)
    new[begins] = new[n:] = True
    start = new.copy()
    start[1:] |= kind[1:] != kind[:-1]
    # white space before another character leaves it its last one; a space joins that character's pre-token
    last = (kind[:-1] == SPACE) & start[1:] & ~new[1:]
    start[1:] &= ~(last & (data[:-1] == 32))
    start[:-1] |= last
    if not joined.isascii():
        inside = np.flatnonzero(start & (data & 0xC0 == 0x80))
        start[inside] = False
        while len(inside):
            inside = inside - 1
            lead = data[inside] >= 0xC0
            start[inside[lead]] = True
            inside = inside[~lead]
    # 's 't 'm 'd 're 've 'll, where a pre-token starts with the apostrophe
    at = np.flatnonzero(start[:n] & (data[:n] == 39))
    at = at[~new[at + 1]]
    one, two = data[at + 1], data[at + 2]
    short = (one == 115) | (one == 116) | (one == 109) | (one == 100)
    long = ((((one == 114) | (one == 118)) & (two == 101)) | ((one == 108) & (two == 108))) & ~new[at + 2]
    start[at[short | long] + 1] = False
    start[at[short] + 2] = start[at[long] + 3] = True
    return np.flatnonzero(start[:n])


class Numbers:
    """Numbers pre-tokens in the order met. A table of open places holds their bytes as two keys, the second with their length."""

    def __init__(self, bits: int = 16) -> None:
        self.count, self.bits = 0, bits
        self.keys, self.number = np.zeros((2**bits, 2), np.uint64), np.zeros(2**bits, np.int32)
        self.long: dict[bytes, int] = {}

    def place(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys[:, 0] * MIX ^ keys[:, 1] * MIX_MORE
        mixed ^= mixed >> np.uint64(32)
        return (mixed * MIX >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each, -1 where it isn't known."""
        at = self.place(keys)
        # a row as one value of 16 bytes, which is only moved
        held = self.keys.view(np.complex128).ravel()[at].view(np.uint64).reshape(-1, 2)
        out = self.number[at]
        left = np.flatnonzero((held[:, 0] != keys[:, 0]) | (held[:, 1] != keys[:, 1]))
        empty = held[left, 1] == 0
        out[left[empty]] = -1
        left = left[~empty]
        while len(left):
            at[left] = at[left] + 1 & 2**self.bits - 1
            held = self.keys[at[left]]
            same, empty = (held == keys[left]).all(axis=1), held[:, 1] == 0
            out[left] = np.where(same, self.number[at[left]], -1)
            left = left[~(same | empty)]
        return out

    def enter(self, keys: np.ndarray, number: np.ndarray) -> None:
        """Take in distinct keys that aren't known; the table is at most a third full."""
        if 3 * (self.count + len(keys)) > 2**self.bits:
            used = np.flatnonzero(self.keys[:, 1])
            keys, number = np.concatenate([self.keys[used], keys]), np.concatenate([self.number[used], number])
            while 3 * (self.count + len(keys)) > 2**self.bits:
                self.bits += 1
            self.keys, self.number = np.zeros((2**self.bits, 2), np.uint64), np.zeros(2**self.bits, np.int32)
        at, left = self.place(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left], 1] == 0
            here = left[free]
            self.number[at[here]] = here  # of those that want one place, one gets it
            won = here[self.number[at[here]] == here]
            self.keys[at[won]] = keys[won]
            lost = np.ones(len(keys), bool)
            lost[won] = False
            left = left[lost[left]]
            at[left] = at[left] + 1 & 2**self.bits - 1
        self.number[at] = number

    def of(self, joined: bytes, at: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """The number of each pre-token, and those met for the first time, in the order of their new numbers."""
        every = np.ndarray(len(joined) - 7, "<u8", joined, 0, (1,))
        keys = np.empty((len(at), 2), np.uint64)
        keys[:, 0] = every[at] & KEEP[np.minimum(lengths, 8)]
        more = np.flatnonzero(lengths > 8)
        keys[:, 1] = lengths.astype(np.uint64) << np.uint64(56)
        keys[more, 1] |= every[at[more] + 8] & KEEP[np.clip(lengths[more] - 8, 0, 7)]
        out, new = self.find(keys), []
        far = np.flatnonzero(lengths > KEY_BYTES)
        out[far] = 0
        missing = np.flatnonzero(out < 0)
        if len(missing):
            order = missing[np.lexsort((keys[missing, 0], keys[missing, 1]))]
            first = np.r_[True, (keys[order[1:]] != keys[order[:-1]]).any(axis=1)]
            own = self.count + np.arange(int(first.sum()))
            out[order] = own[np.cumsum(first) - 1]
            order = order[first]
            self.enter(keys[order], own.astype(np.int32))
            new = [joined[a : a + n] for a, n in zip(at[order].tolist(), lengths[order].tolist(), strict=True)]
            self.count += len(new)
        for i, a, n in zip(far.tolist(), at[far].tolist(), lengths[far].tolist(), strict=True):
            word = joined[a : a + n]
            number = self.long.get(word)
            if number is None:
                number = self.long[word] = self.count
                self.count += 1
                new.append(word)
            out[i] = number
        return out, new
