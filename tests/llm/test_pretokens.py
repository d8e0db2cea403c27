"""Splitting and numbering of pre-tokens by arrays, and the places of ids in order 0."""

import random

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from talkmill.llm import bpe, pretokens, tokenfile

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "　", " ", "a", "re", "é", "ß", "'", "'s", "'ll", "'v", "1", "²", "٣", ".", "日本", "\0", "\x7f", "🙂", "𝐀", "\U0001e7ef", "́", "�"]


def odd_texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS[: rng.choice((7, 19, len(PARTS)))], k=rng.randrange(14))) for _ in range(n)]


@pytest.mark.parametrize("ascii_only", [True, False])
def test_starts_equal_the_pattern(ascii_only):
    texts = odd_texts(20_000, 1) + ["'", "x'", "'l", "'s", " 's", "''s", "'s's", "'re", "'r", "a　", "　a"]
    texts = [t for t in texts if t.isascii()] if ascii_only else texts
    raw = [t.encode() for t in texts]
    sizes = np.array([len(r) for r in raw])
    joined, begins = b"".join([*raw, bytes(pretokens.PAD)]), np.cumsum(sizes) - sizes
    got = pretokens.starts(joined, begins[sizes > 0])
    want = [w for t in texts for w in regex.findall(bpe.PRE_TOKEN, t)]
    ends = np.append(got[1:], sizes.sum())
    assert [joined[a:b].decode() for a, b in zip(got.tolist(), ends.tolist(), strict=True)] == want


def test_numbers_tell_words_apart():
    rng, numbers, known = random.Random(2), pretokens.Numbers(bits=4), {}
    words = [bytes(rng.choices(b"\0ab", k=rng.randrange(1, 40))) for _ in range(3_000)] + [b"w%d" % i for i in range(30_000)]
    for _ in range(12):
        told = rng.choices(words, k=rng.choice((1, 500, 20_000)))
        joined, lengths = b"".join(told) + bytes(pretokens.PAD), np.array([len(w) for w in told])
        got, new = numbers.of(joined, np.cumsum(lengths) - lengths, lengths)
        assert len(set(new)) == len(new) and not known.keys() & set(new)
        for w in new:
            known[w] = len(known)
        assert got.tolist() == [known[w] for w in told] and numbers.count == len(known)


def test_words_of_one_place_are_told_apart(monkeypatch):
    monkeypatch.setattr(pretokens.Numbers, "place", lambda self, keys: np.full(len(keys), 2**self.bits - 2))
    numbers, told = pretokens.Numbers(), [b"w%d" % (i % 40) for i in range(100)]
    joined, lengths = b"".join(told) + bytes(pretokens.PAD), np.array([len(w) for w in told])
    for _ in range(2):
        got, new = numbers.of(joined, np.cumsum(lengths) - lengths, lengths)
        assert len({*zip(got.tolist(), told, strict=True)}) == len(set(got.tolist())) == 40


def test_texts_are_split_without_a_string_for_each_pre_token(monkeypatch):
    library, encoder = Tokenizer.from_file(PATH), tokenfile.LibraryEncoder(PATH)
    monkeypatch.setattr(bpe.Vocabulary, "pieces", None)  # the pattern isn't asked
    monkeypatch.setattr(encoder, "memo", 2_000)  # and what is known is forgotten on the way
    texts = [t + " " + "x" * (i % 30) for i, t in enumerate(odd_texts(6_000, 3))] + ["", "<|endoftext|>", "a<|endoftext|> 's", "x" * 40_000, "\ud800"]
    for a in range(0, len(texts), 700):
        for text, ids in zip(texts[a : a + 700], encoder.encode(texts[a : a + 700]), strict=True):
            shown = text.encode("utf-8", "replace").decode()
            assert ids.tolist() == library.encode(shown, add_special_tokens=False).ids, repr(text)


def test_places_of_order_0_are_found_without_a_search_of_all():
    model, rng = tokenfile.Mixture(5_000), np.random.default_rng(4)
    model.ids_met.append(np.minimum(rng.geometric(0.01, 100_000), 4_999))
    model.renew()
    place = np.arange(2**tokenfile.WHOLE_BITS)
    assert (model.id_at(place) == np.searchsorted(model.sums, place, side="right") - 1).all()
    near = model.near[place >> 4]
    assert (near <= model.id_at(place)).all() and (near == model.id_at(place)).mean() > 0.9


def test_weights_follow_the_states_that_were_met():
    model, rng = tokenfile.Mixture(100), np.random.default_rng(6)
    last = before = np.zeros(500, np.int64)
    for step in range(1, 41):
        now = np.minimum(rng.geometric(0.2, 500), 99) * (rng.random(500) < 0.9)
        model.look(last, before)
        cell = model.cell | 3
        lanes, told = model.named(now.astype(np.int32))
        cell[lanes] = model.cell[lanes] + told
        assert (model.name(lanes, told) == now[lanes]).all()
        model.learn(now, now.astype(np.int32), cell)
        last, before = now, last
        if step < tokenfile.RENEW or step % tokenfile.WEIGH == 0:
            start, size = model.start.copy(), model.size.copy()
            model.weigh(np.arange(tokenfile.STATES))
            assert (start == model.start).all() and (size == model.size).all()
            # the predictions of a state share the whole range, and order 0 keeps a part
            assert (start.reshape(-1, 4)[:, 3] + (size.reshape(-1, 4)[:, 3] << tokenfile.WHOLE_BITS) == 2**tokenfile.TOTAL_BITS).all() and (size.reshape(-1, 4)[:, 3] > 0).all()
    assert len(lanes) > 100
