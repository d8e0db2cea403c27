"""SentencePiece encoding against the library."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
import sentencepiece

from talkmill.llm import pieces

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "     ", " a", "a  b   c    d", "\n\n\t x \r\n", "▁", "▁▁ ▁x", "a▁b", "<s>", "</s> <unk> <0x41>", "日本語の テキスト", "🙂🙂 \U0001f9ff", "é é", "a\0b", "x" * 3000, "ab" * 500,
    "  x", "ﬁ ½ Ⅷ", "� ﻿", "aaaaaaaaaaaaaaaa", "    indented\n        more", "İstanbul ıI", "؟العربية", "한국어 텍스트", "0123456789 3.14159",
]


LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def wanted(text):
    ids = LIBRARY.encode(text or "", add_eos=True)
    shown = LIBRARY.decode(ids)
    return ids, shown, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()


def random_texts(n):
    rng = random.Random(11)
    letters = "aeinrst  ▁\n.,'0<>é日🙂́"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_equals_the_library(spark):
    texts = ODD + random_texts(400)
    rows = [(i if i % 7 else None, t, "x", 1) for i, t in enumerate(texts)] + [(3, texts[3], "x", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, agrees int")
    got = pieces.encode_decode(docs, PATH, with_ids=True, check=True).collect()
    assert sorted(repr((i, *wanted(t))) for i, t, _, _ in rows) == sorted(repr((r.doc_id, r.ids, r.decoded, r.ids_sha256, r.decoded_sha256)) for r in got)
    assert all(r.agrees and r.n_tokens == len(r.ids) for r in got)
    assert pieces.encode_decode(docs.limit(0), PATH, check=True).count() == 0


def test_all_documents_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = pieces.encode_decode(docs, PATH, check=True)
    assert got.filter("agrees").count() == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: (r.ids_sha256, r.decoded_sha256) for r in got.collect()} == {i: wanted(t)[2:] for i, t in texts.items()}


def test_a_wrong_part_is_told():
    encoder = pieces.PieceEncoder(PATH, check=True)
    right = encoder.model.ids
    encoder.model.ids = lambda text: [5] if text == "▁word" else right(text)
    try:
        encoder.encode(["one word here", "two of them", ""])
        assert encoder.agreed == [False, True, True]
        encoder.encode(["a word", "words"])
        assert encoder.agreed == [False, True]
    finally:
        del encoder.model.ids


def test_short_parts_are_merged_side_by_side(monkeypatch):
    """As by the heap, which short parts don't need any more."""
    model = pieces.Model(PATH)
    parts = sorted({p for t in ODD + random_texts(2000) if t for p in model.parts.findall(model.prefix + t.replace(" ", pieces.SPACE))} | {"\u2581" + "ab" * 200, ""})
    wanted = [model.ids(p) for p in parts]
    heaped, plain = [], model.merged
    monkeypatch.setattr(model, "merged", lambda text: heaped.append(text) or plain(text))
    model.prepare(parts)
    assert [model.ids(p) for p in parts] == wanted
    assert all(p == "" or len(p) > pieces.WIDTHS[-1] for p in heaped)


def test_long_texts_and_a_small_memory():
    encoder = pieces.PieceEncoder(PATH, memo=5)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in random_texts(60) + ["word und wort " * 40_000]:
        assert encoder.encode([text])[0].tolist() == library.encode(text)


def test_other_models_are_refused(tmp_path):
    piece = b"\x0a\x01a\x15" + struct.pack("<f", -1.0)
    unigram = b"\x0a" + bytes([len(piece)]) + piece + b"\x12\x02\x18\x01"
    path = tmp_path / "unigram.model"
    path.write_bytes(unigram)
    with pytest.raises(ValueError, match="not a model of merges"):
        pieces.Model(str(path))


def test_user_defined_pieces_stay_whole(tmp_path):
    """The public model with one more piece, a user's own."""
    with open(PATH, "rb") as f:
        data = f.read()
    own = b"\x0a\x06<tool>\x15" + struct.pack("<f", 0.0) + b"\x18\x04"
    path = str(tmp_path / "own.model")
    with open(path, "wb") as f:
        f.write(data + b"\x0a" + bytes([len(own)]) + own)
    library, encoder = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceEncoder(path)
    checked = pieces.PieceEncoder(path, check=True)
    for text in ["<tool>", "a<tool>b <tool> <tool", "x <tool><tool>", *random_texts(20)]:
        assert encoder.encode([text])[0].tolist() == library.encode(text) == checked.encode([text])[0].tolist()
        assert checked.agreed == [True]
