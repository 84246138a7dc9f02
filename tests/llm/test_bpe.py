from __future__ import annotations

import pytest

pytest.importorskip("public_tokenizers")

from foliolake.llm import bpe


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path("byte_bpe_50k.json"))


def test_every_code_point_encodes_alike(library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    encoder = bpe.encoder()
    for at in range(0, len(points), 50_000):
        form = "a{0}a 1{0}1 {0} !{0}! {0}{0}\n{0}b" if at < 50_000 else "a{0}1 {0}\n{0}!"
        texts = [form.format(chr(c)) for c in points[at : at + 50_000]]
        found = library.encode_batch(texts, add_special_tokens=False)
        assert [f.ids for f in found] == encoder._encode(texts)


@pytest.mark.parametrize("text", ["", " ", "a", "<|endoftext|>", "x <|endoftext|>y", "word " * 30_000, "x" * 300_000, " \n\t " * 20_000, "é" * 70_000 + " b", "a " * 40_000, "it's 12'3 ''s\n\n  x"])
def test_texts_encode_as_the_library_does(library, text):
    assert bpe.encoder().encode(text) == library.encode(text, add_special_tokens=False).ids


def test_special_strings_are_those_of_the_library(library):
    assert bpe.special_strings() == [t.content for t in library.get_added_tokens_decoder().values()]


def test_counts_and_arrays_follow_the_texts(library):
    texts = ["", "a b", "word " * 30_000, "<|endoftext|> x " * 9000, "", "x" * 300_000, "end"]
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert bpe.encoder().counts(iter(texts)).tolist() == list(map(len, expected))
    assert [a.tolist() for a in bpe.encoder().encode_all(iter(texts), 2)] == [[*ids, 2] for ids in expected]


def test_batches_are_encoded_in_one_call_each(monkeypatch):
    encoder, calls = bpe.Encoder(), []
    monkeypatch.setattr(encoder, "_encode", lambda pieces: calls.append(sum(map(len, pieces))) or [[0]] * len(pieces))
    encoder.counts(["some words " * 10_000] * 50)
    assert len(calls) == 6 and max(calls) < 1.1 * min(calls[:-1])


def test_pieces_join_to_the_text_and_batches_are_bounded():
    text = "some words here\n" * 20_000
    pieces = bpe.safe_pieces(text, 1000)
    assert "".join(pieces) == text and max(map(len, pieces)) < 1100
    sizes = [sum(len(p) for _, p in batch) for batch in bpe.byte_batches([text, "", "a"] * 5)]
    assert max(sizes) < bpe.BATCH_BYTES + 2 * bpe.PIECE_CHARS
