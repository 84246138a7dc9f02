"""Byte-level BPE ids of whole texts, for use inside Arrow functions.

``byte_bpe_50k.json`` (library ``tokenizers``) and ``byte_bpe_50k.tiktoken``
(library ``tiktoken``) hold one vocabulary. Both libraries give the same ids,
which ``tests/llm/test_bpe.py`` checks on every Unicode code point in contexts;
``tiktoken`` needs a third of the CPU time, so it encodes all pieces of texts but
those in which a special string occurs and very long runs without white space.
These go to ``tokenizers`` itself, which a worker loads when it first meets one.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

VOCABULARY = "byte_bpe_50k"
#: Characters after which a long text is cut at the next safe boundary.
PIECE_CHARS = 32_768
#: UTF-8 bytes of text that are encoded in one call.
BATCH_BYTES = 1 << 20
#: A word is never cut: no token spans the place between a character that isn't
#: white space and a space, so the ids of the two sides are those of the whole.
_BOUNDARY = re.compile(r"(?<=\S)[ \n\t\r]")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def special_strings(vocabulary: str = VOCABULARY) -> list[str]:
    """The special strings that the vocabulary's file lists; the vocabulary itself isn't parsed."""
    with open(tokenizer_path(f"{vocabulary}.json"), encoding="utf-8") as file:
        text = file.read()
    listed = text.index("[", text.index('"added_tokens"'))
    return [token["content"] for token in json.JSONDecoder().raw_decode(text, listed)[0]]


def n_bytes(text: str) -> int:
    """The length of a text's UTF-8 form."""
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def safe_pieces(text: str, limit: int = PIECE_CHARS) -> list[str]:
    """Cuts a text into pieces of about ``limit`` characters whose ids, joined, are the text's ids."""
    if len(text) <= limit:
        return [text]
    pieces, start = [], 0
    while len(text) - start > limit:
        found = _BOUNDARY.search(text, start + limit)
        if not found:
            break
        pieces.append(text[start : found.start()])
        start = found.start()
    pieces.append(text[start:])
    return pieces


def byte_batches(texts: Iterable[str], limit: int = BATCH_BYTES) -> Iterator[list[tuple[int, str]]]:
    """Batches of (row, piece) that each hold about ``limit`` bytes; long texts are cut at safe boundaries."""
    batch, held = [], 0
    for row, text in enumerate(texts):
        for piece in safe_pieces(text):
            batch.append((row, piece))
            held += n_bytes(piece)
            if held >= limit:
                yield batch
                batch, held = [], 0
    if batch:
        yield batch


class Encoder:
    """Encodes texts to ids as ``tokenizers`` does with ``add_special_tokens=False``."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import public_tokenizers
        import tiktoken

        self.vocabulary = vocabulary
        self._specials = special_strings(vocabulary)
        with open(tokenizer_path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @property
    def n_vocab(self) -> int:
        """More than the greatest id that a text can give."""
        return self._fast.max_token_value + 1 + len(self._specials)

    @functools.cached_property
    def _library(self):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        return Tokenizer.from_file(tokenizer_path(f"{self.vocabulary}.json"))

    def _needs_library(self, piece: str) -> bool:
        return len(piece) > 4 * PIECE_CHARS or any(s in piece for s in self._specials)

    def _encode(self, pieces: list[str]) -> list[list[int]]:
        """The ids of each piece: one call of the batch function of ``tiktoken``, and one of ``tokenizers`` where that is needed."""
        rare = [k for k, piece in enumerate(pieces) if self._needs_library(piece)]
        if not rare:
            return self._fast.encode_ordinary_batch(pieces, num_threads=1)
        found = dict(zip(rare, self._library.encode_batch([pieces[k] for k in rare], add_special_tokens=False), strict=True))
        others = [k for k in range(len(pieces)) if k not in found]
        ids = dict(zip(others, self._fast.encode_ordinary_batch([pieces[k] for k in others], num_threads=1), strict=True))
        return [found[k].ids if k in found else ids[k] for k in range(len(pieces))]

    def encode_all(self, texts: Iterable[str], end_id: int) -> Iterator[np.ndarray]:
        """The ids of each text in turn, with ``end_id`` after them, encoded in batches balanced by bytes."""
        row, parts = 0, []
        end = np.array([end_id], dtype=np.uint32)
        for batch in byte_batches(texts):
            for (at, _), ids in zip(batch, self._encode([piece for _, piece in batch]), strict=True):
                if at != row:
                    yield np.concatenate([*parts, end])
                    row, parts = at, []
                parts.append(np.array(ids, dtype=np.uint32))
        if parts:
            yield np.concatenate([*parts, end])

    def encode(self, text: str) -> list[int]:
        return [i for ids in self._encode(safe_pieces(text)) for i in ids] if text else []

    def counts(self, texts: Iterable[str]) -> np.ndarray:
        """Token counts only, from batches balanced by bytes."""
        out: list[int] = []
        for batch in byte_batches(texts):
            for (row, _), ids in zip(batch, self._encode([piece for _, piece in batch]), strict=True):
                out += [0] * (row + 1 - len(out))
                out[row] += len(ids)
        return np.array(out, dtype=np.int64)


@functools.cache
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(vocabulary)
