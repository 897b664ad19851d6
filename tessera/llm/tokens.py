"""Byte-level BPE of whole texts, with a bounded memory of pieces already encoded.

A single space between two other characters always begins a pre-token, so a text can be cut there and the
pieces encoded on their own. Pieces repeat a lot; each worker keeps the ids of up to ``PIECES`` of them.
"""

from __future__ import annotations

import json
import os
from array import array

PIECES = 250_000
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder(dict):
    """Ids of texts as the tokenizer file gives them (no special tokens added), as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, ranks: str | None = None):
        self.path, self._tokenizer = path, None
        with open(path) as file:
            data = json.load(file)
        self.special = [t["content"] for t in data.get("added_tokens", ())]
        #: Characters of special tokens that aren't letters: a text isn't cut before one.
        self.special_marks = {c for t in self.special for c in t if not c.isalpha()}
        self._vocabulary, self._adjacent = data["model"]["vocab"], None
        self.piece = self.whole
        if ranks:  # the same vocabulary as ranks, which encodes short pieces faster
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            encode = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
            self.piece = lambda text: array("I", encode(text)).tobytes()

    @property
    def tokenizer(self):
        """The tokenizer itself, read when a text needs it."""
        if self._tokenizer is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
        return self._tokenizer

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = self.piece(" " + piece)
        if len(self) < PIECES and len(piece) < 64:
            self[piece] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if "  " in text or text[:1] == " " or text[-1:] == " " or any(s in text for s in self.special):
            return self.whole(text) if any(s in text for s in self.special) else self.piece(text)
        head, space, rest = text.partition(" ")
        ids = self.piece(head)
        return ids + b"".join(map(self.__getitem__, rest.split(" "))) if space else ids

    def adjacent(self, left: str, right: str) -> bool:
        """Whether a token of the vocabulary holds the last byte of one character and the first of the other side by side."""
        if self._adjacent is None:
            self._adjacent = {(a, b) for token in self._vocabulary for a, b in zip(token, token[1:], strict=False)}
            self._vocabulary = None
            # A vocabulary writes bytes that don't print as characters from 256 on, in order.
            plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
            other = iter(range(256, 512))
            self._written = [chr(b) if b in plain else chr(next(other)) for b in range(256)]
        return (self._written[left.encode()[-1]], self._written[right.encode()[0]]) in self._adjacent

    def count(self, text: str) -> int:
        """Number of ids."""
        if text[:1] == " " and "  " not in text and text[-1:] != " " and not any(s in text for s in self.special):
            return sum(map(len, map(self.__getitem__, text[1:].split(" ")))) // 4
        return len(self(text)) // 4


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, ranks: str | None = None) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    key = (path, ranks)
    if key not in _encoders:
        _encoders[key] = Encoder(path, ranks)
    return _encoders[key]


def vocabulary_files() -> tuple[str, str]:
    """The tokenizer file and the same vocabulary as ranks."""
    return vocabulary_path(), vocabulary_path("byte_bpe_50k.tiktoken")
