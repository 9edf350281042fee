"""Encoding by independent fragments: a bounded table of known fragments in front of a tokenizers model."""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

MOST_KNOWN = 250_000  # fragments per generation and worker, some 50 MB
LONGEST_KNOWN = 48  # bytes of a fragment that is worth remembering

# Fragments of Latin letters, digits and marks that never start a contraction or a special token. They split into pre-tokens by
# character class alone, so the model's merges can run on the pieces directly; all others go through the whole tokenizer.
EASY_BYTE_LEVEL = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ0-9!\"#$%&()*+,./:;=>?@_|-]+")
PIECES_BYTE_LEVEL = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^ A-Za-zÀ-ÖØ-öø-ÿ0-9]+")
EASY_WORD_ENDS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ0-9!\"#$%&()*+,./:;=>?@_|-]+")
PIECES_WORD_ENDS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
STOPS = (b".", b",")


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the rest for characters from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Known(dict):
    """Ids of fragments as little-endian unsigned 32-bit bytes; a missing fragment is encoded.

    Two generations: a full table becomes the old one, from which fragments that are met again return.
    """

    def __init__(self, path: str, most: int | None = None):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        super().__init__()
        self.most = most or MOST_KNOWN
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.merge = self.whole.model.tokenize
        with open(path, encoding="utf-8") as file:
            self.lower = bool(json.load(file)["model"]["end_of_word_suffix"])  # this kind also lower-cases
        self.easy = (EASY_WORD_ENDS if self.lower else EASY_BYTE_LEVEL).fullmatch
        self.pieces = (PIECES_WORD_ENDS if self.lower else PIECES_BYTE_LEVEL).findall
        self.alphabet = dict(enumerate(byte_characters()))
        self.old: dict[bytes, bytes] = {}

    def __missing__(self, part: bytes) -> bytes:
        found = self.old.get(part)
        if found is None:
            found = self.fresh(part)
        if len(part) <= LONGEST_KNOWN:
            self[part] = found
        return found

    def fresh(self, part: bytes) -> bytes:
        body = part if self.lower or part[:1] != b" " else part[1:]
        if body.isalpha():  # ASCII letters only, which stand for themselves in the byte alphabet
            word = body.decode("ascii")
            word = word.lower() if self.lower else word if body is part else "Ġ" + word
            return array("I", [t.id for t in self.merge(word)]).tobytes()
        if self.lower and part[-1:] in STOPS and part[:-1].isalpha():
            return self[part[:-1]] + self[part[-1:]]
        text = part.decode("utf-8", "replace")
        if self.easy(text):
            ids = array("I")
            for piece in self.pieces(text.lower() if self.lower else text):
                ids.extend([t.id for t in self.merge(piece.encode().decode("latin-1").translate(self.alphabet))])
        else:
            ids = array("I", self.whole.encode(text, add_special_tokens=False).ids)
        return ids.tobytes()

    def encode(self, parts: list[bytes]) -> bytes:
        """The ids of all fragments, one after the other."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, parts))


@lru_cache(maxsize=2)
def encoder(path: str, most: int | None = None) -> Known:
    """One table per worker process and vocabulary file; later tasks of the worker find it filled."""
    return Known(path, most)
