"""Byte-level BPE by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be joined by a merge, so a text
may be cut there, its fragments encoded on their own and the ids put one after the other.
Almost every word start is such a place, so fragments are short and repeat, and each worker
encodes a distinct fragment once (a bounded table). Ids equal those of encoding the whole text.

A cut must not change the split into pre-tokens either. It is therefore made only
- between characters, never inside one;
- after a character that is not white space (a run of white space looks at what follows it);
- not before an apostrophe (a contraction is only one at the start of a pre-token).
Special tokens count as vocabulary tokens, so their strings are never cut.

Nulls and empty texts have no ids: 0 tokens, the digest of nothing. Very long texts are
encoded whole. Rows are independent: repeated rows, ties, nulls in other columns, extra
columns and empty tables pass through as they are.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from gatecast.llm.common import per_text
from gatecast.llm.fragments import byte_characters, encoder

# Last bytes of the white space characters beyond ASCII (U+0085, U+00A0, U+1680, U+2000-U+200A, U+2028, U+2029,
# U+202F, U+205F, U+3000). No cut is made after any character that ends in one of them.
SPACE_ENDS = [0x80, 0x81, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id; a token that is not in the byte alphabet keeps its own UTF-8."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    vocabulary = dict(content["model"]["vocab"]) | {t["content"]: t["id"] for t in content["added_tokens"]}
    table = [b""] * (max(vocabulary.values()) + 1)
    alphabet = {c: b for b, c in enumerate(byte_characters())}
    for token, at in vocabulary.items():
        table[at] = bytes([alphabet[c] for c in token]) if all(c in alphabet for c in token) else token.encode()
    return table


@lru_cache(maxsize=2)
def forced(path: str) -> np.ndarray:
    """cut[left byte, right byte]: the pair occurs in no token, and the rules above allow a cut there."""
    cut = np.ones((256, 256), bool)
    for token in set(token_bytes(path)):
        codes = np.frombuffer(token, np.uint8)
        cut[codes[:-1], codes[1:]] = False
    cut[:33, :] = False  # after ASCII white space and control characters
    cut[SPACE_ENDS, :] = False
    cut[:, ord("'")] = False
    cut[:, 0x80:0xC0] = False  # before a byte inside a character
    return cut


def fragments(raw: bytes, cut: np.ndarray) -> list[bytes]:
    """The pieces of a text between certain cuts; joined they are the text."""
    if not raw:
        return []
    codes = np.frombuffer(raw, np.uint8)
    at = (np.flatnonzero(cut[codes[:-1], codes[1:]]) + 1).tolist()
    return [raw[a:b] for a, b in zip([0, *at], [*at, len(raw)])]


def encode(text: str, path: str) -> np.ndarray:
    """The ids of one whole text."""
    return np.frombuffer(encoder(path).encode(fragments(text.encode("utf-8", "replace"), forced(path))), "<u4")


def decode(ids: np.ndarray, path: str) -> str:
    """The text of ids, special tokens kept; bytes that are no UTF-8 become U+FFFD."""
    return b"".join(map(token_bytes(path).__getitem__, ids.tolist())).decode("utf-8", "replace")


def round_trip(text: Column, path: str) -> Column:
    """Per text: number of ids, SHA-256 of the ids, SHA-256 of the decoded text."""

    def one(whole: str) -> tuple[int, str, str]:
        ids = encode(whole, path)
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decode(ids, path).encode()).hexdigest()

    return per_text(one, "n_tokens long, ids_sha256 string, decoded_sha256 string")(text)


def encoded(text: Column, path: str) -> Column:
    """The ids of each text as an array of ints."""
    return F.pandas_udf(_batches(path), "array<int>").asNondeterministic()(text)


def _batches(path: str):
    from collections.abc import Iterator

    import pandas as pd

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([encode("" if t is None else t, path).astype(np.int32) for t in batch])

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return run
