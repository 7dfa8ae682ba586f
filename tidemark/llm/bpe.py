"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are first cut where the splitting pattern must end a match anyway: in front of a white
space that follows another character. No match of the pattern spans such a place (a match holds
white space only at its start), so the parts encode to the same ids as the whole text.

Edge cases: a null or empty text has no id; a text of any length is encoded whole, in parts of
about ``PART`` characters; repeated rows are encoded each; an empty table gives an empty result;
further columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame

from tidemark.llm.common import map_rows

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Characters after which the next safe boundary is taken.
PART = 1 << 16

_boundary = re.compile(r"(?<=\S)(?=\s)")


def encoding(path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """The encoding of a local rank file, without special tokens."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART) -> Iterator[str]:
    """Cut a text at safe boundaries, each part the first to reach ``size`` characters."""
    at = 0
    while len(text) - at > size:
        found = _boundary.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def encode(bpe: tiktoken.Encoding, text: str | None, size: int = PART) -> np.ndarray:
    """The ids of a whole text as little-endian unsigned 32-bit integers."""
    return np.concatenate([np.array(bpe.encode_ordinary(p), dtype="<u4") for p in parts(text or "", size)])


def decode(bpe: tiktoken.Encoding, ids: np.ndarray, step: int = 1 << 16) -> bytes:
    """The bytes that ids stand for; they need not be valid UTF-8."""
    return b"".join(bpe.decode_bytes(ids[at : at + step].tolist()) for at in range(0, len(ids), step))


def _worker(path: str, pattern: str, each: Callable) -> Callable:
    def start() -> Callable:
        bpe = encoding(path, pattern)
        return lambda *columns: [each(bpe, *row) for row in zip(*columns, strict=True)]

    return start


def encode_documents(docs: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit integers) of every whole text."""
    return map_rows(docs, "doc_id long, ids binary", _worker(path, pattern, lambda bpe, i, t: (i, encode(bpe, t).tobytes())), "doc_id", "text")


def decode_documents(encoded: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and the bytes of each row of ids (null: none)."""
    return map_rows(encoded, "doc_id long, decoded binary", _worker(path, pattern, lambda bpe, i, ids: (i, decode(bpe, np.frombuffer(ids or b"", dtype="<u4")))), "doc_id", "ids")


def round_trip(docs: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text, encoded and decoded in one pass."""

    def each(bpe: tiktoken.Encoding, doc_id: int, text: str | None) -> tuple:
        ids = encode(bpe, text)
        return doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decode(bpe, ids)).hexdigest()

    return map_rows(docs, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _worker(path, pattern, each), "doc_id", "text")
