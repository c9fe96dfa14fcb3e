"""Byte-level BPE: whole texts to token ids by the tiktoken library and a local rank file, and back to bytes."""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import map_texts

#: Pieces of long texts that go to the library at once, in characters.
CHUNK_CHARS = 1 << 16
#: No match of the pre-splitting pattern runs over such a place: a lone space between a
#: non-space and a non-space always begins a match.
SAFE = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=4)
def encoder(rank_file: str, pattern: str):
    """(Encoding, bytes of each id, decimal text of each id), once per process."""
    import tiktoken

    ranks = {}
    with open(rank_file, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    most = max(ranks.values(), default=-1)
    raw = [b""] * (most + 1)
    for token, rank in ranks.items():
        raw[rank] = token
    encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return encoding, raw, [str(i) for i in range(most + 1)]


def safe_chunks(text: str, size: int = CHUNK_CHARS) -> list[str]:
    """text cut before lone spaces into pieces of about `size`; where there is none, a piece is longer."""
    if len(text) <= size:
        return [text]
    pieces, start = [], 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size - 1)
        if cut is None:
            break
        pieces.append(text[start : cut.start()])
        start = cut.start()
    pieces.append(text[start:])
    return pieces


def encode(text: str | None, rank_file: str, pattern: str) -> list[int]:
    """Ids of a whole text, special tokens never recognised; null and empty texts have none."""
    encoding = encoder(rank_file, pattern)[0]
    ids: list[int] = []
    for piece in safe_chunks(text or ""):
        ids.extend(encoding.encode_ordinary(piece))
    return ids


def decode(ids: list[int], rank_file: str, pattern: str) -> bytes:
    """The raw bytes of the ids; they need not be valid UTF-8 for a part of a text."""
    raw = encoder(rank_file, pattern)[1]
    return b"".join([raw[i] for i in ids])


def encode_column(df: DataFrame, rank_file: str, pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df's columns `keep` (default: all but the text), `ids` array<int>, `n_tokens` long, and `decoded_sha256` of the bytes
    that the ids decode to. Columns of those names are replaced.

    Null and empty texts have no ids. Rows are independent, so repeated rows repeat; an empty table gives an empty one.
    """
    kept = [c for c in df.columns if c != text_col] if keep is None else keep

    def fn(text: str | None) -> tuple:
        ids = encode(text, rank_file, pattern)
        return ids, len(ids), hashlib.sha256(decode(ids, rank_file, pattern)).hexdigest()

    return map_texts(df, text_col, kept, "ids array<int>, n_tokens long, decoded_sha256 string", fn)


def round_trip(df: DataFrame, rank_file: str, pattern: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encodes, then decodes every whole text, and returns digests of both.

    Null text: no tokens, digests of nothing. Rows are independent, so repeated rows give
    repeated results; other columns are ignored. Result: id_col, n_tokens long, ids_sha256
    (decimal ids joined by commas), decoded_sha256 (decoded bytes).
    """

    def fn(text: str | None) -> tuple:
        _, _, decimal = encoder(rank_file, pattern)
        ids = encode(text, rank_file, pattern)
        written = ",".join([decimal[i] for i in ids]).encode()
        return len(ids), hashlib.sha256(written).hexdigest(), hashlib.sha256(decode(ids, rank_file, pattern)).hexdigest()

    return map_texts(df, text_col, [id_col], "n_tokens long, ids_sha256 string, decoded_sha256 string", fn)
