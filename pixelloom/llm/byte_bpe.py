"""Byte-level BPE with the tiktoken library and a local rank file.

Long texts are cut where the split pattern always has a boundary, so no match and
no merge is cut and the tokens are those of the whole text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of more characters are encoded in pieces of about so many.
PIECE_CHARS = 65_536
# Fixed value: the split pattern that texts may be cut for.
CUT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where every match of that pattern ends: a word, number or sign never runs on into a
#: space or line feed, and only runs of white space look ahead. Letters and digits never
#: share a match, nor do letters and signs after them. Letters, digits and signs are named
#: one by one, so the tables of no library matter.
SAFE = re.compile(r"(?<=\S)(?=[ \n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[\u4E00-\u9FA5\u3041-\u3096\u30A1-\u30FA\uAC00-\uD7A3])(?=[、。，！？；：「」（）])")
_encodings: dict[tuple[str, str], object] = {}


def load_encoding(rank_path: str, pattern: str):
    """The tiktoken encoding of a rank file, once for each worker process; no special tokens."""
    key = (rank_path, pattern)
    if key not in _encodings:
        import tiktoken

        with open(rank_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encodings[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` in pieces of at least ``size`` characters, cut at safe places only."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(encoding, text: str, size: int = PIECE_CHARS) -> np.ndarray:
    """Token ids of the whole text, as little-endian unsigned 32-bit integers.

    Texts are cut for :data:`CUT_PATTERN` only; with another pattern, or without a safe
    place, as in one long run of emoji, a text is encoded whole.
    """
    if len(text) <= size or encoding._pat_str != CUT_PATTERN:
        return np.array(encoding.encode_ordinary(text), "<u4")
    return np.concatenate([np.array(encoding.encode_ordinary(p), "<u4") for p in pieces(text, size)])


def bpe_encode(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col``: the text's token ids, packed as little-endian uint32 (BINARY).

    Null and empty texts have an empty value. ``ids_col`` replaces a column of its name;
    all others are kept. Rows that repeat are coded alike, an empty table stays empty.
    """

    @F.pandas_udf("binary")
    def packed(texts):
        encoding = load_encoding(rank_path, pattern)
        return texts.fillna("").map(lambda t: encode(encoding, t).tobytes())

    return docs.withColumn(ids_col, packed(F.col(text_col).cast("string")))


def bpe_decode(docs: DataFrame, rank_path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``docs`` with ``bytes_col``: the raw bytes of packed ids, valid UTF-8 or not (BINARY).

    Null ids give empty bytes. An id without a token raises KeyError, a length that isn't
    a multiple of four ValueError.
    """

    @F.pandas_udf("binary")
    def raw(ids):
        encoding = load_encoding(rank_path, pattern)
        return ids.map(lambda x: encoding.decode_bytes(np.frombuffer(x, "<u4").tolist()) if x else b"")

    return docs.withColumn(bytes_col, raw(F.col(ids_col)))


def bpe_digests(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode, and digest both: ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``.

    A row for each row of ``docs``, repeated and null ids included; other columns aren't read.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    coded = bpe_decode(bpe_encode(texts, rank_path, pattern), rank_path, pattern)
    return coded.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
