"""Byte-level BPE encoding and decoding with the tiktoken library.

Ranks come from a local rank file. A long text is cut before it reaches the
library, only where no match of the splitting pattern can span the cut, so that
its ids are those of the whole text. Decoding joins the tokens' raw bytes.

Defined results: a null text counts as empty and has no ids; null ids decode to
empty bytes; texts of any length are encoded whole; repeated rows are encoded
alike; an empty table gives an empty table. The caller
names the new columns of ``roundtrip``; an old column of such a name is replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.textops import list_array, slices

#: A text is cut near multiples of so many characters.
CUT_CHARS = 1 << 16


def safe_cuts(text: str, size: int = CUT_CHARS) -> list[str]:
    """Parts of a text, cut at safe boundaries near every ``size`` characters.

    Safe is a space or line end after an ASCII letter, digit or sign: a pattern
    match never holds white space after another character, and no lookahead reads
    past such a place. A stretch without a safe place stays whole.
    """
    if len(text) <= size:
        return [text]
    out, at, n = [], 0, len(text)
    while n - at > size:
        cut = at + size
        while cut < n and not (text[cut] in " \n" and "!" <= text[cut - 1] <= "~"):
            cut += 1
        out.append(text[at:cut])
        at = cut
    if at < n:
        out.append(text[at:])
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def encode_text(encoding, text: str) -> list[int]:
    parts = safe_cuts(text)
    if len(parts) == 1:
        return encoding.encode_ordinary(text)
    return [i for part in parts for i in encoding.encode_ordinary(part)]


def encode(text: Column, path: str, pattern: str) -> Column:
    """Token ids (array<int>) of a text column; ``path`` names a rank file present on every machine."""

    @F.arrow_udf("array<int>")
    def ids(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding = _encoding(path, pattern)
        for column in columns:
            found = [np.array(encode_text(encoding, t.as_py() or ""), dtype=np.int32) for t in column]
            values = np.concatenate(found) if found else np.empty(0, np.int32)
            yield list_array(values, [len(x) for x in found], pa.int32())

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """The bytes (binary) of each id list: tokens joined as raw bytes, valid UTF-8 or not."""

    @F.arrow_udf("binary")
    def raw(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token = {rank: piece for piece, rank in read_ranks(path).items()}.__getitem__
        for column in columns:
            out = []
            for a, b in slices([4 * (n or 0) for n in column.value_lengths().to_pylist()]):
                out += [b"".join(map(token, x or ())) for x in column[a:b].to_pylist()]
            yield pa.array(out, type=pa.binary())

    return raw(ids)


def roundtrip(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """df with the ids of ``text_col`` and the bytes that the ids decode to."""
    coded = df.withColumn(ids_col, encode(df[text_col], path, pattern))
    return coded.withColumn(bytes_col, decode(coded[ids_col], path))
