"""Byte-level BPE encoding and decoding (operator 1).

Encoding goes through the tiktoken library with a local rank file. A rank file is given by its path, or by its
name within the installed public_tokenizers package, and is loaded once in each Python worker.

Defined results: a null or empty text gives no ids, and no ids decode to no bytes; every row is encoded on its
own, so repeated rows give repeated results and an empty table an empty one; only the named columns are read, so
others may have any name. A text of any length is encoded whole: beyond LONG characters it is cut where the
pattern always ends a match, before a space or line break that follows a character other than white space, so
that the ids are those of the uncut text.

White space of more than RUN characters never meets the pattern, whose look-ahead would go back over all of it and
fail. For a pattern that ends in TAIL the match is known without it: such a run is one match, at the end of a text
whole, before anything else without its last character, with which the next match begins. With another pattern a
run as long raises ValueError, as tiktoken itself would for some hundred thousand characters.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tramline.llm.common import map_arrow, slices

#: Characters that a text may have before it is encoded piece by piece.
LONG = 1 << 16

#: Characters of white space in a row from which a run is cut out of its text.
RUN = 1 << 12

#: What a pattern ends in for which runs are cut out; it may have no other way to begin a match with two of \s.
TAIL = r"|\s+(?!\S)|\s+"

#: Python's \s contains all white space of the pattern's \s, so what \S matches is not white space there either.
_SAFE = re.compile(r"(?<=\S)(?=[ \n\t\r])")

# Fixed value: the characters with Unicode's property White_Space, which are the pattern's \s.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@functools.cache
def encoding(ranks: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file, without special tokens."""
    path = ranks
    if not os.path.isabs(ranks):
        import public_tokenizers

        path = public_tokenizers.path(ranks)
    with open(path, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=table, special_tokens={})


def safe_pieces(text: str, most: int = LONG) -> list[str]:
    """Pieces of about `most` characters, cut only at safe boundaries; a stretch without any stays whole."""
    if len(text) <= most:
        return [text]
    pieces, start = [], 0
    while len(text) - start > most:
        cut = _SAFE.search(text, start + most)
        if cut is None:
            break
        pieces.append(text[start : cut.start()])
        start = cut.start()
    pieces.append(text[start:])
    return pieces


@functools.cache
def _runs(length: int) -> re.Pattern:
    return re.compile(f"[{_SPACE}]{{{length},}}")


def parts_of(text: str, run: int = RUN) -> Iterator[tuple[str, bool]]:
    """The text cut around its long runs of white space, and whether a part is one match as a whole."""
    start = 0
    if len(text) >= run:
        for m in _runs(run).finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            yield text[start : m.start()], False
            yield text[m.start() : end], True
            start = end
    yield text[start:], False


def encode_text(enc: tiktoken.Encoding, text: str | None, most: int = LONG, run: int = RUN) -> np.ndarray:
    """The ids of one text as little-endian unsigned 32-bit integers."""
    ids = []
    for part, whole in parts_of(text or "", run):
        if whole:
            tail = enc._pat_str.removesuffix(TAIL)
            if tail == enc._pat_str or r"\s*" in tail or r"\s+" in tail:
                raise ValueError(f"white space of {len(part)} characters and a pattern without {TAIL}")
            ids.append(np.array(enc._encode_single_piece(part), "<u4"))
        elif part:
            ids += [enc.encode_to_numpy(p, disallowed_special=()) for p in safe_pieces(part, most)]
    if not ids:
        return np.empty(0, "<u4")
    return (ids[0] if len(ids) == 1 else np.concatenate(ids)).astype("<u4", copy=False)


def encode(df: DataFrame, keys: Sequence[str], ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """keys, n_tokens long and token_ids binary (little-endian unsigned 32-bit integers), a row for each row."""
    keys = list(keys)
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType())])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks, pattern)
        for batch in slices(batches):
            ids = [encode_text(enc, t) for t in batch.column(len(keys)).to_pylist()]
            counts = pa.array([len(x) for x in ids], pa.int64())
            packed = pa.array([x.tobytes() for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], counts, packed], names)

    return map_arrow(df.select(*keys, text), run, schema)


def decode(df: DataFrame, keep: Sequence[str], ranks: str, pattern: str, ids: str = "token_ids") -> DataFrame:
    """The columns of keep, and decoded binary: the raw bytes of the ids, which need not be valid UTF-8."""
    keep = list(keep)
    schema = T.StructType([df.schema[k] for k in keep] + [T.StructField("decoded", T.BinaryType())])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks, pattern)
        for batch in slices(batches):
            raw = [enc.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(raw, pa.binary())], names)

    return map_arrow(df.select(*keep, ids), run, schema)
