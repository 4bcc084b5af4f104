"""Token counts of texts, by a public byte-level tokenizer whose file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranks file of the tokenizer; every executor reads it from its own installation.
TOKENIZER = os.environ.get("REGIMEFLOW_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Characters that one call to the tokenizer takes; longer texts are cut before white space, where tokens begin anew.
CHUNK = 50_000
#: Splitting rule of this vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str = TOKENIZER):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str) -> Iterator[str]:
    """The text in pieces of about CHUNK characters, each beginning at a single space between two words."""
    at = 0
    while len(text) - at > CHUNK:
        cut = text.find(" ", at + CHUNK)
        while cut > 0 and not (text[cut - 1].isalnum() and text[cut + 1 : cut + 2].isalnum()):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def count_tokens(text: str, path: str = TOKENIZER) -> int:
    enc = encoder(path)
    return sum(len(enc.encode_ordinary(p)) for p in pieces(text))


def with_tokens(df: DataFrame, text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """Adds `n_tokens`: tokens of the column `text`, which is dropped. A null or empty text has none."""
    rest = [c for c in df.columns if c != text]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [count_tokens(t, path) if t else 0 for t in b.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [*rest, "n_tokens"])

    schema = df.select(*rest).schema.add("n_tokens", "long")
    return df.select(*rest, F.col(text)).mapInArrow(count, schema)
