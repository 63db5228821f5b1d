"""Tokens as ids by merge ranks, where runs of word characters (``text.words``) aren't fine enough.

A tokenizer is named by the path of its ranks (a line a token: base64, blank, rank) and its pattern;
it is read once in each worker. ``BYTES`` in place of a path has no merges: every byte is a token.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

BYTES = ""
# Fixed value: how a text is cut before bytes are merged.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def encoding(path: str, pattern: str = PATTERN):
    import tiktoken

    if path == BYTES:
        ranks = {bytes([i]): i for i in range(256)}
    else:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def counter(path: str, pattern: str = PATTERN) -> Callable[[list[str]], list[int]]:
    """The number of ids of each text, as ``segment.listed`` takes it."""

    def count(texts: list[str]) -> list[int]:
        encode = encoding(path, pattern).encode_ordinary
        return [len(encode(x)) for x in texts]

    return count


def clamped(rows: DataFrame, text: str, n: int, path: str, pattern: str = PATTERN) -> DataFrame:
    """``rows`` with ``tokens``, the ids of the whole text, and the text cut after its ``n``-th id.

    What the last id leaves of a character comes back as U+FFFD. A null text stays null, tokens too;
    a text within ``n`` stays as it is. Special tokens' strings are ordinary text.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoding(path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 1000):  # Python copies of so many texts at a time
                own, tokens, cut = b.slice(at, 1000), [], []
                for x in own.column(text).to_pylist():
                    ids = None if x is None else tokenizer.encode_ordinary(x)
                    tokens.append(None if ids is None else len(ids))
                    cut.append(x if ids is None or len(ids) <= n else tokenizer.decode(ids[:n]))
                cols = [pa.array(cut, pa.string()) if c == text else own.column(c) for c in b.schema.names]
                yield pa.record_batch([*cols, pa.array(tokens, pa.int64())], names=[*b.schema.names, "tokens"])

    types = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(go, f"{types}, tokens long")
