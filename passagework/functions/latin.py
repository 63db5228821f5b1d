"""The tokens of ``text.words`` for texts of Latin letters, a batch at a time, by tables of bytes.

A text is one of these where no character lies beyond U+017F or is U+0130, whose lower case is two
characters. All others are left to ``text.words``.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

END, DOTTED = 0x180, 0x130


def is_latin(text: Column) -> Column:
    return ~text.rlike(rf"[\x{{{DOTTED:x}}}\x{{{END:x}}}-\x{{10ffff}}]")


@functools.cache
def _tables() -> tuple[bytes, bytes, bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Of a byte: its lower case, whether it is of a token, and the ASCII bytes that aren't; of a code point:
    whether it is of a token, and its lower case as two bytes, or none where it is of no token."""
    known = [chr(c) for c in range(END)]
    inside = np.array([unicodedata.category(c)[0] in "LN" for c in known])
    pairs = np.array([list(c.lower().encode()[-2:].rjust(2, b"\0")) for c in known], np.uint8) * inside[:, None]
    lower = bytes(range(256)).lower()
    return lower, bytes(inside[:128]) + bytes(128), bytes(np.flatnonzero(~inside[:128]).tolist()), inside, pairs[:, 0].copy(), pairs[:, 1].copy()


def words(texts: pa.Array) -> pa.ListArray:
    """The tokens of each text, in lower case. No text is null."""
    texts = texts.cast(pa.string())
    lower, of_token, others, inside, lead, last = _tables()
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = (texts.buffers()[2] or pa.py_buffer(b"")).slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes()
    ends = ends - ends[0]
    out, own = (np.frombuffer(bytearray(raw.translate(x)), np.uint8) for x in (lower, of_token))
    own = own.view(bool)
    two = np.flatnonzero(out >= 0xC0)
    point = (out[two].astype(np.int32) & 0x1F) << 6 | out[two + 1] & 0x3F
    out[two], out[two + 1] = lead[point], last[point]
    own[two] = own[two + 1] = inside[point]
    edge = np.ones(len(own) + 1, bool)  # where a run of like bytes or a text begins
    edge[1:-1] = own[1:] != own[:-1]
    edge[ends] = True
    edge = np.flatnonzero(edge)
    token = own[edge[:-1]]
    first = edge[:-1][token]
    offsets = np.concatenate([[0], np.cumsum(edge[1:][token] - first)]).astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(out.tobytes().translate(None, others)))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(first, ends).astype(np.int32)), tokens)
