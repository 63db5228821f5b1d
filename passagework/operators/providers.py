"""Model-bound steps as providers, with deterministic stand-ins that need no model.

A provider is a function from the texts of a request to its results; it is applied inside tasks,
request by request. Stand-ins make every relational result reproducible.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words


#: Texts of one request. Prices are in ``cost``.
BATCH = 100


def hashed_embedding(dimension: int = 64) -> Callable[[list[str]], tuple[list[tuple[int, list[float]]], int]]:
    """Signed hashed counts of tokens, scaled to unit length; where all counts cancel, the first token's
    sign alone. Only a text without tokens has no length.

    As a provider of vectors it takes the texts of one request and gives (position, vector) pairs, in
    no certain order, and the request's tokens: here backwards, which callers must not notice.
    """

    def embed(texts: list[str]) -> tuple[list[tuple[int, list[float]]], int]:
        out, tokens = [], 0
        for i, t in enumerate(texts):
            v, words_ = np.zeros(dimension, np.float32), t.lower().split()
            for w in words_:
                h = xxhash.xxh3_64_intdigest(w)
                v[h % dimension] += 1 if h >> 63 else -1
            if words_ and not v.any():
                h = xxhash.xxh3_64_intdigest(words_[0])
                v[h % dimension] = 1 if h >> 63 else -1
            tokens += len(words_)
            out.append((i, (v / max(float(np.linalg.norm(v)), 1e-9)).tolist()))
        return out[::-1], tokens

    return embed


def embedded(rows: DataFrame, text: str, embed: Callable | None = None, batch: int = BATCH) -> DataFrame:
    """``rows`` with ``embedding``, ``dimension`` (learnt from the answer) and ``request``, a struct (id, size,
    tokens) of the request that a row was in.

    Requests hold ``batch`` texts of a task, across Arrow batches; their answers are put back in order
    by position. Usage comes with the rows, from the same pass: a request's figures are on each of
    its rows, and on one of them, whose ``first`` is true, to be added up. A null text is empty.
    """
    f = embed or hashed_embedding()
    kept = rows.columns

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def asked(own: pa.Table) -> pa.RecordBatch:
            nonlocal n
            texts = [x or "" for x in own[text].to_pylist()]
            found, tokens = f(texts)
            vectors = [v for _, v in sorted(found, key=lambda x: x[0])]
            if len(vectors) != len(texts):
                raise ValueError(f"{len(texts)} texts were sent, {len(vectors)} vectors came back")
            k = len(texts)
            n += 1
            request = pa.StructArray.from_arrays([pa.array([(part << 32) + n] * k, pa.int64()), pa.array([k] * k, pa.int64()), pa.array([tokens] * k, pa.int64()), pa.array([i == 0 for i in range(k)])], ["id", "size", "tokens", "first"])
            cols = [*(own[c].combine_chunks() for c in kept), pa.array(vectors, pa.list_(pa.float32())), pa.array([len(v) for v in vectors], pa.int32()), request]
            return pa.record_batch([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], names=[*kept, "embedding", "dimension", "request"])

        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= batch:
                whole = pa.Table.from_batches(held)
                full = size - size % batch
                for at in range(0, full, batch):
                    yield asked(whole.slice(at, batch))
                held, size = whole.slice(full).to_batches(), size - full
        if size:
            yield asked(pa.Table.from_batches(held))

    types = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(go, f"{types}, embedding array<float>, dimension int, request struct<id:bigint,size:bigint,tokens:bigint,first:boolean>")


def overlap_score(query: Column, text: Column) -> Column:
    """Stand-in reranker: share of the query's distinct words that the text has."""
    q, t = F.array_distinct(words(query)), words(text)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(0.0)


def rerank_text(context: Column, text: Column) -> Column:
    return F.when(F.length(F.coalesce(context, F.lit(""))) > 0, F.concat(context, F.lit("\n\n"), text)).otherwise(text)


def variations(question: Column, n: int = 3) -> Column:
    """Stand-in expansion: the question without its first word, its last, and both."""
    w = F.split(F.trim(question), r"\s+")
    made = F.array(F.array_join(F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), " "), F.array_join(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), " "), F.array_join(F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0))), " "))
    return F.slice(F.filter(made, lambda x: F.length(x) > 0), 1, n)
