"""Tokens by merge ranks: counts, chunks and clamps."""

import pytest

from passagework.functions import ids
from passagework.operators import segment

TEXTS = ["", " ", "one two  three", "naïve café — 日本語 \U0001f600 <|endoftext|>", "a\n\n \t\nbb ccc\n" * 40, None, "x" * 5000]


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, x, i, "t") for i, x in enumerate(TEXTS)], "doc_id long, text string, size int, p string")


@pytest.mark.parametrize("n", [1, 7, 10_000])
def test_clamp(rows, path, n):
    whole = ids.encoding(path)
    for r in ids.clamped(rows, "text", n, path).collect():
        text = TEXTS[r["doc_id"]]
        if text is None:
            assert r["text"] is None and r["tokens"] is None
            continue
        own = whole.encode_ordinary(text)
        assert r["tokens"] == len(own) and (r["size"], r["p"]) == (r["doc_id"], "t")
        assert r["text"] == (text if len(own) <= n else b"".join(whole.decode_single_token_bytes(x) for x in own[:n]).decode("utf-8", "replace"))


def test_clamp_inside_a_character(spark):
    rows = spark.createDataFrame([("aé",), ("é",)], "text string")
    assert [tuple(r) for r in ids.clamped(rows, "text", 2, ids.BYTES).collect()] == [("a�", 3), ("é", 2)]


@pytest.mark.parametrize(("target", "overlap"), [(20, 5), (3, 0), (500, 50)])
def test_chunks(rows, path, target, overlap):
    """Chunks by the ids of each paragraph; a tokenizer that merges more makes fewer of them."""
    whole = ids.encoding(path)
    got = {}
    for r in segment.cut(segment.listed(rows, count=ids.counter(path)), target, overlap).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append((r["char_start"], r["char_end"], r["token_count"]))
    for i, text in enumerate(TEXTS):
        paras = segment.blocks(text or "", segment.re.compile("\n"))
        tokens = [len(whole.encode_ordinary(text[a:b])) for _, a, b in paras]
        want = [(paras[x][1], paras[y - 1][2], sum(tokens[x:y])) for x, y in segment.pack(tokens, target, overlap)]
        assert got.get(i, []) == want
    fine = segment.cut(segment.listed(rows, count=ids.counter(ids.BYTES)), target, overlap).count()
    assert sum(map(len, got.values())) <= fine


def test_no_texts(rows, path):
    assert ids.clamped(rows.limit(0), "text", 5, path).count() == 0
    assert segment.listed(rows.limit(0), count=ids.counter(path)).count() == 0
