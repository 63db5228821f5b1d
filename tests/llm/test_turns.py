"""Conversation repair against a search over all edits, and the digest against a plain reading of it."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

from passagework.llm import queries, turns

NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FULL = {"s": "system", "u": "user", "a": "assistant"}


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def searched(rows):
    """(cost, audit, repaired) by whole audits and texts, least first, over every state and number of rows read."""
    best = {(0, 0): (0, "", ())}
    for i in range(len(rows) + 1):
        for _ in range(4):
            for (j, state), (cost, audit, out) in list(best.items()):
                if j == i:
                    for r, to in NEXT[state].items():
                        if r != "s":
                            way = (cost + 5, audit + "I", (*out, (FULL[r], "")))
                            best[i, to] = min(best.get((i, to), way), way)
        if i == len(rows):
            break
        role, text = rows[i]
        fault = faults(rows)[i]
        for (j, state), (cost, audit, out) in list(best.items()):
            if j != i:
                continue
            new = [((i + 1, state), (cost + 2, audit + "D", out))]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if role[:1] in NEXT[state]:
                    new.append(((i + 1, NEXT[state][role[:1]]), (cost + more, audit + "K", (*out, (role, text)))))
                new += [((i + 1, NEXT[state][r]), (cost + 1 + more, audit + "R", (*out, (FULL[r], text)))) for r in "ua" if r in NEXT[state]]
            for to, way in new:
                best[to] = min(best.get(to, way), way)
    return min(best[i, s] for i, s in best if i == len(rows) and s in (0, 3))


def read(rows):
    """The digest's columns of one conversation's rows after damage, (turn, role, text) in order."""
    said = [(r, t) for _, r, t in rows]
    known = [t for t, _, _ in rows if t is not None]
    n = Counter(faults(said))
    cost, audit, out = searched(said) if rows else (0, "", ())
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:], strict=False))
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def expected(rows):
    """The whole digest of (conv_id, turn, role, text) rows."""
    held = {c: [] for c, *_ in rows}
    for conv, turn, role, text in rows:
        shown = [" " if x is None else str(x) for x in (conv, turn)]
        d = zlib.crc32(":".join(shown).encode()) % 20
        text, role = " " if text is None else text, " " if role is None else role
        text = "" if d == 1 else text.translate({ord(c): None for c in ".!?"}) if d == 2 else text
        role = "user" if d == 4 else role
        held[conv] += [(turn, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest())
    return {c: read(sorted(own, key=order)) for c, own in held.items()}


def got(df):
    rows = df.collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in rows}


def made(seed, conversations, turns_):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Cut", " \t", "", "Why?", None, "Long " * 50 + "end."]
    return [(c, None if r.random() < 0.05 else t + r.randint(0, 1), r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), r.choice(texts)) for c in range(conversations) for t in range(r.randint(1, turns_))]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("start", turns.TOPS)
def test_ranges_joined_are_the_whole(start):
    r = random.Random(1)
    for _ in range(300):
        rows = [(r.choice("suat"), r.choice(["", "", "truncated", "blank", "duplicate"]), 1) for _ in range(r.randint(1, 9))]
        cut = r.randint(0, len(rows))
        parts = [p for p in (rows[:cut], rows[cut:]) if p]
        whole = turns.joined([[(t, *w) for t in turns.TOPS for w in turns.ways(rows, t)]])
        assert turns.joined([[(t, *w) for t in turns.TOPS for w in turns.ways(p, t)] for p in parts]) == whole


def test_small_conversations_equal_the_search(spark):
    rows = made(7, 300, 8)
    df = spark.createDataFrame([(*x, "other") for x in rows], SCHEMA + ", key string")
    want = expected(rows)
    assert got(turns.digest(df)) == want
    assert got(turns.digest(df, range_rows=40)) == want  # conversations that several tasks read


def test_one_long_conversation_over_many_ranges(spark):
    rows = [(5, t, ("user", "assistant", "tool")[t % 3], f"turn {t % 97}" + "." * (t % 4 > 0)) for t in range(600)]
    rows += [(5, 3, "user", "same.")] * 700 + [(9, 0, "user", "Hi."), (9, 1, "assistant", "Yes.")]
    want = expected(rows)
    assert got(turns.digest(spark.createDataFrame(rows, SCHEMA), range_rows=50)) == want


def test_repaired_rows_follow_the_grammar(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hi."), (1, 3, "assistant", "Well."), (2, 0, "user", "Alone."), (3, 0, None, None)]
    out = {}
    for r in turns.repaired(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "position").collect():
        out.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    # The system row becomes the user's, as one rerole costs less than one deletion; 2 is deleted, which costs less than an insertion.
    assert out == {1: [("user", "Be kind."), ("assistant", "Hello."), ("user", "Hi."), ("assistant", "Well.")]}


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert turns.digest(empty).collect() == []
    rows = [(None, None, None, None), (None, 0, "user", "Hi."), (4, None, "user", "x" * 300_000 + "."), (4, None, "user", "x" * 300_000 + "."), (4, 7, "assistant", "ok.")]
    assert got(turns.digest(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.queries()["op13_conversation_repair"](spark, sf)) == expected(rows)
