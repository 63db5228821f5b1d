"""Secret scan with corpus-wide ownership frequency.

Each text is searched for credential-like strings. The hash of each string is then counted over
the whole corpus by distinct owners and distinct repositories: a string that many owners hold is
a copied example, one that a single owner holds is taken as live.

Base kinds (``assign``, ``access``, ``hex``) are fixed patterns. The method's own kind, ``owned``,
is a token shaped like an issued credential (a known issuer prefix, or a long mix of upper case,
lower case and digits) that overlaps no base span; it is reported only where the corpus shows it
to be owner-specific.

Defined cases: a null text counts as empty and gives a row without spans; a null doc_id stays null;
a very long text is searched whole, in time that grows with its length; null owners and
repositories each count as one value; of overlapping issued tokens the first stays; repeated rows each give their row; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear_of, met, per_batch, texts, written

# The patterns of the base kinds and of issued tokens.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
ISSUED = re.compile(
    r"(?<![A-Za-z0-9_-])(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,}"
    r"|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{16,}"
    r"|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})"
)
MIXED = re.compile(r"[A-Za-z0-9+/_]{24,}={0,2}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "owned")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32
#: A string held by this many distinct owners or more is a copied example.
EXAMPLE_OWNERS = 3

_CANDIDATE = "array<struct<kind:int,start:int,end:int,hash:binary>>"


def _mixed(s: str) -> bool:
    """Whether a long token has the letter, case and digit mix of a random key."""
    digits = sum(c.isdigit() for c in s)
    upper = sum(c.isupper() for c in s)
    lower = sum(c.islower() for c in s)
    if min(digits, upper, lower) < 3:
        return False
    turns = sum((a.isalpha() != b.isalpha()) or (a.isupper() != b.isupper()) for a, b in zip(s, s[1:]))
    _, n = np.unique(list(s), return_counts=True)
    p = n / len(s)
    return turns * 4 >= len(s) and float(-(p * np.log2(p)).sum()) >= 3.5


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, secret) of the base kinds, by start and then kind."""
    found = []
    if "=" in text or ":" in text:
        low = text.lower()
        if any(k in low for k in KEYWORDS):
            for m in ASSIGN.finditer(text):
                if len(m[2]) >= MIN_ASSIGN:
                    found.append((m.start(), 0, m.end(), m[2]))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= MIN_ACCESS:
                found.append((m.start(), 1, m.end(), m[0]))
    for m in HEX.finditer(text):
        found.append((m.start(), 2, m.end(), m[0]))
    found.sort()
    return [(k, s, e, v) for s, k, e, v in found]


def extra_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Tokens shaped like issued credentials that overlap no base span and no other one."""
    taken = [(s, e) for _, s, e, _ in base]
    out = []
    for pattern in (ISSUED, MIXED):
        found = clear_of(((*m.span(), m[0]) for m in pattern.finditer(text) if pattern is ISSUED or _mixed(m[0])), taken)
        taken += [(s, e) for s, e, _ in found]
        out += [(3, s, e, v) for s, e, v in found]
    return out


def candidates(docs: DataFrame, owner: str, repo: str) -> DataFrame:
    """(doc_id, owner, repo, found): every candidate of each row, by its hash."""

    def scan(b: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for t in texts(b):
            spans = base_spans(t)
            spans += extra_spans(t, spans)
            found.append(
                [
                    {"kind": k, "start": s, "end": e, "hash": hashlib.sha256(v.encode()).digest()[:16]}
                    for k, s, e, v in sorted(spans, key=lambda x: (x[1], x[0]))
                ]
            )
        kind = pa.list_(
            pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.binary())])
        )
        return pa.record_batch(
            [b.column("doc_id"), b.column("owner"), b.column("repo"), pa.array(found, kind)],
            names=["doc_id", "owner", "repo", "found"],
        )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.col(owner).cast("string").alias("owner"),
        F.col(repo).cast("string").alias("repo"),
    )
    return per_batch(rows, scan, f"doc_id long, owner string, repo string, found {_CANDIDATE}")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repos, uses) over all candidates.

    Distinct holders are made unique per hash before counting, so a string copied into a third
    of all rows reaches its final group as one row per holder.
    """
    held = found.select("owner", "repo", F.explode("found.hash").alias("hash"))
    holders = held.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    owners = holders.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return owners.groupBy("hash").agg(
        F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("uses")
    )


def scan(docs: DataFrame, owner: str = "source", repo: str = "doc_id", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row per input row: (doc_id, found, live) with every candidate's ownership counts.

    ``found`` has (kind, start, end, owners, repos, live); an ``owned`` candidate that isn't live
    is left out, base candidates always stay. Live is a string of few owners, in however many of
    their repositories.
    """
    rows = written(candidates(docs, owner, repo).withColumn("row", F.monotonically_increasing_id()))
    one = rows.select("row", F.explode("found").alias("c")).select(
        "row", F.col("c.kind").alias("kind"), F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.col("c.hash").alias("hash")
    )
    # Strings copied into many rows meet their counts by a broadcast of bounded size, the others by a shuffle.
    owned = written(ownership(rows))
    judged = met(one, owned, "hash", "uses").withColumn("live", F.col("owners") < example_owners)
    kept = judged.where((F.col("kind") < 3) | F.col("live"))
    listed = kept.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", "owners", "repos", "live"))).alias("found")
    )
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,owners:bigint,repos:bigint,live:boolean>>")
    return rows.select("row", "doc_id").join(listed, "row", "left").select(
        "doc_id", F.coalesce("found", empty).alias("found")
    )


def _joined(spans):
    name = F.element_at(F.array(*map(F.lit, KINDS)), spans["kind"] + 1)
    return F.concat_ws(":", name, spans["start"].cast("string"), spans["end"].cast("string"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``scan``'s rows."""
    f = F.col("found")
    count = lambda k: F.size(F.filter(f, lambda x: x["kind"] == k)).cast("long")
    base = F.array_join(F.transform(F.filter(f, lambda x: x["kind"] < 3), _joined), ",")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform(f, _joined), ",").alias("spans"),
        F.size(F.filter(f, lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter(f, lambda x: ~x["live"])).cast("long").alias("n_example"),
        count(3).alias("n_owned"),
    )
