"""Personal data by anchor expansion.

One Aho-Corasick automaton over each text finds anchors: at-signs, digits, plus signs, ``://`` and
identifier cues. From each anchor a small deterministic parser expands to the boundaries of the
email, address, account or telephone number there and validates it. A text without anchors is
passed by in one scan.

Base kinds are ``email``, ``ip``, ``card`` and ``phone`` with fixed grammars, each leftmost and
non-overlapping within its kind. The method adds ``login`` (``scheme://user:password@host``, which
may hold an email's span) and, where no base span overlaps, ``iban`` (a country code and check
digits that hold modulo 97) and ``account`` (8 to 17 digits after an identifier cue).

Defined cases: a null text counts as empty in ``spans`` and stays null when redacted; a null doc_id
stays null; a very long text is searched whole, in time that grows with its length; of overlapping
account numbers the first stays; repeated
rows each give their row; empty tables give empty results; other columns pass through ``redact``
and are ignored by ``scan``.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear_of, per_batch, texts

KINDS = ("email", "ip", "card", "phone", "iban", "login", "account")
# Cues before account numbers.
CUES = (
    "account number", "account no", "acct no", "iban", "konto", "kontonummer", "numéro de compte",
    "número de cuenta", "passport no", "ssn", "social security",
)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_LOGIN = re.compile(r"://[A-Za-z0-9._~%-]+:[A-Za-z0-9._~%!$&*+,;=-]+@[A-Za-z0-9.-]+")
_ACCOUNT = re.compile(r"[\x20.:#-]{0,4}([0-9](?:[\x20-]?[0-9]){7,16})(?![0-9])")
_automaton: list[ahocorasick.Automaton] = []


def _anchors() -> ahocorasick.Automaton:
    if not _automaton:
        a = ahocorasick.Automaton()
        for d in "0123456789":
            a.add_word(d, ("d", 1))
        a.add_word("@", ("@", 1))
        a.add_word("+", ("+", 1))
        a.add_word("://", (":", 3))
        for cue in CUES:
            for form in {cue, cue.capitalize(), cue.title(), cue.upper()}:
                a.add_word(form, ("cue", len(form)))
        a.make_automaton()
        _automaton.append(a)
    return _automaton[0]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def iban_holds(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and then start."""
    found: list[list[tuple[int, int]]] = [[] for _ in KINDS]
    end_email = end_run = end_ip = end_card = end_phone = 0
    cues: list[int] = []
    for last, (what, n) in _anchors().iter(text):
        at = last - n + 1
        if what == "d":
            if at < end_run:
                continue
            # at is the first digit of a run: every start of ip and card is one
            end_run = _DIGITS.match(text, at).end()
            if at >= end_ip and (m := _IP.match(text, at)):
                end_ip = m.end()
                if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                    found[1].append(m.span())
            if at >= end_card and (m := _CARD.match(text, at)):
                end_card = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found[2].append(m.span())
        elif what == "@":
            if m := _DOMAIN.match(text, last + 1):
                s = at
                while s > end_email and text[s - 1] in _LOCAL:
                    s -= 1
                if s < at:
                    end_email = m.end()
                    found[0].append((s, end_email))
        elif what == "+":
            if at >= end_phone and (m := _PHONE.match(text, at)):
                end_phone = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found[3].append(m.span())
        elif what == ":":
            if m := _LOGIN.match(text, at):
                s = at
                while s > 0 and text[s - 1].isascii() and text[s - 1].isalpha():
                    s -= 1
                if s < at:
                    found[5].append((s, m.end()))
        else:
            cues.append(last + 1)
    if cues or found[2] or end_run:
        taken = [x for k in range(4) for x in found[k]]
        found[4] = clear_of((m.span() for m in _IBAN.finditer(text) if iban_holds(m[0])) if end_run else (), taken)
        found[6] = clear_of((m.span(1) for c in cues if (m := _ACCOUNT.match(text, c))), taken + found[4])
    return [(k, s, e) for k, own in enumerate(found) for s, e in sorted(own)]


_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, found): the spans of every row's whole text."""

    def find(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [[{"kind": k, "start": s, "end": e} for k, s, e in spans(t)] for t in texts(b)]
        return pa.record_batch([b.column("doc_id"), pa.array(rows, _SPANS)], names=["doc_id", "found"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return per_batch(rows, find, "doc_id long, found array<struct<kind:int,start:int,end:int>>")


def _joined(x):
    name = F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    return F.concat_ws(":", name, x["start"].cast("string"), x["end"].cast("string"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``scan``'s rows."""
    f = F.col("found")
    count = lambda k: F.size(F.filter(f, lambda x: x["kind"] == k)).cast("long")
    base = F.array_join(F.transform(F.filter(f, lambda x: x["kind"] < 4), _joined), ",")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{KINDS[k]}") for k in range(4)), F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.transform(f, _joined), ",").alias("spans"),
        F.size(F.filter(f, lambda x: x["kind"] >= 4)).cast("long").alias("n_other"),
    )


def redacted(text: str) -> str:
    """The text with each found span, overlapping ones merged, replaced by its kind's name."""
    parts, at = [], 0
    merged: list[list[int]] = []
    for s, e, k in sorted((s, e, k) for k, s, e in spans(text)):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([s, e, k])
    for s, e, k in merged:
        parts += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = e
    return "".join([*parts, text[at:]]) if parts else text


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, personal data in ``text`` replaced, ``n_chars`` renewed."""

    def clean(b: pa.RecordBatch) -> pa.RecordBatch:
        new = pa.array([x and redacted(x) for x in b.column("text").to_pylist()], b.schema.field("text").type)
        cols = {n: b.column(n) for n in b.schema.names} | {"text": new}
        if "n_chars" in cols:
            cols["n_chars"] = pc.cast(pc.utf8_length(new), cols["n_chars"].type)
        return pa.record_batch(list(cols.values()), names=list(cols))

    return per_batch(docs, clean, docs.schema)
