"""Checks of questions and answers as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, once, trimmed

MAX_QUESTION = 2000
# Rules of the input check, first match wins; a sentence ends at a point, question or
# exclamation mark. Word bounds and blanks are those of ``pattern``.
INJECTIONS = {
    "override-instructions": r"\b(ignore|disregard|forget)\b[^.?!]*\b(previous|prior|above|all|the|your)\b[^.?!]*\b(instructions?|prompts?|rules?|context)\b",
    "system-prompt-probe": r"\b(system|developer)\s+prompt\b",
    "prompt-leak": r"\b(reveal|print|show|repeat|output)\b[^.?!]*\b(your\s+)?(system\s+prompt|instructions|prompt|rules)\b",
    "role-override": r"\byou\s+are\s+now\s+(a|an|the)\b",
    "jailbreak-persona": r"\b(act|behave|respond|answer)\s+(as|like)\b[^.?!]*\b(dan|jailbreak|unfiltered|no\s+rules?)\b",
    "no-rules": r"\b(with\s+)?no\s+(rules?|restrictions?|filters?|limits?)\b",
}
# Phrasings by which an answer says that it has no answer.
ABSTENTIONS = (
    r"\b(do(es)?\s+not|did\s+not|don't|doesn't)\b[^.?!]*\b(contain|cover|include|provide|address|mention|find)\b",
    r"\bcorpus\b[^.?!]*\b(do(es)?\s+not|don't|doesn't|lacks?|has\s+no)\b",
    r"\b(outside|beyond|not\s+within)\b[^.?!]*\bscope\b",
    r"\b(specialized|scoped|limited|focus(ed)?)\b[^.?!]*\b(for|to|on)\b[^.?!]*\b(Caesar|corpus|sources?)\b",
    r"\bno\s+(information|passages?|sources?|evidence|mention)\b",
    r"\bclarify\b[^.?!]*\bscope\b",
    r"\b(cannot|can't|unable\s+to)\b[^.?!]*\b(answer|find|locate|provide)\b",
)
# What a text must hold for each of them to occur, one of every group: a look for plain strings goes before the pattern.
NEEDED = (
    (("not", "n't"), ("contain", "cover", "include", "provide", "address", "mention", "find")),
    (("corpus",),),
    (("outside", "beyond", "within"), ("scope",)),
    (("specialized", "scoped", "limited", "focus"), ("caesar", "corpus", "source")),
    (("no",), ("information", "passage", "source", "evidence", "mention")),
    (("clarify",), ("scope",)),
    (("cannot", "can't", "unable"), ("answer", "find", "locate", "provide")),
)
# Parts of the messages of errors that pass, and of those that another call form may avoid.
TRANSIENT = ("timeout", "timed out", "econnreset", "rate limit", "429", "502", "503", "504")
UNPARSED = ("json-parse", "empty content")


def pattern(p: str) -> str:
    """A rule for Spark: word bounds are ASCII ones, so that accented letters don't shift them."""
    word = "[A-Za-z0-9_]"
    head = f"(?<!{word})" if p.startswith(r"\b") else ""  # every rule begins with a word
    return "(?i)" + head + p.removeprefix(r"\b").replace(r"\b", f"(?:(?<!{word})(?={word})|(?<={word})(?!{word}))").replace(r"\s", SPACE)


def stopped(question: Column) -> Column:
    """Why the input check stops a question, NULL where it passes: the first rule that it breaks, trimmed."""

    def reason(q: Column) -> Column:
        found = F.when(F.length(q) == 0, "empty").when(F.length(q) > MAX_QUESTION, f"exceeds-{MAX_QUESTION}-chars")
        for name, p in INJECTIONS.items():
            found = found.when(q.rlike(pattern(p)), name)
        return found

    return once(trimmed(question), reason)


def input_guard(question: Column) -> Column:
    """struct(ok, rule, reason): the first rule that the trimmed question breaks. The rules are tried once."""
    long = F.lit(f"exceeds-{MAX_QUESTION}-chars")
    rule = lambda r: F.when(r.isin("empty", long), "length").when(r.isNotNull(), "injection")
    return once(stopped(question), lambda r: F.struct(r.isNull().alias("ok"), rule(r).alias("rule"), r.alias("reason")))


def refused(question: Column) -> Column:
    """The record of a run that the input check stops: no step, no cost; NULL where it passes."""
    record = lambda r: F.struct(F.lit("guard").alias("stop"), r.alias("reason"), F.lit(0).cast("long").alias("steps"), F.lit(0.0).alias("cost"))
    return once(stopped(question), lambda r: F.when(r.isNotNull(), record(r)))


def citations(answer: Column) -> Column:
    """Distinct numbers in brackets, in order, as digits without leading zeros, however many."""
    found = F.regexp_extract_all(answer, F.lit(r"\[([0-9]+)\]"), 1)
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")))


def abstains(answer: Column) -> Column:
    def told(low: Column) -> Column:
        found = F.lit(False)
        for p, groups in zip(ABSTENTIONS, NEEDED, strict=True):
            held = F.lit(True)
            for group in groups:
                held = held & reduce(Column.__or__, [low.contains(x) for x in group])
            found = found | (held & answer.rlike(pattern(p)))
        return found

    return once(F.lower(answer), told)


def output_guard(answer: Column, allowed: Column | None = None) -> Column:
    """struct(ok, abstained, cited, issues) of an answer that may cite only ``allowed``, if given.
    Text, ids and phrasings are looked for once each."""

    def judged(x: Column) -> Column:
        ids, gone, silent = x["ids"], x["gone"], x["silent"]
        foreign = F.array().cast("array<string>") if allowed is None else F.array_except(ids, F.transform(allowed, lambda i: i.cast("string")))
        found = F.array_compact(
            F.array(
                F.when((F.size(ids) == 0) & ~silent, "answered-without-citation"),
                F.when(F.size(foreign) > 0, F.concat(F.lit("cites-unconsulted-chunks:"), F.array_join(foreign, ","))),
            )
        )
        issues = F.when(gone, F.array(F.lit("empty-article"))).otherwise(found)
        return once(issues, lambda i: F.struct((F.size(i) == 0).alias("ok"), (~gone & silent).alias("abstained"), (F.size(ids) > 0).alias("cited"), i.alias("issues")))

    seen = lambda text: F.struct(citations(text).alias("ids"), (F.length(text) == 0).alias("gone"), abstains(text).alias("silent"))
    return once(once(trimmed(F.coalesce(answer, F.lit(""))), seen), judged)


def refusal_label(did: Column, should: Column) -> Column:
    return F.when(did & should, "correct-refused").when(~did & ~should, "correct-answered").when(should, "should-have-refused").otherwise("should-have-answered")


def coerced_list(s: Column) -> Column:
    """A JSON array of strings as is; blank, none and n/a as empty; other text as one item."""
    t = F.trim(s)
    parsed = F.when(t.startswith("["), F.from_json(t, "array<string>"))
    return F.when(s.isNull() | F.lower(t).isin("", "none", "n/a"), F.array().cast("array<string>")).otherwise(F.coalesce(parsed, F.array(t)))


def _holds_any(message: Column, parts: tuple[str, ...]) -> Column:
    low, found = F.lower(message), F.lit(False)
    for x in parts:
        found = found | low.contains(x)
    return found


def transient(message: Column) -> Column:
    """Whether a call that failed with this message may be tried again."""
    return _holds_any(message, TRANSIENT)


def unparsed(message: Column) -> Column:
    """Whether an answer was not of the asked form, so that another call form is worth a try."""
    return _holds_any(message, UNPARSED)
