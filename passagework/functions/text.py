"""Text functions as column expressions. Lengths and offsets are in code points."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks that are trimmed: tab, vertical tab, form feed, space, no-break space, byte order mark.
BLANK = r"[\t\x0B\f  ﻿]"
SPACE = r"[\t\n\x0B\f\r  ﻿]"
WORD = r"[\p{L}\p{N}]+"
# The symbols of Roman numerals.
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` evaluated once, however often ``f`` or its loops read it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def normalized(text: Column) -> Column:
    """LF line ends, lines trimmed at the right, two line ends in a row at most, trimmed."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, BLANK + r"+(\n|$)", "$1")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, f"^{SPACE}+|{SPACE}+$", "")


def between(text: Column, start: str, end: str, strict: bool = False) -> Column:
    """What stands between the first ``start`` and the next ``end``, trimmed; without both NULL, or
    with ``strict`` an error."""
    a = F.instr(text, start)
    rest = F.substr(text, a + len(start))
    b = F.instr(rest, end)
    found = F.when((a > 0) & (b > 0), F.regexp_replace(F.substr(rest, F.lit(1), b - 1), f"^{SPACE}+|{SPACE}+$", ""))
    return found.otherwise(F.raise_error(F.lit(f"no text between {start} and {end}"))) if strict else found


def after_nth(text: Column, marker: str, n: int, end: str | None = None) -> Column:
    """From behind the nth ``marker`` to the first ``end`` after it, or to the end of the text."""
    parts = F.split(text, f"\\Q{marker}\\E")
    rest = F.when(F.size(parts) > n, F.array_join(F.slice(parts, n + 1, F.greatest(F.size(parts), F.lit(1))), marker))
    if end is None:
        return rest
    at = F.instr(rest, end)
    return F.when(at > 0, F.substr(rest, F.lit(1), at - 1)).otherwise(rest)


def roman(s: Column) -> Column:
    """Value of a Roman numeral by the subtractive rule, NULL where another letter occurs."""
    values = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.try_element_at(F.create_map(*(F.lit(x) for kv in ROMAN.items() for x in kv)), c))
    nxt = lambda i: F.coalesce(F.try_element_at(values, i + 2), F.lit(0))
    signed = F.transform(values, lambda v, i: F.when(v < nxt(i), -v).otherwise(v))
    total = F.aggregate(signed, F.lit(0), lambda a, v: a + v)
    return F.when(s.rlike("^[IVXLCDM]+$"), total)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def token_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def clamp(text: Column, n: int) -> Column:
    """The text up to the end of its ``n``-th token, as it is written."""
    found, between_them = F.regexp_extract_all(text, F.lit(WORD), 0), F.split(text, WORD)
    sizes = F.zip_with(F.slice(between_them, 1, n), F.slice(found, 1, n), lambda x, y: F.length(x) + F.length(y))
    return F.when(F.size(found) > n, F.substr(text, F.lit(1), F.aggregate(sizes, F.lit(0), lambda a, x: a + x))).otherwise(text)


def snippet(text: Column, n: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, SPACE + "+", " ")), 1, n)


def truncated(text: Column, n: int) -> Column:
    more = F.length(text) - n
    return F.when(more > 0, F.concat(F.substring(text, 1, n), F.lit("... (+"), more.cast("string"), F.lit(" chars)"))).otherwise(text)


def xml_escaped(text: Column) -> Column:
    t = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(t, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def tagged(name: str, text: Column) -> Column:
    return F.concat(F.lit(f"<{name}>\n"), xml_escaped(text), F.lit(f"\n</{name}>"))


def rendered(template: str, values: dict[str, Column]) -> Column:
    """``{{name}}`` replaced by its value; a name without a value raises."""
    parts, at = [], 0
    for m in re.finditer(r"\{\{(\w+)\}\}", template):
        if m[1] not in values:
            raise KeyError(f"template variable without value: {m[1]}")
        parts += [F.lit(template[at : m.start()]), values[m[1]]]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def year(y: Column) -> Column:
    return F.when(y.isNull(), "date unknown").when(y < 0, F.concat(F.lit("~"), (-y).cast("string"), F.lit(" BC"))).otherwise(F.concat(F.lit("~"), y.cast("string"), F.lit(" AD")))


def citation(author: Column, title: Column, chapter: Column) -> Column:
    return F.concat(F.coalesce(author, F.lit("")), F.lit(", "), F.coalesce(title, F.lit("")), F.lit(", "), F.coalesce(chapter, F.lit("")))


def long_citation(author: Column, title: Column, translator: Column, when: Column) -> Column:
    by = F.when(translator.isNotNull(), F.concat(F.lit(", tr. "), translator)).otherwise("")
    return F.concat(author, F.lit(", "), title, by, F.lit(" ("), year(when), F.lit(")"))


def chapter_label(book: Column, section: Column) -> Column:
    s = F.concat(F.lit("§"), section.cast("string"))
    return F.when(book.isNotNull(), F.concat(book, F.lit(", "), s)).otherwise(s)


def book_of(label: Column) -> Column:
    return F.when(F.instr(label, ", ") > 0, F.substring_index(label, ", ", 1))


def contextual(cited: Column, note: Column, text: Column) -> Column:
    """Citation, note if there is one, blank line, text."""
    head = F.when(F.length(F.coalesce(note, F.lit(""))) > 0, F.concat(cited, F.lit("\n"), note)).otherwise(cited)
    return F.concat(head, F.lit("\n\n"), F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", ""))


def indented(text: Column, by: str = "    ") -> Column:
    return F.regexp_replace(text, "(?m)^", by)


def percent(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x), "-").otherwise(F.format_string("%.1f%%", x * 100))


def dollars(x: Column) -> Column:
    return F.format_string("$%.6f", x)


def tags(values: dict[str, Column]) -> Column:
    """Escaped blocks, one a line pair, parted by blank lines."""
    return F.concat_ws("\n\n", *(F.concat(F.lit(f"<{n}>"), xml_escaped(v.cast("string")), F.lit(f"</{n}>")) for n, v in values.items()))


def per_second(tokens: Column, milliseconds: Column) -> Column:
    """Tokens a second to one place, "?" where that is undefined."""
    rate = F.try_divide(tokens * 1000.0, milliseconds)
    return F.when(rate.isNull(), "?").otherwise(F.format_string("%.1f", rate))


def base_url(url: Column) -> Column:
    """Without slashes at its end, with /v1."""
    t = F.regexp_replace(url, "/+$", "")
    return F.when(t.endswith("/v1"), t).otherwise(F.concat(t, F.lit("/v1")))


# Reasons why a model stopped, in two dialects.
STOPS = {"end_turn": "end_turn", "max_tokens": "max_tokens", "tool_use": "tool_use", "stop_sequence": "stop_sequence", "stop": "end_turn", "length": "max_tokens", "tool_calls": "tool_use"}
# Tokens that a level of reasoning may use.
BUDGETS = {"low": 1024, "medium": 4096, "high": 16384}


def looked_up(key: Column, values: dict, default) -> Column:
    table = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def stop_reason(raw: Column) -> Column:
    return looked_up(raw, STOPS, "unknown")


def most_tokens(level: Column, base: Column) -> Column:
    """The answer's token limit: what a level of reasoning needs comes on top of 1024."""
    budget = F.try_element_at(F.create_map(*(F.lit(x) for kv in BUDGETS.items() for x in kv)), level)
    return F.when(budget.isNull(), base).otherwise(F.greatest(base, budget + 1024))


def joined_blocks(blocks: Column) -> Column:
    """The texts of the text blocks among (type, text) blocks, one after another."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "")


def messages(prompt: Column) -> Column:
    """A JSON list of (role, content) as it is, anything else as one user message."""
    parsed = F.when(trimmed(prompt).startswith("["), F.from_json(trimmed(prompt), "array<struct<role:string,content:string>>"))
    return F.coalesce(parsed, F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))))


def calculated(op: Column, a: Column, b: Column) -> Column:
    """a op b for add, subtract, multiply and divide; NULL for division by zero and other names."""
    return F.when(op == "add", a + b).when(op == "subtract", a - b).when(op == "multiply", a * b).when(op == "divide", F.try_divide(a, b))


def none_if_empty(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def message_role(role: Column) -> Column:
    """System and assistant as they are, any other role as the user's."""
    return F.when(role.isin("system", "assistant"), role).otherwise("user")
