"""Structured answers checked against a declared form, and tool calls whose errors are values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once


@dataclass(frozen=True)
class Field:
    """A field of an answer: its name, ``string``, ``number``, ``integer``, ``boolean`` or ``array<string>``,
    the values it may have (any, if empty) and whether it must be there."""

    name: str
    kind: str = "string"
    allowed: tuple[str, ...] = ()
    required: bool = True


# How JSON values of each kind begin.
_SHAPES = {"string": '^"', "number": r"^-?[0-9]", "integer": r"^-?[0-9]+$", "boolean": "^(true|false)$", "array<string>": r"^\["}
_TYPES = {"string": "string", "number": "double", "integer": "bigint", "boolean": "boolean", "array<string>": "array<string>"}


def _typed(variant: Column, f: Field) -> Column:
    return F.try_variant_get(variant, f"$.{f.name}", _TYPES[f.kind])


def _faults(variant: Column, fields: tuple[Field, ...]) -> Column:
    """The faults of a parsed answer: ``missing:x``, ``wrong-type:x``, ``not-allowed:x``, in the order of the fields."""
    out = []
    for f in fields:
        raw = F.try_variant_get(variant, f"$.{f.name}", "variant")
        gone = raw.isNull() | F.is_variant_null(raw)
        fault = F.when(gone, F.lit(f"missing:{f.name}") if f.required else F.lit(None).cast("string"))
        fault = fault.when(~F.to_json(raw).rlike(_SHAPES[f.kind]) | _typed(variant, f).isNull(), f"wrong-type:{f.name}")
        if f.allowed:
            fault = fault.when(~_typed(variant, f).isin(*f.allowed), f"not-allowed:{f.name}")
        out.append(fault)
    return F.array_compact(F.array(*out))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def structured(text: Column, fields: tuple[Field, ...], second: Column | None = None) -> Column:
    """struct(value, faults, form) of an answer that should be a JSON object with these fields.

    An answer that is blank or no JSON is read from ``second``, the arguments of the call that asks
    again in another form; one that is JSON but breaks the declared form is not. ``value`` is a struct
    of the fields, those with a fault null; ``faults`` is empty where the answer is sound, else says
    ``missing:x``, ``wrong-type:x`` or ``not-allowed:x`` by field, ``not-an-object``, ``json-parse`` or ``empty
    content``. ``form`` is 1 or 2, and 0 where neither parses. Fields that aren't declared are ignored.
    """
    second = F.lit(None).cast("string") if second is None else second
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""

    def judged(x: Column) -> Column:
        v = F.coalesce(x["a"], x["b"])
        form = F.when(x["a"].isNotNull(), 1).when(x["b"].isNotNull(), 2).otherwise(0).cast("long")
        lost = F.array(F.when(blank(text) & blank(second), "empty content").otherwise("json-parse"))
        wrong = F.when(form == 0, lost).when(~_is_object(v), F.array(F.lit("not-an-object"))).otherwise(_faults(v, fields))

        def kept(faults: Column) -> Column:
            whole = F.array_contains(faults, "not-an-object")
            bad = lambda f: F.exists(faults, lambda w: F.endswith(w, F.lit(f":{f.name}")))
            value = F.struct(*(F.when(~whole & ~bad(f), _typed(v, f)).alias(f.name) for f in fields))
            return F.struct(value.alias("value"), faults.alias("faults"), form.alias("form"))

        return once(wrong, kept)

    first = F.when(~blank(text), F.try_parse_json(text))
    again = lambda a: F.struct(a.alias("a"), F.when(a.isNull() & ~blank(second), F.try_parse_json(second)).alias("b"))
    return once(once(first, again), judged)


#: The calculator's input.
CALCULATION = (Field("operation", allowed=("add", "subtract", "multiply", "divide")), Field("a", "number"), Field("b", "number"))
# The wordings by which a tool call tells the model what went wrong.
UNKNOWN, INVALID, FAILED = 'Model called unknown tool "{}". Available: {}', 'ERROR: Invalid input for tool "{}". {}', 'ERROR executing tool "{}": {}'


def executed(tool: Column, input_: Column, name: str = "calculate") -> Column:
    """struct(value, error) of a calculator call with JSON input: exactly one is set, no task fails.

    An unknown tool, an input that breaks the declared form and a division by zero are errors as
    values, in the wording that the model reads; what is wrong with an input is named by ``structured``.
    """
    said = lambda form, *parts: F.format_string(form.replace("{}", "%s"), *parts)

    def run(x: Column) -> Column:
        v = x["value"]
        zero = (v["operation"] == "divide") & (v["b"] == 0)
        value = F.when(v["operation"] == "add", v["a"] + v["b"]).when(v["operation"] == "subtract", v["a"] - v["b"]).when(v["operation"] == "multiply", v["a"] * v["b"]).otherwise(F.try_divide(v["a"], v["b"]))
        error = (
            F.when(~tool.eqNullSafe(F.lit(name)), said(UNKNOWN, F.coalesce(tool, F.lit("")), F.lit(name)))
            .when(F.size(x["faults"]) > 0, said(INVALID, F.lit(name), F.array_join(x["faults"], ", ")))
            .when(zero, said(FAILED, F.lit(name), F.lit("Division by zero")))
        )
        return once(error, lambda e: F.struct(F.when(e.isNull(), value).alias("value"), e.alias("error")))

    return once(structured(input_, CALCULATION), run)
