"""Strict checks of JSON requests and answers: the JSON inside a text as a VARIANT, and what breaks its rules, with paths."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What schema_of_variant says of a value of each kind.
KINDS = {"string": ("STRING",), "int": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}


@dataclass(frozen=True)
class Rule:
    """A field: its kind, whether it must be there (a null counts as missing), bounds of its value (of the length of a string
    or array), the values allowed, and the rules of its fields, or of those of each of its items."""

    name: str
    kind: str
    required: bool = False
    low: float | None = None
    high: float | None = None
    choices: Sequence[str] = ()
    fields: Sequence[Rule] = field(default=())


def json_text(text: Column) -> Column:
    """The JSON object in a text: of what a code fence holds, if there is one, from the first brace to the last. Null without."""
    fence = r"(?s)```(?:json)?\s*(.*?)```"
    body = F.when(text.rlike(fence), F.regexp_extract(text, fence, 1)).otherwise(text)
    found = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def parsed(text: Column) -> Column:
    """The JSON object in a text as a VARIANT, null where there is none or it is broken."""
    return F.try_parse_json(json_text(text))


def violations(value: Column, rules: Sequence[Rule], path: Column | None = None) -> Column:
    """An array of `path: reason` for everything in an object (a VARIANT) that its rules do not allow, in the rules' order and
    those of unknown fields, by name, last. Reasons: missing, kind, low, high, choice, unknown. A null object: `$: missing`."""
    path = F.lit("$") if path is None else path
    found = [_field(value, rule, path) for rule in rules]
    names = F.array_sort(F.map_keys(F.try_variant_get(value, "$", "map<string, variant>")))
    unknown = F.filter(names, lambda n: ~n.isin([r.name for r in rules]))
    found.append(F.transform(F.coalesce(unknown, F.array().cast("array<string>")), lambda n: F.concat(path, F.lit("."), n, F.lit(": unknown"))))
    broken = ~F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    return F.when(value.isNull(), F.array(F.concat(path, F.lit(": missing")))).when(broken, F.array(F.concat(path, F.lit(": kind")))).otherwise(F.concat(*found))


def _field(value: Column, rule: Rule, path: Column) -> Column:
    at = F.concat(path, F.lit(f".{rule.name}"))
    own = F.try_variant_get(value, f"$.{rule.name}", "variant")
    there = own.isNotNull() & ~F.is_variant_null(own)
    kind = F.schema_of_variant(own)
    right = reduce(lambda a, b: a | b, [kind.startswith(k) for k in KINDS[rule.kind]])
    as_string = F.try_variant_get(value, f"$.{rule.name}", "string")
    as_array = F.try_variant_get(value, f"$.{rule.name}", "array<variant>")
    size = {"string": F.length(as_string), "array": F.size(as_array)}.get(rule.kind, F.try_variant_get(value, f"$.{rule.name}", "double"))
    say = lambda reason: F.concat(at, F.lit(f": {reason}"))
    tests = []
    if rule.low is not None:
        tests.append(F.when(size < rule.low, say("low")))
    if rule.high is not None:
        tests.append(F.when(size > rule.high, say("high")))
    if rule.choices:
        tests.append(F.when(~as_string.isin(*rule.choices), say("choice")))
    inside = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")
    if rule.fields and rule.kind == "object":
        inside = F.concat(inside, violations(own, rule.fields, at))
    if rule.fields and rule.kind == "array":
        inside = F.concat(inside, F.flatten(F.transform(as_array, lambda x, i: violations(x, rule.fields, F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))))
    missing = F.array(say("missing")) if rule.required else F.array().cast("array<string>")
    return F.when(~there, missing).when(~right, F.array(say("kind"))).otherwise(inside)
