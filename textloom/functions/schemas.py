"""JSON replies held against a schema, as column expressions over VARIANT."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What schema_of_variant says of each type of JSON schema.
KINDS = {"string": "STRING$", "integer": r"BIGINT$|DECIMAL\(\d+,0\)$", "number": "BIGINT$|DECIMAL|DOUBLE$|FLOAT$", "boolean": "BOOLEAN$", "null": "VOID$", "object": "OBJECT<", "array": "ARRAY<"}
KNOWN = frozenset(("type", "enum", "properties", "required", "additionalProperties", "items", "minItems", "maxItems", "minLength", "maxLength", "pattern", "minimum", "maximum", "title", "description"))


def conforms(value: Column, schema: dict) -> Column:
    """Whether a VARIANT is as the schema says, at every depth; null for null.

    Knows type (one or a list), enum (of strings), properties, required, additionalProperties (false), items, minItems,
    maxItems, minLength, maxLength, pattern (found anywhere), minimum and maximum; anything else is an error, as it
    would not be checked.
    """
    if unknown := set(schema) - KNOWN:
        raise ValueError(f"not known: {sorted(unknown)}")
    kind, text, number = F.schema_of_variant(value), F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    rules = []
    if "type" in schema:
        names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        rules.append(kind.rlike("^(?:" + "|".join(KINDS[n] for n in names) + ")"))
    if "enum" in schema:
        rules.append(kind.rlike("^STRING$") & text.isin(*schema["enum"]))

    def only(name: str, rule: Column) -> None:
        """A rule for values of one type holds for all others."""
        rules.append(~kind.rlike(f"^(?:{KINDS[name]})") | rule)

    for name, rule in (("minLength", lambda n: F.length(text) >= n), ("maxLength", lambda n: F.length(text) <= n), ("pattern", text.rlike)):
        if name in schema:
            only("string", rule(schema[name]))
    for name, rule in (("minimum", lambda n: number >= n), ("maximum", lambda n: number <= n)):
        if name in schema:
            only("number", rule(schema[name]))
    entries = F.try_variant_get(value, "$", "map<string, variant>")
    for name in schema.get("required", ()):
        only("object", F.map_contains_key(entries, name))
    for name, inner in schema.get("properties", {}).items():
        only("object", ~F.map_contains_key(entries, name) | F.coalesce(conforms(F.element_at(entries, name), inner), F.lit(False)))
    if schema.get("additionalProperties") is False:
        only("object", F.size(F.array_except(F.map_keys(entries), F.array(*map(F.lit, schema.get("properties", {}))).cast("array<string>"))) == 0)
    items = F.try_variant_get(value, "$", "array<variant>")
    for name, rule in (("minItems", lambda n: F.size(items) >= n), ("maxItems", lambda n: F.size(items) <= n)):
        if name in schema:
            only("array", rule(schema[name]))
    if "items" in schema:
        only("array", F.forall(items, lambda x: F.coalesce(conforms(x, schema["items"]), F.lit(False))))
    return reduce(lambda a, b: a & F.coalesce(b, F.lit(False)), rules, F.lit(True))


def checked_reply(text: Column, schema: dict) -> Column:
    """The JSON of a reply, in a code fence or not, if it conforms; null if it doesn't, or is none, or has a key twice."""
    body = F.regexp_replace(F.trim(text), r"(?s)^```(?:json)?\s*(.*?)\s*```$", "$1")
    value = F.try_parse_json(body)
    return F.when(F.coalesce(conforms(value, schema), F.lit(False)), F.to_json(value))
