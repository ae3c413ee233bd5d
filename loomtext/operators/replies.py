"""Structured answers: what of a schema a reply's JSON does not keep, as columns over Spark's variant type."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X

#: Problems of an answer that are told.
MOST_PROBLEMS = 12

#: How Spark names the type of a variant, by the type of a schema.
_KINDS = {"object": "^OBJECT", "array": "^ARRAY", "string": "^STRING$", "boolean": "^BOOLEAN$", "null": "^VOID$", "number": "^(BIGINT|DOUBLE|DECIMAL)", "integer": "^(BIGINT|DECIMAL.*,0.$)"}


def _none() -> Column:
    return F.expr("cast(array() as array<string>)")


def _when(bad: Column, place: Column, what: str) -> Column:
    return F.when(bad, F.array(F.concat(place, F.lit(": " + what)))).otherwise(_none())


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).rlike(_KINDS[kind]), F.lit(False))


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _equals(value: Column, wanted) -> Column:
    kind = "boolean" if isinstance(wanted, bool) else "string" if isinstance(wanted, str) else "null" if wanted is None else "number"
    if wanted is None:
        return _is(value, kind)
    same = F.try_variant_get(value, "$", "double") == float(wanted) if kind == "number" else _text(value) == (str(wanted).lower() if kind == "boolean" else wanted)
    return _is(value, kind) & F.coalesce(same, F.lit(False))


def _type(value: Column, place: Column, kinds, schema: dict) -> Column:
    kinds = kinds if isinstance(kinds, list) else [kinds]
    return _when(~reduce(lambda a, b: a | b, (_is(value, k) for k in kinds)), place, "not " + " or ".join(kinds))


def _one_of(value: Column, place: Column, wanted: list, schema: dict) -> Column:
    return _when(~reduce(lambda a, b: a | b, (_equals(value, w) for w in wanted)), place, f"not one of {wanted}")


def _least(kind: str, size: Callable[[Column], Column], what: str):
    return lambda value, place, n, schema: _when(_is(value, kind) & F.coalesce(size(value) < n, F.lit(False)), place, what)


def _items_of(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _items(value: Column, place: Column, below: dict, schema: dict) -> Column:
    each = F.transform(_items_of(value), lambda x, i: problems(x, below, F.concat(place, F.lit("["), i.cast("string"), F.lit("]"))))
    return F.when(_is(value, "array"), F.flatten(each)).otherwise(_none())


def _field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$['{name}']", "variant")


def _inside(place: Column, name: str) -> Column:
    return F.when(place == "(root)", F.lit(name)).otherwise(F.concat(place, F.lit("." + name)))


def _required(value: Column, place: Column, names: list[str], schema: dict) -> Column:
    known = schema.get("properties", {})
    lacks = [_when(_is(value, "object") & _field(value, n).isNull(), _inside(place, n), "missing") for n in names if "default" not in known.get(n, {})]
    return F.concat(_none(), *lacks)


def _properties(value: Column, place: Column, below: dict, schema: dict) -> Column:
    told = lambda n, s: X.let(_field(value, n), lambda v: F.when(v.isNotNull(), problems(v, s, _inside(place, n))).otherwise(_none()))
    return F.when(_is(value, "object"), F.concat(_none(), *(told(n, s) for n, s in below.items()))).otherwise(_none())


def _alternatives(value: Column, place: Column, options: list[dict], schema: dict) -> Column:
    return _when(~reduce(lambda a, b: a | b, (F.size(problems(value, o, place)) == 0 for o in options)), place, "no allowed form")


#: The keywords that are checked, each with the column of its problems; a type that is wrong hides what else is.
RULES = {
    "anyOf": _alternatives,
    "oneOf": _alternatives,
    "enum": _one_of,
    "const": lambda value, place, wanted, schema: _when(~_equals(value, wanted), place, f"not {wanted!r}"),
    "minLength": _least("string", lambda v: F.length(_text(v)), "too short"),
    "minItems": _least("array", lambda v: F.size(_items_of(v)), "too few items"),
    "required": _required,
    "properties": _properties,
    "items": _items,
}


def problems(value: Column, schema: dict, place: Column | None = None) -> Column:
    """array<string>: what of the schema a variant does not keep. The schema is read while the plan is made: one expression for each of its
    keywords, none for what it does not say. A required field with a default may be absent."""
    place = F.lit("(root)") if place is None else place
    found = [rule(value, place, schema[k], schema) for k, rule in RULES.items() if k in schema]
    rest = F.concat(_none(), *found)
    if "type" not in schema:
        return rest
    return X.let(_type(value, place, schema["type"], schema), lambda wrong: F.when(F.size(wrong) > 0, wrong).otherwise(rest))


def structured(reply: Column | str, schema: dict) -> Column:
    """array<string>: the first MOST_PROBLEMS problems of a reply's JSON object; empty where it can be used."""
    told = lambda value: F.when(value.isNull(), F.array(F.lit("not a JSON object"))).otherwise(F.slice(problems(value, schema), 1, MOST_PROBLEMS))
    return X.let(F.try_parse_json(X.first_json(reply)), told)
