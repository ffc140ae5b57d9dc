"""Documents of open shape against nested schemas: one column expression that names every place at fault.

A schema is a dict in the words of JSON Schema: ``type`` (a name or a list of names),
``required``, ``properties``, ``additionalProperties`` (False only), ``items``,
``minItems``, ``enum``, ``pattern``, ``minimum`` and ``maximum``. It is compiled once on
the driver; the expression grows with the schema, not with the documents.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, functions as F

from chatloom.functions.text import let

Schema = Mapping[str, Any]
_NONE = "array<string>"


def _inner(v: Column, name: str) -> Column:
    mark = '"' if "'" in name else "'"
    if mark in name:
        raise ValueError(f"a name with both kinds of quotes cannot be looked up: {name}")
    return F.try_variant_get(v, f"$[{mark}{name}{mark}]", "variant")


def _is(v: Column, kind: str) -> Column:
    """Is the value of a JSON type? Containers are asked for as such, so that a large one is not described first."""
    if kind == "object":
        return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
    if kind == "array":
        return F.try_variant_get(v, "$", "array<variant>").isNotNull()
    said = F.schema_of_variant(v)
    number = said.rlike(r"^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL\(.*\)|FLOAT|DOUBLE)$")
    if kind == "integer":
        whole = F.try_variant_get(v, "$", "double")
        return number & (whole == F.floor(whole))
    return {"string": said == "STRING", "boolean": said == "BOOLEAN", "null": said == "VOID", "number": number}[kind]


def _below(schema: Schema, path: Column) -> Callable[[Column], Column]:
    return lambda v: faults(v, schema, path)


def faults(v: Column, schema: Schema, path: Column | str = "$") -> Column:
    """Array of ``path: rule`` of everything in a variant that the schema does not allow; empty for a valid one."""
    at = F.lit(path) if isinstance(path, str) else path
    said = lambda rule: F.concat(at, F.lit(f": {rule}"))
    when = lambda broken, rule: F.when(F.coalesce(broken, F.lit(True)), F.array(said(rule))).otherwise(F.array().cast(_NONE))
    found: list[Column] = []

    for name in schema.get("required", ()):
        found.append(F.when(_is(v, "object") & _inner(v, name).isNull(), F.array(F.concat(at, F.lit(f".{name}: required")))).otherwise(F.array().cast(_NONE)))
    for name, inner in schema.get("properties", {}).items():
        found.append(F.when(_inner(v, name).isNotNull(), let(_inner(v, name), _below(inner, F.concat(at, F.lit(f".{name}"))))).otherwise(F.array().cast(_NONE)))
    if schema.get("additionalProperties") is False:
        known = list(schema.get("properties", {}))
        names = F.filter(F.array_sort(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))), lambda k: ~k.isin(known))
        found.append(F.coalesce(F.transform(names, lambda k: F.concat(at, F.lit("."), k, F.lit(": unknown"))), F.array().cast(_NONE)))
    listed = F.try_variant_get(v, "$", "array<variant>")
    if "items" in schema:
        each = F.transform(listed, lambda x, i: faults(x, schema["items"], F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))
        found.append(F.coalesce(F.flatten(each), F.array().cast(_NONE)))
    if "minItems" in schema:
        found.append(F.when(F.size(listed) < schema["minItems"], F.array(said("minItems"))).otherwise(F.array().cast(_NONE)))
    text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
    if "enum" in schema:
        found.append(when(~text.isin([str(x) for x in schema["enum"]]), "enum"))
    if "pattern" in schema:
        found.append(F.when(_is(v, "string"), when(~text.rlike(schema["pattern"]), "pattern")).otherwise(F.array().cast(_NONE)))
    for rule, broken in (("minimum", lambda n: number < n), ("maximum", lambda n: number > n)):
        if rule in schema:
            found.append(F.when(_is(v, "number"), when(broken(schema[rule]), rule)).otherwise(F.array().cast(_NONE)))

    below = F.concat(*found) if found else F.array().cast(_NONE)
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else list(kinds)
    if not kinds:
        return below
    fits = _is(v, kinds[0])
    for kind in kinds[1:]:
        fits = fits | _is(v, kind)
    return F.when(F.coalesce(fits, F.lit(False)), below).otherwise(F.array(said("type")))
