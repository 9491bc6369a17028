"""Metaschemas of the drafts, built from the shape of each keyword, and a lookup by URI."""

from __future__ import annotations

import functools
from urllib.parse import urldefrag

from streamcontract.plans import dialects

_SCHEMA, _NAT, _STR, _BOOL, _NUM, _STRS = "schema", "nat", "str", "bool", "num", "strs"
_SHAPES = {
    **dict.fromkeys(("maxLength", "minLength", "maxItems", "minItems", "maxProperties", "minProperties", "minContains", "maxContains"), _NAT),
    **dict.fromkeys(("pattern", "format", "contentEncoding", "contentMediaType", "$comment", "title", "description", "$ref", "$schema", "$anchor", "$dynamicRef", "$dynamicAnchor", "$recursiveRef"), _STR),
    **dict.fromkeys(("uniqueItems", "readOnly", "writeOnly", "deprecated", "$recursiveAnchor"), _BOOL),
    **dict.fromkeys(("maximum", "minimum"), _NUM),
    "required": _STRS,
}


def _keyword(name: str, draft: str, self_ref: dict) -> object:
    nat = {"type": "integer", "minimum": 0}
    shape = _SHAPES.get(name)
    if name in ("exclusiveMaximum", "exclusiveMinimum"):
        return {"type": "boolean" if draft == "draft-04" else "number"}
    if shape is not None:
        strings = {"type": "array", "items": {"type": "string"}, "uniqueItems": True}
        if draft == "draft-04":
            strings = strings | {"minItems": 1}
        return {_NAT: nat, _STR: {"type": "string"}, _BOOL: {"type": "boolean"}, _NUM: {"type": "number"}, _STRS: strings}[shape]
    if name == "multipleOf":
        return {"type": "number", "minimum": 0, "exclusiveMinimum": True} if draft == "draft-04" else {"type": "number", "exclusiveMinimum": 0}
    if name == "type":
        kinds = {"enum": ["array", "boolean", "integer", "null", "number", "object", "string"]}
        return {"anyOf": [kinds, {"type": "array", "items": kinds, "minItems": 1, "uniqueItems": True}]}
    if name == "enum":
        return {"type": "array"}
    if name in ("allOf", "anyOf", "oneOf", "prefixItems"):
        return {"type": "array", "minItems": 1, "items": self_ref}
    if name == "items" and draft != "2020-12":
        return {"anyOf": [self_ref, {"type": "array", "minItems": 1, "items": self_ref}]}
    if name in ("properties", "patternProperties", "dependentSchemas", "$defs", "definitions"):
        return {"type": "object", "additionalProperties": self_ref}
    if name == "dependencies":
        return {"type": "object", "additionalProperties": {"anyOf": [self_ref, {"type": "array", "items": {"type": "string"}}]}}
    if name == "dependentRequired":
        return {"type": "object", "additionalProperties": {"type": "array", "items": {"type": "string"}}}
    if name in ("additionalItems", "additionalProperties") and draft == "draft-04":
        return {"anyOf": [{"type": "boolean"}, self_ref]}
    if name in ("additionalItems", "additionalProperties", "contains", "propertyNames", "if", "then", "else", "not", "unevaluatedItems", "unevaluatedProperties", "items"):
        return self_ref
    return True if draft != "draft-04" else {}


@functools.cache
def metaschema(draft: str) -> dict:
    """A schema that accepts just the well-formed schemas of a draft."""
    new = draft in dialects.STANDARD
    self_ref = {"$dynamicRef": "#meta"} if draft == "2020-12" else {"$recursiveRef": "#"} if draft == "2019-09" else {"$ref": "#"}
    names = sorted(dialects.KEYWORDS[draft] | {"title", "description", "$ref", "$schema", "definitions"} | ({"$defs", "$anchor", "$comment", "readOnly", "writeOnly", "deprecated"} if new else set()))
    uri = dialects.URI_OF[draft]
    out: dict = {"$schema": uri + "#" * (not new), ("id" if draft == "draft-04" else "$id"): uri + "#" * (not new), "type": "object" if draft == "draft-04" else ["object", "boolean"]}
    out["properties"] = {n: _keyword(n, draft, self_ref) for n in names}
    if draft == "2020-12":
        out["$dynamicAnchor"] = "meta"
    if draft == "2019-09":
        out["$recursiveAnchor"] = True
    if new:
        out["$vocabulary"] = {v.uri: v.required for v in dialects.STANDARD[draft]}
    return out


def uris() -> list[str]:
    return list(dialects.URIS)


def lookup(uri: str) -> dict | None:
    """The built-in metaschema of a URI, whose fragment does not matter."""
    draft = dialects.URIS.get(urldefrag(uri)[0])
    return metaschema(draft) if draft else None


def violations(schema: object, draft: str) -> list:
    """What a metaschema has against a schema."""
    from streamcontract.plans.jsonschema import Config, Evaluator

    return Evaluator(metaschema(draft), Config(draft=draft)).evaluate(schema).errors
