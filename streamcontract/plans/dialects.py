"""JSON-Schema drafts, their keywords, vocabularies and dialects."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field, replace

DRAFTS = ("draft-04", "draft-06", "draft-07", "2019-09", "2020-12")
# The drafts' metaschema URIs.
URIS = {
    "http://json-schema.org/draft-04/schema": "draft-04",
    "http://json-schema.org/draft-06/schema": "draft-06",
    "http://json-schema.org/draft-07/schema": "draft-07",
    "https://json-schema.org/draft/2019-09/schema": "2019-09",
    "https://json-schema.org/draft/2020-12/schema": "2020-12",
}
URI_OF = {v: k for k, v in URIS.items()}

_ALL = {
    "type", "enum", "const", "multipleOf", "maximum", "minimum", "exclusiveMaximum", "exclusiveMinimum", "maxLength", "minLength", "pattern", "format",
    "maxItems", "minItems", "uniqueItems", "items", "additionalItems", "maxProperties", "minProperties", "required", "properties", "patternProperties", "additionalProperties",
    "dependencies", "allOf", "anyOf", "oneOf", "not",
}
_06 = _ALL | {"contains", "propertyNames"}
_07 = _06 | {"if", "then", "else", "contentEncoding", "contentMediaType"}
_2019 = _07 | {"minContains", "maxContains", "dependentRequired", "dependentSchemas", "unevaluatedItems", "unevaluatedProperties"}
KEYWORDS = {"draft-04": _ALL, "draft-06": _06, "draft-07": _07, "2019-09": _2019, "2020-12": _2019 | {"prefixItems"}}

#: Keywords of the validation vocabulary; dropped where a metaschema does not list it.
ASSERTIONS = {"type", "enum", "const", "multipleOf", "maximum", "minimum", "exclusiveMaximum", "exclusiveMinimum", "maxLength", "minLength", "pattern", "maxItems", "minItems", "uniqueItems", "maxProperties", "minProperties", "required", "dependentRequired"}
METADATA = ("title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly")
CORE = {"$schema", "$id", "id", "$ref", "$anchor", "$dynamicRef", "$dynamicAnchor", "$recursiveRef", "$recursiveAnchor", "$vocabulary", "$comment", "$defs", "definitions", *METADATA, "contentSchema"}


class SchemaError(ValueError):
    """A schema that can't be used; `pointer` is where."""

    def __init__(self, message: str, pointer: tuple[str, ...] = ()) -> None:
        super().__init__(message)
        self.pointer = pointer


def draft_of(schema: object, default: str = "2020-12", known: dict[str, str] | None = None) -> str:
    """The draft that $schema names; SchemaError for an unknown one."""
    uri = schema.get("$schema") if isinstance(schema, dict) else None
    if uri is None:
        return default
    if not isinstance(uri, str):
        raise SchemaError("$schema must be a string", ("$schema",))
    found = URIS.get(uri.removesuffix("#")) or (known or {}).get(uri) or (known or {}).get(uri.removesuffix("#"))
    if found is None:
        raise SchemaError(f"unknown $schema {uri}", ("$schema",))
    return found


@dataclass(frozen=True)
class Vocabulary:
    uri: str
    keywords: frozenset[str]
    required: bool = True


@dataclass(frozen=True)
class Dialect:
    """format: assertion, annotation or by_config; unknown: ignore, warn, error or collect."""

    uri: str
    draft: str = "2020-12"
    name: str = ""
    vocabularies: dict[str, bool] = field(default_factory=dict)
    format: str = "by_config"
    unknown: str = "collect"


def _vocabulary(draft: str) -> str:
    return URI_OF[draft].replace("/schema", "/vocab/")


_PARTS = {
    "core": {"$schema", "$id", "$ref", "$anchor", "$defs", "$comment", "$vocabulary", "$dynamicRef", "$dynamicAnchor"},
    "applicator": {"prefixItems", "items", "contains", "additionalProperties", "properties", "patternProperties", "dependentSchemas", "propertyNames", "if", "then", "else", "allOf", "anyOf", "oneOf", "not"},
    "unevaluated": {"unevaluatedItems", "unevaluatedProperties"},
    "validation": ASSERTIONS | {"minContains", "maxContains"},
    "meta-data": set(METADATA),
    "format-annotation": {"format"},
    "content": {"contentEncoding", "contentMediaType", "contentSchema"},
}
STANDARD = {d: [Vocabulary(_vocabulary(d) + name, frozenset(keys)) for name, keys in _PARTS.items()] for d in ("2019-09", "2020-12")}
DIALECTS = [Dialect(URI_OF[d], d, d, {v.uri: v.required for v in STANDARD.get(d, [])}) for d in DRAFTS]


class VocabularyRegistry:
    """Vocabularies, dialects and custom keywords by name."""

    def __init__(self) -> None:
        self.vocabularies = {v.uri: v for vs in STANDARD.values() for v in vs}
        self.dialects = {d.uri: d for d in DIALECTS}
        self.keywords: dict[str, Callable] = {}

    def register(self, v: Vocabulary) -> None:
        if v.uri in self.vocabularies:
            raise SchemaError(f"vocabulary {v.uri} is registered")
        self.vocabularies[v.uri] = v

    def unregister(self, uri: str) -> None:
        self.vocabularies.pop(uri, None)

    def lookup(self, keyword: str) -> list[Vocabulary]:
        return [v for v in self.vocabularies.values() if keyword in v.keywords]

    def conflicts(self, uris: list[str]) -> dict[str, list[str]]:
        """Keywords that more than one of the vocabularies defines."""
        count = Counter(k for u in uris for k in self.vocabularies[u].keywords)
        return {k: [u for u in uris if k in self.vocabularies[u].keywords] for k, n in count.items() if n > 1}

    def register_dialect(self, d: Dialect) -> None:
        if d.uri in self.dialects:
            raise SchemaError(f"dialect {d.uri} is registered")
        if problems := self.validate_dialect(d):
            raise SchemaError("; ".join(problems))
        self.dialects[d.uri] = d

    def validate_dialect(self, d: Dialect) -> list[str]:
        out = [] if d.draft in DRAFTS else [f"unknown draft {d.draft}"]
        out += [f"unknown vocabulary {u}" for u, needed in d.vocabularies.items() if needed and u not in self.vocabularies]
        out += [f"keyword {k} is in {', '.join(us)}" for k, us in self.conflicts([u for u in d.vocabularies if u in self.vocabularies]).items()]
        return out

    def compose(self, base: Dialect, uri: str, *added: Vocabulary, **changes: object) -> Dialect:
        """A dialect with more vocabularies than `base`."""
        for v in added:
            self.vocabularies.setdefault(v.uri, v)
        return replace(base, uri=uri, vocabularies=base.vocabularies | {v.uri: v.required for v in added}, **changes)

    def resolve(self, schema: object) -> Dialect:
        uri = schema.get("$schema", URI_OF["2020-12"]) if isinstance(schema, dict) else URI_OF["2020-12"]
        for u in (uri, uri.removesuffix("#")):
            if u in self.dialects:
                return self.dialects[u]
        raise SchemaError(f"unknown dialect {uri}", ("$schema",))

    def known_keywords(self, d: Dialect) -> set[str]:
        return KEYWORDS[d.draft] | CORE | set().union(*(self.vocabularies[u].keywords for u in d.vocabularies if u in self.vocabularies)) | set(self.keywords)

    def unknown_keywords(self, schema: dict, d: Dialect) -> dict[str, object]:
        """By the dialect's mode: collected, warned about, refused or ignored."""
        found = {k: v for k, v in schema.items() if k not in self.known_keywords(d)}
        if found and d.unknown == "error":
            raise SchemaError(f"unknown keywords {sorted(found)}")
        if found and d.unknown == "warn":
            import warnings

            warnings.warn(f"unknown keywords {sorted(found)}", stacklevel=2)
        return {} if d.unknown == "ignore" else found


registry = VocabularyRegistry()


def keyword(name: str) -> Callable[[Callable], Callable]:
    """Registers f(keyword's value, instance) -> error text or None as a custom keyword."""

    def add(f: Callable) -> Callable:
        registry.keywords[name] = f
        return f

    return add
