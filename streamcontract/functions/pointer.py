"""JSON Pointer."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY: tuple[str, ...] = ()


def escape(segment: str) -> str:
    return segment.replace("~", "~0").replace("/", "~1")


def unescape(segment: str) -> str:
    return segment.replace("~1", "/").replace("~0", "~")


def render_pointer(segments: tuple[str, ...] | list[str]) -> str:
    return "".join("/" + escape(s) for s in segments)


def parse_pointer(text: str) -> tuple[str, ...]:
    """Segments of a pointer, which may be a URI fragment (percent-encoded, with or without #)."""
    text = unquote(text.removeprefix("#"))
    if not text:
        return ()
    if text[0] != "/":
        raise ValueError(f"not a JSON pointer: {text!r}")
    return tuple(unescape(s) for s in text[1:].split("/"))


def child(pointer: tuple[str, ...], segment: str) -> tuple[str, ...]:
    return (*pointer, segment)


def resolve(value: object, pointer: tuple[str, ...] | str) -> object:
    """The value at a pointer; KeyError where there is none."""
    for s in parse_pointer(pointer) if isinstance(pointer, str) else pointer:
        if isinstance(value, list) and s.isdigit() and (s == "0" or s[0] != "0") and int(s) < len(value):
            value = value[int(s)]
        elif isinstance(value, dict) and s in value:
            value = value[s]
        else:
            raise KeyError(s)
    return value


def render_column(segments: Column) -> Column:
    """Pointer text of an array of segments."""
    return F.concat_ws("", F.transform(segments, lambda s: F.concat(F.lit("/"), F.replace(F.replace(s, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))))


def parse_column(pointer: Column) -> Column:
    """Array of segments; null for texts that are no pointer."""
    text = F.regexp_replace(pointer, "^#", "")
    whole = F.split(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), "/")
    parts = F.transform(F.slice(whole, F.lit(2), F.size(whole)), lambda s: F.replace(F.replace(s, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))
    return F.when(text == "", F.array().cast("array<string>")).when(text.startswith("/"), parts)


def get_column(json: Column, pointer: str) -> Column:
    """The value at a fixed pointer of a JSON text, as JSON text; null where there is none."""
    path = "$"
    for s in parse_pointer(pointer):
        quoted = s.replace("\\", "\\\\").replace("'", "\\'")
        path += f"[{s}]" if s.isdigit() else f"['{quoted}']"
    return F.to_json(F.try_variant_get(F.try_parse_json(json), path, "variant"))
