"""Spark types derived from JSON Schemas."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALARS = {"string": T.StringType(), "number": T.DecimalType(38, 18), "integer": T.LongType(), "boolean": T.BooleanType(), "null": T.NullType()}


@dataclass(frozen=True)
class Options:
    """fields: keep, camel, pascal or snake; prefix: taken off field names first."""

    fields: str = "keep"
    prefix: str = ""
    wide_integers: bool = False
    doubles: bool = False


@dataclass
class Shape:
    """What a schema becomes. strategy: newtype, sum, enum, record or value."""

    strategy: str
    type: T.DataType
    name: str = ""
    symbols: list = field(default_factory=list)
    branches: list[Shape] = field(default_factory=list)


def _words(name: str) -> list[str]:
    return [w for w in re.split(r"[^A-Za-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name)) if w]


def type_name(name: str) -> str:
    """PascalCase, made an identifier."""
    out = "".join(w[:1].upper() + w[1:] for w in _words(name)) or "Type"
    return out if out[0].isalpha() else "T" + out


def field_name(name: str, o: Options | None = None) -> str:
    o = o or Options()
    if o.prefix and name.startswith(o.prefix):
        name = name[len(o.prefix) :]
    words = _words(name)
    if o.fields == "keep" or not words:
        return name
    if o.fields == "snake":
        out = "_".join(w.lower() for w in words)
    else:
        out = "".join(w[:1].upper() + w[1:] for w in words)
        if o.fields == "camel":
            out = out[:1].lower() + out[1:]
    return out if not out[0].isdigit() else "_" + out


def strategy(schema: dict) -> str:
    """x-newtype, then unions, then enumerations, then records of one required field, then records."""
    if schema.get("x-newtype"):
        return "newtype"
    if schema.get("oneOf") or schema.get("anyOf"):
        return "sum"
    if schema.get("enum"):
        return "enum"
    if schema.get("type") == "object" or "properties" in schema:
        p = schema.get("properties", {})
        return "newtype" if len(p) == 1 and list(p) == list(schema.get("required", ())) else "record"
    return "value"


def spark_type(schema: object, o: Options | None = None, defs: dict | None = None, seen: tuple = ()) -> T.DataType:
    """The type of a schema's instances; VARIANT where there is no single one."""
    o = o or Options()
    if not isinstance(schema, dict):
        return T.VariantType()
    defs = defs if defs is not None else {f"#/{k}/{n}": s for k in ("$defs", "definitions") for n, s in schema.get(k, {}).items()}
    ref = schema.get("$ref")
    if isinstance(ref, str):
        return spark_type(defs[ref], o, defs, (*seen, ref)) if ref in defs and ref not in seen else T.VariantType()
    if schema.get("enum"):
        return T.StringType() if all(isinstance(x, str) for x in schema["enum"]) else T.VariantType()
    if schema.get("oneOf") or schema.get("anyOf"):
        return T.VariantType()
    kind = schema.get("type")
    if isinstance(kind, list):
        rest = [k for k in kind if k != "null"]
        kind = rest[0] if len(rest) == 1 else None
    if kind == "array":
        items = schema.get("items")
        return T.ArrayType(spark_type(items, o, defs, seen) if isinstance(items, dict) else T.VariantType())
    if kind == "object" or (kind is None and "properties" in schema):
        if not schema.get("properties"):
            extra = schema.get("additionalProperties")
            return T.MapType(T.StringType(), spark_type(extra, o, defs, seen) if isinstance(extra, dict) else T.VariantType())
        needed = set(schema.get("required", ()))
        return T.StructType([T.StructField(field_name(k, o), spark_type(s, o, defs, seen), k not in needed) for k, s in schema["properties"].items()])
    if kind == "integer" and o.wide_integers:
        return T.DecimalType(38, 0)
    if kind == "number" and o.doubles:
        return T.DoubleType()
    return SCALARS.get(kind, T.VariantType())


def shape(schema: dict, name: str = "", o: Options | None = None) -> Shape:
    """The schema's strategy with its type."""
    how, t = strategy(schema), spark_type(schema, o)
    out = Shape(how, t, type_name(name or schema.get("title", "Type")))
    if how == "enum":
        out.symbols = list(schema["enum"])
    elif how == "sum":
        out.branches = [shape(b, f"{out.name}{i + 1}", o) for i, b in enumerate(schema.get("oneOf") or schema["anyOf"]) if isinstance(b, dict)]
    elif how == "newtype" and isinstance(t, T.StructType) and len(t) == 1:
        out.type = t[0].dataType
    return out


def struct_for(schema: dict, o: Options | None = None) -> T.StructType:
    """The StructType of an object schema."""
    t = spark_type(schema, o)
    if not isinstance(t, T.StructType):
        raise ValueError("not an object schema with properties")
    return t


def parsed(df: DataFrame, json: str, schema: dict, result: str = "data") -> DataFrame:
    """df with a JSON column parsed by the derived type."""
    t = spark_type(schema)
    return df.withColumn(result, F.try_parse_json(json) if isinstance(t, T.VariantType) else F.from_json(json, t))


def describe(schema: dict) -> str:
    return spark_type(schema).simpleString()
