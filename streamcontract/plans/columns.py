"""JSON Schema compiled to a native Spark column.

`compile_column` turns a schema into one boolean expression over a VARIANT column:
it stays in whole-stage code generation and needs no Python. Schemas that a column
can't say alike raise NotNative: recursion, dynamic references, unevaluated
keywords, structural equality of arrays and objects, unique items, formats and
patterns without a native form, custom keywords.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from streamcontract.functions import ecma, formats
from streamcontract.plans.dialects import ASSERTIONS, KEYWORDS
from streamcontract.plans.jsonschema import Config, Documents, Evaluator, _unicode, is_number


class NotNative(ValueError):
    pass


def _get(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


class _Value:
    """An instance as a column, with its views made once."""

    def __init__(self, v: Column) -> None:
        self.v = v
        self.kind = F.schema_of_variant(v)
        self.is_string = self.kind == "STRING"
        self.is_boolean = self.kind == "BOOLEAN"
        self.is_null = self.kind == "VOID"
        self.is_number = self.kind.isin("BIGINT", "DOUBLE", "FLOAT") | self.kind.startswith("DECIMAL")
        self.is_array = self.kind.startswith("ARRAY")
        self.is_object = self.kind.startswith("OBJECT")

    @property
    def string(self) -> Column:
        return _get(self.v, "string")

    @property
    def double(self) -> Column:
        return _get(self.v, "double")

    @property
    def items(self) -> Column:
        return _get(self.v, "array<variant>")

    @property
    def members(self) -> Column:
        return _get(self.v, "map<string,variant>")


class Compiler:
    def __init__(self, evaluator: Evaluator) -> None:
        self.documents: Documents = evaluator.documents
        self.config: Config = evaluator.config
        self.assertive = evaluator.assertive
        self.custom = set(evaluator.custom)

    def run(self, schema: object, x: _Value, base: str, draft: str, inside: tuple[int, ...] = ()) -> Column:
        """True just when the schema accepts a non-null variant."""
        if isinstance(schema, bool):
            return F.lit(schema)
        if id(schema) in inside:
            raise NotNative("recursive reference")
        inside = (*inside, id(schema))
        if known := self.documents.bases.get(id(schema)):
            _, base, draft = known
        parts: list[Column] = []
        if isinstance(schema.get("$ref"), str):
            target, b, d = self.documents.resolve(schema["$ref"], base)
            parts.append(self.run(target, x, b, d, inside))
            if draft in ("draft-04", "draft-06", "draft-07"):
                return parts[0]
        if bad := {"$dynamicRef", "$recursiveRef", "unevaluatedItems", "unevaluatedProperties"} & schema.keys():
            raise NotNative(", ".join(sorted(bad)))
        if bad := self.custom & schema.keys():
            raise NotNative(f"custom keywords {sorted(bad)}")
        active = KEYWORDS[draft] | ({"const"} if draft == "draft-04" else set())
        s = {k: v for k, v in schema.items() if k in active and (self.assertive or k not in ASSERTIONS)}
        go = lambda sub, value: self.run(sub, value, base, draft, inside)
        if "type" in s:
            names = [s["type"]] if isinstance(s["type"], str) else s["type"]
            parts.append(_any([self._type(x, n) for n in names]))
        if "enum" in s:
            parts.append(_any([self._equals(x, c) for c in s["enum"]]))
        if "const" in s:
            parts.append(self._equals(x, s["const"]))
        parts += self._numbers(s, x, draft)
        parts += self._strings(s, x, draft)
        parts += self._arrays(s, x, go)
        parts += self._objects(s, x, go)
        for key, join in (("allOf", _all), ("anyOf", _any)):
            if key in s:
                parts.append(join([go(y, x) for y in s[key]]))
        if "oneOf" in s:
            n = F.lit(0)
            for y in s["oneOf"]:
                n = n + go(y, x).cast("int")
            parts.append(n == 1)
        if "not" in s:
            parts.append(~go(s["not"], x))
        if "if" in s and ("then" in s or "else" in s):
            parts.append(F.when(go(s["if"], x), go(s.get("then", True), x)).otherwise(go(s.get("else", True), x)))
        return _all(parts)

    def _type(self, x: _Value, name: str) -> Column:
        if name == "integer":
            # whole doubles and decimals are integers too
            return (x.kind == "BIGINT") | (x.is_number & F.coalesce(x.double % 1 == 0, F.lit(False)))
        return {"null": x.is_null, "boolean": x.is_boolean, "object": x.is_object, "array": x.is_array, "number": x.is_number, "string": x.is_string}[name]

    def _equals(self, x: _Value, c: object) -> Column:
        if c is None:
            return x.is_null
        if isinstance(c, bool):
            return x.is_boolean & F.coalesce(_get(x.v, "boolean") == F.lit(c), F.lit(False))
        if is_number(c):
            return x.is_number & self._compare(x, c, lambda a, b: a == b)
        if isinstance(c, str):
            return x.is_string & F.coalesce(x.string == F.lit(c), F.lit(False))
        raise NotNative("equality of arrays and objects")

    def _compare(self, x: _Value, bound: object, how: Callable[[Column, Column], Column]) -> Column:
        """Exact where both fit decimal(38, 9), else as doubles."""
        d = Decimal(str(bound))
        double = how(x.double, F.lit(float(bound)))
        if abs(d) < Decimal(10) ** 28 and d == d.quantize(Decimal("1e-9")):
            exact = _get(x.v, "decimal(38,9)")
            return F.coalesce(F.when(x.kind.isin("DOUBLE", "FLOAT"), double).otherwise(F.when(exact.cast("double") == x.double, how(exact, F.lit(d).cast("decimal(38,9)"))).otherwise(double)), double, F.lit(False))
        return F.coalesce(double, F.lit(False))

    def _numbers(self, s: dict, x: _Value, draft: str) -> list[Column]:
        out = []
        for key, over, strict_over in (("maximum", lambda a, b: a <= b, lambda a, b: a < b), ("minimum", lambda a, b: a >= b, lambda a, b: a > b)):
            strict = "exclusive" + key.capitalize()
            if draft == "draft-04":
                if key in s:
                    out.append(self._compare(x, s[key], strict_over if s.get(strict) is True else over))
            else:
                if key in s:
                    out.append(self._compare(x, s[key], over))
                if strict in s:
                    out.append(self._compare(x, s[strict], strict_over))
        if "multipleOf" in s:
            by = float(s["multipleOf"])
            q = x.double / F.lit(by)
            rest = F.abs(q) % 1
            good = F.coalesce((rest < 1e-10) | (F.abs(1 - rest) < 1e-10), F.lit(False))
            if by <= 1 and (1 / by).is_integer():
                good = self._type(x, "integer") | good
            out.append(good)
        return [~x.is_number | _all(out)] if out else []

    def _strings(self, s: dict, x: _Value, draft: str) -> list[Column]:
        out = []
        if "maxLength" in s:
            out.append(F.char_length(x.string) <= int(s["maxLength"]))
        if "minLength" in s:
            out.append(F.char_length(x.string) >= int(s["minLength"]))
        if "pattern" in s:
            try:
                out.append(ecma.test_column(x.string, s["pattern"], "u" if _unicode(s["pattern"]) else ""))
            except ecma.NotTranslatable as e:
                raise NotNative(str(e)) from e
        if "format" in s and self.config.format_assertion:
            if (c := formats.column(s["format"], x.string)) is None:
                raise NotNative(f"format {s['format']}")
            out.append(c)
        if self.config.format_assertion or draft == "draft-07":
            data = x.string
            if s.get("contentEncoding") == "base64":
                plain = F.regexp_replace(x.string, r"\s", "")
                good = plain.rlike(r"\A[A-Za-z0-9+/]*={0,2}\z") & (F.char_length(plain) % 4 == 0)
                out.append(good)
                data = F.when(good, F.try_to_binary(plain, F.lit("base64")).cast("string"))
            if s.get("contentMediaType") == "application/json":
                out.append(data.isNull() | F.try_parse_json(data).isNotNull())
        return [~x.is_string | F.coalesce(_all(out), F.lit(False))] if out else []

    def _arrays(self, s: dict, x: _Value, go: Callable) -> list[Column]:
        out = []
        n = F.size(x.items)
        if "maxItems" in s:
            out.append(n <= int(s["maxItems"]))
        if "minItems" in s:
            out.append(n >= int(s["minItems"]))
        if s.get("uniqueItems"):
            raise NotNative("uniqueItems")
        rest, first = None, 0
        heads = s.get("prefixItems") or (s["items"] if isinstance(s.get("items"), list) else [])
        for i, sub in enumerate(heads):
            item = F.get(x.items, F.lit(i))
            out.append((n <= i) | go(sub, _Value(item)))
        first = len(heads)
        if isinstance(s.get("items"), list):
            rest = s.get("additionalItems")
        elif "items" in s:
            rest = s["items"]
        if rest is not None and rest is not True:
            tail = F.slice(x.items, F.lit(first + 1), F.greatest(n - first, F.lit(0))) if first else x.items
            out.append(F.forall(tail, lambda e: go(rest, _Value(e))))
        if "contains" in s:
            hits = F.size(F.filter(x.items, lambda e: go(s["contains"], _Value(e))))
            out.append(hits >= int(s.get("minContains", 1)))
            if "maxContains" in s:
                out.append(hits <= int(s["maxContains"]))
        return [~x.is_array | F.coalesce(_all(out), F.lit(False))] if out else []

    def _objects(self, s: dict, x: _Value, go: Callable) -> list[Column]:
        out = []
        keys = F.map_keys(x.members)
        has = lambda k: F.array_contains(keys, F.lit(k))
        if s.get("required"):
            out.append(F.size(F.array_except(F.array(*map(F.lit, s["required"])), keys)) == 0)
        if "maxProperties" in s:
            out.append(F.size(keys) <= int(s["maxProperties"]))
        if "minProperties" in s:
            out.append(F.size(keys) >= int(s["minProperties"]))
        for k, sub in s.get("properties", {}).items():
            member = F.element_at(x.members, F.lit(k))
            out.append(~has(k) | go(sub, _Value(member)))
        patterns: list[tuple[str, object]] = []
        for p, sub in s.get("patternProperties", {}).items():
            try:
                patterns.append((ecma.translate(p, "u" if _unicode(p) else ""), sub))
            except ecma.NotTranslatable as e:
                raise NotNative(str(e)) from e
            except ecma.RegexError:
                continue
        entries = F.map_entries(x.members)

        def matching(p: str, sub: object) -> Callable[[Column], Column]:
            return lambda e: ~e["key"].rlike(p) | go(sub, _Value(e["value"]))

        for p, sub in patterns:
            out.append(F.forall(entries, matching(p, sub)))
        extra = s.get("additionalProperties")
        if extra is not None and extra is not True:

            def other(e: Column) -> Column:
                named = e["key"].isin(list(s["properties"])) if s.get("properties") else F.lit(False)
                for p, _ in patterns:
                    named = named | e["key"].rlike(p)
                return named | go(extra, _Value(e["value"]))

            out.append(F.forall(entries, other))
        if "propertyNames" in s:
            out.append(F.forall(keys, lambda k: go(s["propertyNames"], _Value(F.try_parse_json(_quoted(k))))))
        for key in ("dependencies", "dependentRequired", "dependentSchemas"):
            for k, sub in s.get(key, {}).items():
                if isinstance(sub, list):
                    if sub:
                        out.append(~has(k) | (F.size(F.array_except(F.array(*map(F.lit, sub)), keys)) == 0))
                else:
                    out.append(~has(k) | go(sub, x))
        return [~x.is_object | F.coalesce(_all(out), F.lit(False))] if out else []


def _quoted(k: Column) -> Column:
    """A string as JSON text."""
    return F.regexp_extract(F.to_json(F.struct(k.alias("k"))), r"(?s)^\{\"k\":(.*)\}$", 1)


def _all(parts: list[Column]) -> Column:
    out = None
    for p in parts:
        out = p if out is None else out & p
    return F.lit(True) if out is None else out


def _any(parts: list[Column]) -> Column:
    out = None
    for p in parts:
        out = p if out is None else out | p
    return F.lit(False) if out is None else out


def compile_column(evaluator: Evaluator, value: Column) -> Column:
    """Whether the schema accepts a VARIANT column; null where it is null."""
    schema = evaluator.schema
    base = evaluator.documents.bases[id(schema)][1] if isinstance(schema, dict) else ""
    return F.when(value.isNotNull(), F.coalesce(Compiler(evaluator).run(schema, _Value(value), base, evaluator.root.draft), F.lit(False)))
