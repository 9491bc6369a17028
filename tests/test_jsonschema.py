import json
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from streamcontract.plans import dialects
from streamcontract.plans.columns import NotNative
from streamcontract.plans.dialects import SchemaError
from streamcontract.plans.jsonschema import STRICT, Config, Documents, Evaluator, canon, loads, metadata, multiple, render
from streamcontract.plans.validation import Validator, validate_full
from streamcontract.sources import metaschemas

# draft, schema, [(instance, valid)]
CASES = [
    ("2020-12", {"type": ["integer", "null"]}, [(1, True), (Decimal("1.0"), True), (1.5, False), (None, True), (True, False)]),
    ("2020-12", {"enum": [1, "a", [1, {"b": 2}]]}, [(Decimal("1.0"), True), ([1, {"b": Decimal("2.0")}], True), ("b", False), (True, False)]),
    ("2020-12", {"const": False}, [(False, True), (0, False)]),
    ("2020-12", {"uniqueItems": True}, [([1, True], True), ([1, Decimal("1.0")], False), ([{"a": 1, "b": 2}, {"b": 2, "a": 1}], False), ([], True)]),
    ("2020-12", {"maxLength": 1}, [("🐲", True), ("ab", False), (12, True)]),
    ("draft-04", {"maximum": 3, "exclusiveMaximum": True}, [(3, False), (2.9, True)]),
    ("2020-12", {"prefixItems": [{"type": "integer"}], "items": False}, [([1], True), ([1, 2], False), (["a"], False)]),
    ("2019-09", {"items": [{"type": "integer"}], "additionalItems": {"type": "string"}}, [([1, "a"], True), ([1, 2], False)]),
    ("2020-12", {"contains": {"minimum": 5}, "minContains": 2, "maxContains": 3}, [([5, 6], True), ([5], False), ([5, 6, 7, 8], False)]),
    ("2020-12", {"contains": {"minimum": 5}, "minContains": 0}, [([], True)]),
    ("2020-12", {"allOf": [{"properties": {"a": True}}], "unevaluatedProperties": False}, [({"a": 1}, True), ({"b": 1}, False)]),
    ("2020-12", {"if": {"properties": {"a": {"const": 1}}, "required": ["a"]}, "then": {"required": ["b"]}, "unevaluatedProperties": False}, [({"a": 1, "b": 2}, False), ({"a": 1}, False)]),
    ("2020-12", {"oneOf": [{"multipleOf": 2}, {"multipleOf": 3}]}, [(2, True), (6, False), (5, False)]),
    ("2020-12", {"$ref": "#/$defs/n", "maximum": 3, "$defs": {"n": {"minimum": 1}}}, [(2, True), (4, False), (0, False)]),
    ("draft-07", {"$ref": "#/definitions/n", "maximum": 3, "definitions": {"n": {"minimum": 1}}}, [(4, True), (0, False)]),
    ("2020-12", {"$id": "http://x/tree", "$dynamicAnchor": "node", "type": "object", "properties": {"kids": {"type": "array", "items": {"$dynamicRef": "#node"}}}}, [({"kids": [{"kids": []}]}, True), ({"kids": [1]}, False)]),
    ("2020-12", {"dependentSchemas": {"a": {"required": ["b"]}}, "dependentRequired": {"c": ["d"]}}, [({"a": 1}, False), ({"a": 1, "b": 1}, True), ({"c": 1}, False)]),
    ("2020-12", {"propertyNames": {"pattern": "^x"}}, [({"xa": 1}, True), ({"a": 1}, False)]),
    ("draft-07", {"contentEncoding": "base64", "contentMediaType": "application/json"}, [("eyJhIjoxfQ==", True), ("e30", False), ("YWJj", False)]),
    ("2020-12", False, [(1, False)]),
]


@pytest.mark.parametrize(("draft", "schema", "tests"), CASES)
def test_cases(spark, draft, schema, tests):
    config = Config(draft=draft)
    e = Evaluator(schema, config)
    for v, want in tests:
        assert e.is_valid(v) is want, v
    v = Validator(schema, config)
    text = [json.dumps(x, default=float) for x, _ in tests]
    columns = [v.is_valid(F.lit(t)).alias(f"c{i}") for i, t in enumerate(text)]
    assert list(spark.range(1).select(*columns).first()) == [w for _, w in tests]


leaves = st.one_of(st.none(), st.booleans(), st.integers(-20, 20), st.text("abz", max_size=3))
values = st.recursive(leaves, lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from("abc"), x, max_size=3), max_leaves=6)
simple = st.one_of(
    st.fixed_dictionaries({"type": st.sampled_from(["null", "boolean", "integer", "string", "array", "object"])}),
    st.fixed_dictionaries({"minimum": st.integers(-5, 5), "maximum": st.integers(-5, 5)}),
    st.fixed_dictionaries({"minLength": st.integers(0, 2)}),
    st.fixed_dictionaries({"required": st.lists(st.sampled_from("abc"), unique=True)}),
    st.fixed_dictionaries({"maxItems": st.integers(0, 3)}),
    st.fixed_dictionaries({"enum": st.lists(leaves, min_size=1, max_size=3)}),
)
schemas = st.recursive(
    simple,
    lambda s: st.one_of(
        st.fixed_dictionaries({"allOf": st.lists(s, min_size=1, max_size=2)}),
        st.fixed_dictionaries({"oneOf": st.lists(s, min_size=1, max_size=2)}),
        st.fixed_dictionaries({"not": s}),
        st.fixed_dictionaries({"items": s}),
        st.fixed_dictionaries({"contains": s}),
        st.fixed_dictionaries({"properties": st.dictionaries(st.sampled_from("abc"), s, max_size=2), "additionalProperties": s}),
        st.fixed_dictionaries({"if": s, "then": s, "else": s}),
    ),
    max_leaves=4,
)


@settings(max_examples=15, deadline=None)
@given(st.lists(schemas, min_size=4, max_size=4), st.lists(values, min_size=8, max_size=8))
def test_column_and_evaluator_agree(spark, some, instances):
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(instances)], "i int, j string").coalesce(1)
    made = [Validator(s) for s in some]
    got = rows.select("i", *[v.is_valid("j", native=True).alias(f"v{k}") for k, v in enumerate(made)]).collect()
    for r in got:
        for k, v in enumerate(made):
            assert r[f"v{k}"] == v.evaluator.is_valid(instances[r["i"]]), (some[k], instances[r["i"]])


def test_malformed_and_null_texts_are_null(spark):
    for schema in ({"type": "object"}, {"uniqueItems": True}):
        v = Validator(schema)
        df = spark.createDataFrame([("{",), (None,), ("",), ('{"a":1,"a":2}',)], "j string")
        assert [r[0] for r in df.select(v.is_valid("j")).collect()] == [None] * 4


def test_what_is_native():
    assert Validator({"type": "object"}).native
    for s in ({"uniqueItems": True}, {"const": [1]}, {"$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}, "$ref": "#/$defs/a"}, {"unevaluatedItems": False}):
        assert not Validator(s).native
    with pytest.raises(NotNative):
        from streamcontract.plans.columns import compile_column

        compile_column(Evaluator({"uniqueItems": True}), F.lit(None))


def test_errors_and_annotations(spark):
    schema = {"title": "t", "properties": {"a": {"items": {"maximum": 1, "title": "n"}}}}
    df = spark.createDataFrame([('{"a":[1,5]}',), ('{"a":[1]}',)], "j string")
    bad, good = (r.validation for r in validate_full(df, "j", schema, config=Config(collect_annotations=True)).collect())
    assert not bad.valid
    assert [(e.keyword, e.schema_path, e.instance_path) for e in bad.errors] == [("maximum", "/properties/a/items/maximum", "/a/1")]
    assert good.valid
    assert good.annotations == {"": {"title": '"t"'}, "/a/0": {"title": '"n"'}}


@pytest.mark.parametrize("schema", [{"type": "x"}, {"minLength": -1}, {"multipleOf": 0}, {"allOf": []}, {"required": "a"}, {"pattern": "("}, {"properties": {"a": {"maximum": "1"}}}, 5])
def test_bad_schemas(schema):
    with pytest.raises(SchemaError):
        Evaluator(schema)


def test_drafts():
    assert dialects.draft_of({"$schema": "http://json-schema.org/draft-07/schema#"}) == "draft-07"
    assert dialects.draft_of({}) == "2020-12"
    with pytest.raises(SchemaError):
        dialects.draft_of({"$schema": "http://nowhere/"})
    for d in dialects.DRAFTS:
        assert metaschemas.violations({"maxLength": 1, "properties": {}}, d) == []
        assert metaschemas.violations({"maxLength": -1}, d)
        assert metaschemas.violations({"properties": {"a": {"minItems": "x"}}}, d)


def test_references_between_documents():
    docs = {"http://x/a": {"$ref": "b#/$defs/c"}, "http://x/b": {"$defs": {"c": {"type": "integer"}}}}
    seen = []

    def load(uri):
        seen.append(uri)
        return docs[uri]

    e = Evaluator({"$ref": "http://x/a"}, documents=Documents(load))
    assert e.is_valid(1)
    assert not e.is_valid("a")
    assert sorted(seen) == ["http://x/a", "http://x/b"]
    assert not Evaluator({"$ref": "http://x/none"}, documents=Documents(load)).is_valid(1)


def test_recursion_ends():
    assert Evaluator({"$ref": "#"}).is_valid(1)


def test_formats_only_assert_when_asked():
    assert Evaluator({"format": "ipv4"}).is_valid("x")
    assert not Evaluator({"format": "ipv4"}, STRICT).is_valid("x")


def test_custom_keyword(spark):
    @dialects.keyword("x-odd")
    def odd(value, instance):
        return None if not value or (isinstance(instance, int) and instance % 2) else "even"

    try:
        v = Validator({"x-odd": True})
        assert not v.native
        assert v.evaluator.is_valid(3)
        assert not v.evaluator.is_valid(2)
    finally:
        dialects.registry.keywords.pop("x-odd")


def test_vocabularies_and_dialects():
    r = dialects.VocabularyRegistry()
    mine = dialects.Vocabulary("https://x/vocab", frozenset({"x-a", "type"}))
    r.register(mine)
    assert "type" in r.conflicts([mine.uri, dialects.STANDARD["2020-12"][3].uri])
    with pytest.raises(SchemaError):
        r.register(mine)
    d = r.compose(dialects.DIALECTS[-1], "https://x/dialect", dialects.Vocabulary("https://x/v2", frozenset({"x-b"})), unknown="error")
    r.register_dialect(d)
    assert r.resolve({"$schema": "https://x/dialect"}) is d
    assert r.unknown_keywords({"x-b": 1}, d) == {}
    with pytest.raises(SchemaError):
        r.unknown_keywords({"x-c": 1}, d)
    r.unregister("https://x/v2")
    assert r.validate_dialect(d) == ["unknown vocabulary https://x/v2"]


def test_numbers_and_canonical_forms():
    assert canon(1) == canon(Decimal("1.00")) != canon(True)
    assert multiple(Decimal("0.0075"), Decimal("0.0001"))
    assert not multiple(Decimal("1e308"), Decimal("0.123456789"))
    with pytest.raises(ValueError, match="duplicate"):
        loads('{"a":1,"a":2}')
    assert render({"b": Decimal("1.50"), "a": 1}) == '{"a": 1, "b": 1.5}'
    assert metadata({"title": "x", "type": "null"}) == {"title": "x"}
