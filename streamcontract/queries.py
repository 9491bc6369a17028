"""One query for each operator over the test tables, with its SQL."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streamcontract.functions import ecma, formats, idn, pointer
from streamcontract.operators import avro, events as E, outbox as O, registry as R
from streamcontract.plans import dialects, openapi, types as schema_types
from streamcontract.plans.jsonschema import Config
from streamcontract.plans.validation import validate, validate_full
from streamcontract.runtime import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# ---------------------------------------------------------------- flagship

EVENT_SCHEMA = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 0, "maximum": 49}}}


@query(
    "valid_events_by_type",
    "SELECT event_type, count(*) AS n, sum(CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 0 AND 49 THEN 1 ELSE 0 END)::BIGINT AS n_valid FROM events GROUP BY event_type",
)
def valid_events_by_type(spark: SparkSession, sf: str) -> DataFrame:
    """How many events of each type have a payload that the contract accepts."""
    events = validate(_table(spark, sf, "events").select("event_type", "props"), "props", EVENT_SCHEMA)
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("valid").cast("long")).alias("n_valid"))


# ---------------------------------------------------------------- keywords over orders as JSON

_BASE = """WITH b AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS t, o_orderpriority AS p, o_orderdate AS d,
  list_transform(range(0, o_orderkey % 5 + 1), lambda i: (o_orderkey + i) % 7) AS a FROM orders) """


def instances(spark: SparkSession, sf: str) -> DataFrame:
    """k and doc: an order as a JSON object; n is there for even keys, z for multiples of three."""
    o = _table(spark, sf, "orders")
    k = F.col("o_orderkey")
    items = F.transform(F.sequence(F.lit(0).cast("long"), k % 5), lambda i: (k + i) % 7)
    doc = F.struct(k.alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("t"), F.col("o_orderpriority").alias("p"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), items.alias("a"), F.when(k % 2 == 0, F.struct((k % 10).alias("x"), F.lit("n").alias("y"))).alias("n"), F.when(k % 3 == 0, F.lit("z")).alias("z"))
    return o.select(k.alias("k"), F.to_json(doc).alias("doc"))


def _keyword(name: str, schema: object, condition: str, config: Config | None = None) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return validate(instances(spark, sf), "doc", schema, "valid", config).select("k", "valid")

    QUERIES[name] = run
    SQL[name] = f"{_BASE} SELECT k, ({condition}) AS valid FROM b"


def _prop(name: str, schema: object, **more: object) -> dict:
    return {"properties": {name: schema}, **more}


_D4, _D7, _19 = Config(draft="draft-04"), Config(draft="draft-07"), Config(draft="2019-09")
_STRICT = Config(format_assertion=True)
_N = "k % 2 = 0"  # the member n is there
_Z = "k % 3 = 0"

for _name, _schema, _condition, *_config in [
    ("kw_1_type", _prop("t", {"type": "integer"}), "t = floor(t)"),
    ("kw_2_enum", _prop("s", {"enum": ["O", "P", 1, None]}), "s IN ('O', 'P')"),
    ("kw_3_const", _prop("s", {"const": "F"}), "s = 'F'"),
    ("kw_4_multiple_of", _prop("k", {"multipleOf": 3}), "k % 3 = 0"),
    ("kw_5_maximum", _prop("t", {"maximum": 100000}), "t <= 100000"),
    ("kw_6_minimum", _prop("t", {"minimum": 100000.5}), "t >= 100000.5"),
    ("kw_7_exclusive_maximum", _prop("k", {"exclusiveMaximum": 500}), "k < 500"),
    ("kw_8_exclusive_minimum", _prop("k", {"exclusiveMinimum": 500}), "k > 500"),
    ("kw_9_draft4_maximum", _prop("k", {"maximum": 500, "exclusiveMaximum": True}), "k < 500", _D4),
    ("kw_10_draft4_minimum", _prop("k", {"minimum": 500, "exclusiveMinimum": True}), "k > 500", _D4),
    ("kw_11_max_length", _prop("p", {"maxLength": 6}), "length(p) <= 6"),
    ("kw_12_min_length", _prop("p", {"minLength": 7}), "length(p) >= 7"),
    ("kw_13_pattern", _prop("p", {"pattern": "^[1-3]-\\w+$"}), "regexp_matches(p, '^[1-3]-\\w+$')"),
    ("kw_15_content_encoding", _prop("p", {"contentEncoding": "base64"}), "regexp_full_match(p, '([A-Za-z0-9+/]{4})*') ", _D7),
    ("kw_17_min_items", _prop("a", {"minItems": 3}), "len(a) >= 3"),
    ("kw_18_max_items", _prop("a", {"maxItems": 3}), "len(a) <= 3"),
    ("kw_19_unique_items", {"properties": {"a": {"uniqueItems": True, "contains": {"const": 0}}}}, "len(list_distinct(a)) = len(a) AND list_contains(a, 0)"),
    ("kw_20_items", _prop("a", {"items": {"minimum": 1}}), "list_min(a) >= 1"),
    ("kw_21_additional_items", _prop("a", {"items": [{"minimum": 2}], "additionalItems": {"maximum": 4}}), "a[1] >= 2 AND coalesce(list_max(a[2:]), 0) <= 4", _19),
    ("kw_22_prefix_items", _prop("a", {"prefixItems": [{"maximum": 3}, {"maximum": 4}]}), "a[1] <= 3 AND coalesce(a[2], 0) <= 4"),
    ("kw_23_contains", _prop("a", {"contains": {"const": 5}}), "list_contains(a, 5)"),
    ("kw_24_min_contains", _prop("a", {"contains": {"maximum": 3}, "minContains": 2}), "len(list_filter(a, lambda x: x <= 3)) >= 2"),
    ("kw_25_max_contains", _prop("a", {"contains": {"maximum": 3}, "maxContains": 2}), "len(list_filter(a, lambda x: x <= 3)) BETWEEN 1 AND 2"),
    ("kw_26_required", {"required": ["k", "n"]}, _N),
    ("kw_27_min_properties", {"minProperties": 8}, f"{_N} AND {_Z}"),
    ("kw_28_max_properties", {"maxProperties": 6}, f"NOT ({_N}) AND NOT ({_Z})"),
    ("kw_29_properties", _prop("n", _prop("x", {"maximum": 4})), f"NOT ({_N}) OR k % 10 <= 4"),
    ("kw_30_pattern_properties", {"patternProperties": {"^[kt]$": {"maximum": 90000}}}, "k <= 90000 AND t <= 90000"),
    ("kw_31_additional_properties", {"properties": {x: True for x in "kstpda"}, "patternProperties": {"^n": True}, "additionalProperties": False}, f"NOT ({_Z})"),
    ("kw_32_property_names", {"propertyNames": {"pattern": "^[^z]$", "maxLength": 1}}, f"NOT ({_Z})"),
    ("kw_33_dependencies", {"dependencies": {"z": ["n"], "n": _prop("k", {"multipleOf": 4})}}, f"(NOT ({_Z}) OR {_N}) AND (NOT ({_N}) OR k % 4 = 0)", _D7),
    ("kw_34_dependent_required", {"dependentRequired": {"z": ["n"]}}, f"NOT ({_Z}) OR {_N}"),
    ("kw_35_dependent_schemas", {"dependentSchemas": {"n": _prop("k", {"multipleOf": 4})}}, f"NOT ({_N}) OR k % 4 = 0"),
    ("kw_36_unevaluated_properties", {"allOf": [{"properties": {x: True for x in "kstpdan"}}], "unevaluatedProperties": False}, f"NOT ({_Z})"),
    ("kw_37_unevaluated_items", _prop("a", {"prefixItems": [True, True, True], "unevaluatedItems": False}), "len(a) <= 3"),
    ("kw_38_all_of", {"allOf": [_prop("k", {"minimum": 100}), _prop("s", {"const": "O"})]}, "k >= 100 AND s = 'O'"),
    ("kw_39_any_of", {"anyOf": [_prop("k", {"minimum": 900}), _prop("s", {"const": "O"})]}, "k >= 900 OR s = 'O'"),
    ("kw_40_one_of", {"oneOf": [_prop("k", {"multipleOf": 2}), _prop("k", {"multipleOf": 3})]}, "(k % 2 = 0) <> (k % 3 = 0)"),
    ("kw_41_not", {"not": {"required": ["n"]}}, f"NOT ({_N})"),
    ("kw_42_if_then_else", {"if": {"required": ["n"]}, "then": _prop("s", {"const": "O"}), "else": _prop("s", {"not": {"const": "O"}})}, f"({_N}) = (s = 'O')"),
    ("kw_45_ref", {"properties": {"k": {"$ref": "#/$defs/even"}}, "$defs": {"even": {"multipleOf": 2}}}, "k % 2 = 0"),
    ("kw_46_dynamic_ref", {"$id": "https://example.com/tree", "$dynamicAnchor": "node", "maxProperties": 7, "properties": {"n": {"$dynamicRef": "#node"}}}, f"NOT ({_N} AND {_Z})"),
    ("kw_47_recursive_ref", {"$recursiveAnchor": True, "maxProperties": 7, "properties": {"n": {"$recursiveRef": "#"}}}, f"NOT ({_N} AND {_Z})", _19),
    ("kw_48_anchor", {"properties": {"k": {"$ref": "other.json#low"}}, "$id": "https://example.com/root.json", "$defs": {"o": {"$id": "other.json", "$defs": {"l": {"$anchor": "low", "maximum": 700}}}}}, "k <= 700"),
    ("kw_50_boolean", {"properties": {"z": False}}, f"NOT ({_Z})"),
]:
    _keyword(_name, _schema, _condition, *_config)


@query("kw_51_annotations", f"{_BASE} SELECT k, CASE WHEN k >= 100 THEN '\"an order\"' END AS title, CASE WHEN k >= 100 THEN '\"its key\"' END AS k_description FROM b")
def kw_51_annotations(spark: SparkSession, sf: str) -> DataFrame:
    schema = {"title": "an order", "properties": {"k": {"minimum": 100, "description": "its key"}}}
    v = validate_full(instances(spark, sf), "doc", schema, config=Config(collect_annotations=True))
    return v.select("k", F.col("validation.annotations")[""]["title"].alias("title"), F.col("validation.annotations")["/k"]["description"].alias("k_description"))


@query("kw_53_custom", "SELECT o_orderkey AS k, length(o_orderpriority) % 2 = 0 AS valid FROM orders")
def kw_53_custom(spark: SparkSession, sf: str) -> DataFrame:
    dialects.keyword("x-evenLength")(_even_length)
    try:
        return validate(instances(spark, sf), "doc", {"properties": {"p": {"x-evenLength": True}}}).select("k", "valid")
    finally:
        dialects.registry.keywords.pop("x-evenLength")


def _even_length(value: object, instance: object) -> str | None:
    return "odd length" if value and isinstance(instance, str) and len(instance) % 2 else None


@query(
    "validation_errors",
    f"{_BASE}, e AS (SELECT 'maximum' AS keyword, '/properties/k/maximum' AS schema_path, '/k' AS instance_path FROM b WHERE k > 500 UNION ALL SELECT 'required', '/required', '' FROM b WHERE NOT ({_N})) SELECT keyword, schema_path, instance_path, count(*) AS n FROM e GROUP BY ALL",
)
def validation_errors(spark: SparkSession, sf: str) -> DataFrame:
    v = validate_full(instances(spark, sf), "doc", {"properties": {"k": {"maximum": 500}}, "required": ["n"]})
    return v.select(F.explode("validation.errors").alias("e")).select("e.keyword", "e.schema_path", "e.instance_path").groupBy("keyword", "schema_path", "instance_path").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- formats over made-up texts


def _format(fmt: str, text: str, condition: str) -> None:
    """Texts are made from a key n by the same expression in both dialects."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("n")).select("n", F.expr(text).alias("x"))
        native = formats.column(fmt, F.col("x"))
        if native is None:
            return validate(df.withColumn("j", F.concat(F.lit('"'), F.replace(F.col("x"), F.lit("\\"), F.lit("\\\\")), F.lit('"'))), "j", {"format": fmt}, config=_STRICT).select("n", "x", "valid")
        return df.select("n", "x", native.alias("valid"))

    name = "fmt_" + fmt.replace("-", "_")
    QUERIES[name] = run
    SQL[name] = f"SELECT n, x, ({condition}) AS valid FROM (SELECT n, {text} AS x FROM (SELECT o_orderkey AS n FROM orders))"


for _fmt, _text, _condition in [
    ("email", "concat('u', n % 7, CASE WHEN n % 3 = 0 THEN '..' ELSE '.' END, 'x@h', n % 5, '.com')", "n % 3 <> 0"),
    ("idn-email", "concat('ü', n % 7, CASE WHEN n % 3 = 0 THEN '@@' ELSE '@' END, 'bücher.example')", "n % 3 <> 0"),
    ("hostname", "concat('a', n % 9, CASE WHEN n % 4 = 0 THEN '-' ELSE '' END, '.example.com')", "n % 4 <> 0"),
    ("idn-hostname", "concat(CASE WHEN n % 4 = 0 THEN '-' ELSE '' END, 'bücher', n % 9, '.example')", "n % 4 <> 0"),
    ("uri", "concat(CASE WHEN n % 3 = 0 THEN '' ELSE 'http:' END, '//h', n % 5, '/p', CASE WHEN n % 5 = 0 THEN ' ' ELSE '' END, '?q=', n)", "n % 3 <> 0 AND n % 5 <> 0"),
    ("uri-reference", "concat('//h', n % 5, '/p', CASE WHEN n % 5 = 0 THEN '^' ELSE '' END, '#f', n)", "n % 5 <> 0"),
    ("iri", "concat(CASE WHEN n % 3 = 0 THEN '' ELSE 'http:' END, '//ü', n % 5, '/p')", "n % 3 <> 0"),
    ("iri-reference", "concat('//ü', n % 5, '/p', CASE WHEN n % 3 = 0 THEN '<' ELSE '' END)", "n % 3 <> 0"),
    ("ipv4", "concat(n % 300, '.', n % 10, '.0.', CASE WHEN n % 7 = 0 THEN '01' ELSE '1' END)", "n % 300 <= 255 AND n % 7 <> 0"),
    ("ipv6", "concat('2001:db8:', n % 9999, CASE WHEN n % 4 = 0 THEN ':' ELSE '::' END, '1')", "n % 4 <> 0"),
    ("uuid", "concat('2eb8aa08-aa98-11ea-b4aa-73b441d1', CASE WHEN n % 3 = 0 THEN 'zz' ELSE 'ab' END, lpad(CAST(n % 100 AS STRING), 2, '0'))", "n % 3 <> 0"),
    ("date", "concat('20', lpad(CAST(n % 40 AS STRING), 2, '0'), '-02-', 28 + n % 3)", "n % 3 = 0 OR (n % 3 = 1 AND n % 40 % 4 = 0)"),
    ("time", "concat(lpad(CAST(n % 30 AS STRING), 2, '0'), ':15:', CASE WHEN n % 5 = 0 THEN '60' ELSE '59' END, CASE WHEN n % 2 = 0 THEN 'Z' ELSE '+01:00' END)", "n % 30 < 24 AND n % 5 <> 0"),
    ("date-time", "concat('2024-0', 1 + n % 9, '-30T', lpad(CAST(n % 30 AS STRING), 2, '0'), ':00:00', CASE WHEN n % 7 = 0 THEN '' ELSE 'Z' END)", "n % 9 <> 1 AND n % 30 < 24 AND n % 7 <> 0"),
    ("duration", "concat('P', n % 50, CASE WHEN n % 3 = 0 THEN 'DT' WHEN n % 3 = 1 THEN 'W' ELSE 'DT3H' END)", "n % 3 <> 0"),
    ("json-pointer", "concat('/a/', n, CASE WHEN n % 3 = 0 THEN '~2' ELSE '~1' END)", "n % 3 <> 0"),
    ("relative-json-pointer", "concat(CASE WHEN n % 3 = 0 THEN '0' ELSE '' END, 1 + n % 9, '/a')", "n % 3 <> 0"),
    ("regex", "concat('^a(', n % 9, CASE WHEN n % 3 = 0 THEN '' ELSE ')' END, '$')", "n % 3 <> 0"),
    ("uri-template", "concat('/p/{v', n % 9, CASE WHEN n % 3 = 0 THEN '' ELSE '}' END)", "n % 3 <> 0"),
    ("unknown-format", "concat('x', n)", "true"),
]:
    _format(_fmt, _text, _condition)


# ---------------------------------------------------------------- regular expressions, pointers, names


@query("rgx_2_test", "SELECT page_id, regexp_matches(url, '/(fr|de)/\\d+') AS hit FROM pages")
def rgx_test(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "pages").select("page_id", ecma.test_column(F.col("url"), r"\/(fr|de)\/\d+").alias("hit"))


@query("rgx_3_match", "SELECT page_id, regexp_extract(url, '([a-z]+)://([^/]+)', 1) AS scheme, regexp_extract(url, '([a-z]+)://([^/]+)', 2) AS host FROM pages WHERE regexp_matches(url, '([a-z]+)://([^/]+)')")
def rgx_match(spark: SparkSession, sf: str) -> DataFrame:
    m = ecma.with_match(_table(spark, sf, "pages").select("page_id", "url"), "url", r"([a-z]+):\/\/([^\/]+)")
    return m.where("match IS NOT NULL").select("page_id", F.col("match.captures")[0]["text"].alias("scheme"), F.col("match.captures")[1]["text"].alias("host"))


@query("rgx_4_match_all", "SELECT doc_id, len(regexp_extract_all(text, '[0-9A-Za-z_]+ing'))::BIGINT AS n, coalesce(array_to_string(regexp_extract_all(text, '[0-9A-Za-z_]+ing')[1:3], ','), '') AS firsts FROM documents")
def rgx_match_all(spark: SparkSession, sf: str) -> DataFrame:
    found = ecma.all_texts_column(F.col("text"), r"\w+ing")
    return _table(spark, sf, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.array_join(F.slice(found, 1, 3), ",").alias("firsts"))


@query("ptr_get", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, CAST(NULL AS VARCHAR) AS missing FROM events")
def ptr_get(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "events").select("event_id", pointer.get_column(F.col("props"), "/k").alias("k"), pointer.get_column(F.col("props"), "/a/0").alias("missing"))


@query("ptr_render", "SELECT page_id, '/' || replace(replace(url, '~', '~0'), '/', '~1') || '/a~1b' AS pointer, url AS first FROM pages")
def ptr_render(spark: SparkSession, sf: str) -> DataFrame:
    p = pointer.render_column(F.array("url", F.lit("a/b")))
    safe = F.replace(F.replace(p, F.lit("%"), F.lit("%25")), F.lit("+"), F.lit("%2B"))
    return _table(spark, sf, "pages").select("page_id", p.alias("pointer"), pointer.parse_column(safe)[0].alias("first"))


def _words(spark: SparkSession, sf: str) -> DataFrame:
    """Different lower-case words of the conversations, punctuation off."""
    w = F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")
    return _table(spark, sf, "conversations").select(w).where("word <> ''").distinct()


@query("idn_4_labels", "SELECT page_id, regexp_split_to_array(lower(regexp_extract(url, '://([^/]+)', 1)), '\\.') AS labels FROM pages")
def idn_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "pages").select("page_id", idn.labels_column(F.regexp_extract("url", "://([^/]+)", 1)).alias("labels"))


@query("pun_2_decode", "SELECT DISTINCT word AS decoded FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS word FROM conversations) WHERE word <> ''")
def pun_decode(spark: SparkSession, sf: str) -> DataFrame:
    p = idn.with_punycode(_words(spark, sf), "word").select(F.col("punycode.value").alias("p"))
    return idn.with_punycode_decoded(p, "p").select(F.col("decoded.value").alias("decoded"))


# ---------------------------------------------------------------- events

_EID = "concat('00000000-0000-4000-8000-', lpad(CAST(event_id AS STRING), 12, '0'))"
_EID_SQL = "'00000000-0000-4000-8000-' || lpad(CAST(event_id AS VARCHAR), 12, '0')"
_TIME_SQL = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')"


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a topic table: topic event_type, offset by time."""
    e = _table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = E.envelope(e, F.col("event_type"), F.col("props"), event_id=F.expr(_EID), event_time=F.col("ts"), metadata=F.create_map(F.lit("user"), F.col("user_id").cast("string")))
    return out.withColumn("topic", F.col("event_type"))


@query("snk_3_envelope", f"SELECT {_EID_SQL} AS event_id, event_type, 1::INTEGER AS event_version, epoch_us(ts) AS event_us, '{E.SOURCE}' AS event_source, props AS payload, CAST(user_id AS VARCHAR) AS user FROM events")
def envelope_build(spark: SparkSession, sf: str) -> DataFrame:
    return _log(spark, sf).select("event_id", "event_type", "event_version", F.unix_micros("event_time").alias("event_us"), "event_source", "payload", F.col("metadata")["user"].alias("user"))


@query("snk_4_to_wire", f"SELECT {_EID_SQL} AS event_id, event_type, '1' AS event_version, {_TIME_SQL} AS event_time, '{E.SOURCE}' AS event_source, props AS payload, '{{\"user\":\"' || user_id || '\"}}' AS metadata FROM events")
def to_wire(spark: SparkSession, sf: str) -> DataFrame:
    return E.to_wire(_log(spark, sf)).select(*E.WIRE)


@query(
    "src_4_from_wire",
    f"""SELECT {_EID_SQL} AS event_id, event_id % 5 <> 0 AND event_id % 7 <> 0 AS fine, CASE WHEN event_id % 5 = 0 THEN 'missing event_version' WHEN event_id % 7 = 0 THEN 'invalid event_time' END AS error,
  CASE WHEN event_id % 7 <> 0 THEN epoch_us(ts) ELSE -1 END AS event_us, CASE WHEN event_id % 3 <> 0 THEN CAST(user_id AS VARCHAR) END AS user FROM events""",
)
def from_wire(spark: SparkSession, sf: str) -> DataFrame:
    """Damaged fields decode to error rows; bad metadata is empty."""
    n = F.substring("event_id", -12, 12).cast("long")
    w = E.to_wire(_log(spark, sf)).withColumns({"event_version": F.when(n % 5 != 0, F.col("event_version")), "event_time": F.when(n % 7 == 0, F.lit("yesterday")).otherwise(F.col("event_time")), "metadata": F.when(n % 3 == 0, F.lit("{")).otherwise(F.col("metadata"))})
    d = E.from_wire(w)
    return d.select("event_id", F.col("error").isNull().alias("fine"), "error", F.coalesce(F.unix_micros("event_time"), F.lit(-1)).alias("event_us"), F.col("metadata")["user"].alias("user"))


@query("src_2_typed", "SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k, 0::BIGINT AS bad FROM events GROUP BY event_type")
def typed(spark: SparkSession, sf: str) -> DataFrame:
    t = E.typed(_log(spark, sf), "k bigint")
    return t.groupBy("event_type").agg(F.sum("data.k").alias("k"), F.count("decode_error").alias("bad"))


@query("src_6_stream_info", "SELECT event_type AS topic, count(*) AS length, 0::BIGINT AS first_offset, count(*) - 1 AS last_offset, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, ['g0', 'g1'] AS groups FROM events GROUP BY event_type")
def stream_info(spark: SparkSession, sf: str) -> DataFrame:
    log = E.with_offsets(_log(spark, sf))
    groups = log.select("topic", F.concat(F.lit("g"), F.pmod("offset", F.lit(2))).alias("group_id")).distinct()
    info = E.stream_info(log, groups)
    return info.select("topic", "length", "first_offset", "last_offset", F.unix_micros("first_time").alias("first_us"), F.unix_micros("last_time").alias("last_us"), "groups")


_CUT = dt.datetime(2024, 1, 1, 6)


@query("flt_6_replay_range", f"SELECT {_EID_SQL} AS event_id, event_type AS topic FROM events WHERE event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-01 00:10:00' AND ts < TIMESTAMP '2024-01-01 06:00:00'")
def replay_range(spark: SparkSession, sf: str) -> DataFrame:
    return E.replay(_log(spark, sf), E.ReplayConfig(("click", "view"), dt.datetime(2024, 1, 1, 0, 10), _CUT)).select("event_id", "topic")


@query("flt_5_replay_filtered", f"SELECT {_EID_SQL} AS event_id, event_type AS topic FROM events WHERE event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-01' AND user_id = 8 AND event_type = 'view'")
def replay_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return E.replay(_log(spark, sf), E.ReplayConfig(("click", "view"), dt.datetime(2024, 1, 1), None, (("user", "8"), ("event_type", "view")), 4)).select("event_id", "topic")


@query("snk_10_offset_latest", "SELECT group_id, topic, arg_max(position, seq) AS position FROM (SELECT 'g' || (user_id % 10) AS group_id, event_type AS topic, event_id AS position, event_id AS seq FROM events) GROUP BY group_id, topic")
def offset_latest(spark: SparkSession, sf: str) -> DataFrame:
    c = _table(spark, sf, "events").select(F.concat(F.lit("g"), F.col("user_id") % 10).alias("group_id"), F.col("event_type").alias("topic"), F.col("event_id").alias("position"), F.col("event_id").alias("seq"), F.lit(_CUT).alias("committed_at"))
    return E.latest_offsets(c)


@query("snk_10_offset_reset", "SELECT event_type AS topic, count(*) FILTER (ts < TIMESTAMP '2024-01-01 06:00:00') AS position FROM events GROUP BY event_type")
def offset_reset(spark: SparkSession, sf: str) -> DataFrame:
    return E.start_position(E.with_offsets(_log(spark, sf)), _CUT)


@query("agg_6_balances", "SELECT user_id AS account, CAST(sum(CAST(CASE WHEN event_type = 'error' THEN -value ELSE value END AS DECIMAL(28, 6))) * 1000000 AS BIGINT) AS micros, count(*) AS n FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id")
def balances(spark: SparkSession, sf: str) -> DataFrame:
    e = _table(spark, sf, "events").where(F.col("event_type").isin("purchase", "error"))
    return E.balances(e, F.col("user_id"), F.when(F.col("event_type") == "error", -F.col("value")).otherwise(F.col("value"))).select("account", (F.col("balance") * 1000000).cast("bigint").alias("micros"), "n")


@query("str_4_dedup", f"SELECT {_EID_SQL} AS event_id, event_type AS topic FROM events")
def dedup(spark: SparkSession, sf: str) -> DataFrame:
    log = _log(spark, sf)
    return E.deduplicated(log.unionByName(log)).select("event_id", "topic")


@query("str_5_schema_version", "SELECT event_type AS topic, count(*) AS n, count(CASE WHEN event_type IN ('click', 'view') THEN 1 END) AS known FROM events GROUP BY event_type")
def schema_version(spark: SparkSession, sf: str) -> DataFrame:
    versions = prepare(spark).createDataFrame([("click", 1, 10), ("view", 1, 11), ("error", 2, 12)], "subject string, version bigint, schema_id bigint")
    return E.of_type(_log(spark, sf), versions).groupBy("topic").agg(F.count("*").alias("n"), F.count("schema_id").alias("known"))


# ---------------------------------------------------------------- outbox: orders as rows

_OUT_SQL = """WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS event_id, o_orderpriority AS topic, o_orderdate AS created_at, o_orderstatus = 'F' AS processed, CAST(o_orderkey % 5 AS INTEGER) AS retries, CASE WHEN o_orderkey % 2 = 0 THEN 'failed' END AS error FROM orders) """


def _outbox(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    created = F.col("o_orderdate").cast("timestamp")
    return _table(spark, sf, "orders").select(k.cast("string").alias("event_id"), F.col("o_orderpriority").alias("topic"), F.lit(None).cast("string").alias("key"), F.lit(b"").alias("payload"), F.lit("{}").alias("metadata"), created.alias("created_at"), F.when(F.col("o_orderstatus") == "F", created).alias("processed_at"), (k % 5).cast("int").alias("retries"), F.when(k % 2 == 0, F.lit("failed")).alias("error"))


@query("src_5_outbox_pending", _OUT_SQL + "SELECT event_id, topic, retries FROM o WHERE NOT processed AND (retries < 3 OR error IS NULL) ORDER BY created_at, event_id LIMIT 100")
def outbox_pending(spark: SparkSession, sf: str) -> DataFrame:
    return O.pending(_outbox(spark, sf), 100).select("event_id", "topic", "retries")


@query(
    "snk_6_outbox_after_batch",
    _OUT_SQL + ", b AS (SELECT event_id FROM o WHERE NOT processed AND (retries < 3 OR error IS NULL) ORDER BY created_at, event_id LIMIT 100) SELECT count(*) AS n, count(*) FILTER (processed OR (event_id IN (SELECT event_id FROM b) AND CAST(event_id AS BIGINT) % 10 <> 0)) AS processed, sum(retries + CASE WHEN event_id IN (SELECT event_id FROM b) AND CAST(event_id AS BIGINT) % 10 = 0 THEN 1 ELSE 0 END)::BIGINT AS retries FROM o",
)
def outbox_after_batch(spark: SparkSession, sf: str) -> DataFrame:
    """A batch of which every tenth id fails."""
    o = _outbox(spark, sf)
    batch = O.pending(o, 100).select("event_id")
    bad = F.col("event_id").cast("long") % 10 == 0
    after = O.settle(o, batch.where(~bad), batch.where(bad).withColumn("error", F.lit("refused")), _CUT)
    return after.agg(F.count("*").alias("n"), F.count("processed_at").alias("processed"), F.sum("retries").alias("retries"))


@query("snk_5_outbox_rows", f"SELECT {_EID_SQL} AS event_id, event_type AS topic, CAST(user_id AS VARCHAR) AS key, props AS payload, 0::INTEGER AS retries FROM events")
def outbox_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Envelopes written to an outbox and decoded again."""
    rows = O.new_rows(_log(spark, sf).withColumn("key", F.col("metadata")["user"]), _CUT)
    return O.decode(rows).join(rows.select(F.col("event_id").alias("row_id"), "retries"), "row_id").select("event_id", "topic", "key", "payload", "retries")


# ---------------------------------------------------------------- registry: parts as versions

_REG_SQL = """WITH types AS (SELECT p_type, row_number() OVER (ORDER BY p_type) AS id FROM (SELECT DISTINCT p_type FROM part)),
schemas AS (SELECT id, '"' || p_type || '"' AS schema FROM types),
v AS (SELECT p_brand AS subject, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS version, t.id AS schema_id, p_partkey % 4 = 0 AS deleted FROM part JOIN types t USING (p_type)) """


def _registry(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    part = _table(spark, sf, "part")
    kinds = part.select("p_type").distinct().withColumn("id", F.row_number().over(Window.orderBy("p_type")).cast("bigint"))  # a dictionary: few rows
    schemas = kinds.select("id", F.concat(F.lit('"'), "p_type", F.lit('"')).alias("schema"), F.lit("AVRO").alias("schema_type"), F.sha2("p_type", 256).alias("hash"))
    v = part.join(kinds, "p_type").select(F.col("p_brand").alias("subject"), F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).cast("bigint").alias("version"), F.col("id").alias("schema_id"), (F.col("p_partkey") % 4 == 0).alias("deleted"))
    return schemas, v


def _reg(name: str, sql: str, f: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf: f(*_registry(spark, sf))
    SQL[name] = _REG_SQL + sql


_reg("reg_1_schema_by_id", "SELECT id, schema FROM schemas WHERE id = 2", lambda s, v: s.where("id = 2").select("id", "schema"))
_reg("reg_3_schema_versions", "SELECT subject, version FROM v WHERE schema_id = 1 AND NOT deleted", lambda s, v: R.schema_versions(v, 1))
_reg("reg_4_subjects", "SELECT DISTINCT subject FROM v WHERE NOT deleted", lambda s, v: R.subjects(v))
_reg("reg_5_subject_versions", "SELECT version FROM v WHERE subject = 'Brand#2' AND NOT deleted", lambda s, v: R.subject_versions(v, "Brand#2"))
_reg("reg_6_delete_subject", "SELECT subject, count(*) AS n, count(*) FILTER (deleted OR subject = 'Brand#2') AS n_deleted FROM v GROUP BY subject", lambda s, v: R.soft_delete(v, "Brand#2").groupBy("subject").agg(F.count("*").alias("n"), F.sum(F.col("deleted").cast("long")).alias("n_deleted")))
_reg("reg_8_latest", "SELECT subject, max(version) AS version, arg_max(schema_id, version) AS schema_id FROM v WHERE NOT deleted GROUP BY subject", lambda s, v: R.latest(v))
_reg("reg_9_schema_text", "SELECT subject, version, schema FROM v JOIN schemas ON schema_id = id WHERE NOT deleted", lambda s, v: R.with_schemas(R.live(v), s).select("subject", "version", "schema"))
_reg("reg_11_delete_version", "SELECT subject, version FROM v WHERE NOT deleted AND NOT (subject = 'Brand#2' AND version = 3)", lambda s, v: R.live(R.soft_delete(v, "Brand#2", 3)).select("subject", "version"))
_reg("reg_12_referenced_by", "SELECT subject, version, schema_id FROM v WHERE NOT deleted AND schema_id IN (SELECT schema_id FROM v WHERE subject = 'Brand#2' AND version = 2 AND NOT deleted)", lambda s, v: R.referenced_by(v, s, "Brand#2", 2))
_reg("joi_4_next_version", "SELECT subject, max(version) + 1 AS next_version FROM v GROUP BY subject", lambda s, v: R.next_versions(v))


@query(
    "reg_10_register",
    _REG_SQL + ", r AS (SELECT 'S' || (o_orderkey % 50) AS subject, 'shape' || (o_orderkey % 9) AS schema, o_orderkey AS seq FROM orders), f AS (SELECT schema, row_number() OVER (ORDER BY min(seq)) + (SELECT max(id) FROM schemas) AS id FROM r GROUP BY schema) SELECT subject, row_number() OVER (PARTITION BY subject ORDER BY seq) AS version, f.id AS schema_id FROM r JOIN f USING (schema)",
)
def reg_register(spark: SparkSession, sf: str) -> DataFrame:
    schemas, versions = _registry(spark, sf)
    k = F.col("o_orderkey")
    requests = _table(spark, sf, "orders").select(F.concat(F.lit("S"), k % 50).alias("subject"), F.concat(F.lit("shape"), k % 9).alias("schema"), F.lit("AVRO").alias("schema_type"), k.alias("seq"))
    return R.register_bulk(requests, schemas, versions, _CUT)[1].select("subject", "version", "schema_id")


@query(
    "reg_16_effective_config",
    "WITH s AS (SELECT DISTINCT p_brand AS subject FROM part) SELECT subject, CASE WHEN subject IN ('Brand#1', 'Brand#2') THEN 'NONE' ELSE 'BACKWARD' END AS compatibility FROM s",
)
def effective_config(spark: SparkSession, sf: str) -> DataFrame:
    rows = [("Brand#1", "NONE", 1), ("Brand#2", "FULL", 1), ("Brand#2", "NONE", 2), (None, "FULL", 1), (None, "BACKWARD", 3)]
    configs = prepare(spark).createDataFrame([(s, c, dt.datetime(2024, 1, d)) for s, c, d in rows], R.CONFIGS)
    return R.effective_config(_table(spark, sf, "part").select(F.col("p_brand").alias("subject")).distinct(), configs)


@query("reg_2_schema_types", "SELECT unnest(['AVRO', 'JSON', 'PROTOBUF']) AS schema_type")
def schema_types_list(spark: SparkSession, sf: str) -> DataFrame:
    return prepare(spark).createDataFrame([(t,) for t in R.TYPES], "schema_type string")


def _record(*fields: object, name: str = "R") -> str:
    return json.dumps({"type": "record", "name": name, "fields": list(fields)})


_ID, _NAME = {"name": "id", "type": "int"}, {"name": "name", "type": "string"}
AVRO_PAIRS = [
    ("same", '"int"', '"int"', True), ("promotion", '"int"', '"long"', True), ("narrowing", '"long"', '"int"', False), ("mismatch", '"int"', '"string"', False), ("string_bytes", '"string"', '"bytes"', True),
    ("added_default", _record(_ID), _record(_ID, _NAME | {"default": ""}), True), ("added_bare", _record(_ID), _record(_ID, _NAME), False), ("removed", _record(_ID, _NAME), _record(_ID), False),
    ("union_wider", '["int"]', '["int","string"]', True), ("union_narrower", '["int","string"]', '["int"]', False), ("array", '{"type":"array","items":"int"}', '{"type":"array","items":"long"}', True),
    ("enum_more", '{"type":"enum","name":"E","symbols":["A"]}', '{"type":"enum","name":"E","symbols":["A","B"]}', True), ("enum_fewer", '{"type":"enum","name":"E","symbols":["A","B"]}', '{"type":"enum","name":"E","symbols":["A"]}', False),
    ("fixed", '{"type":"fixed","name":"F","size":4}', '{"type":"fixed","name":"F","size":8}', False), ("renamed", _record(_ID), _record(_ID, name="S"), False),
]


@query("reg_13_avro_matrix", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {str(ok).lower()})" for n, _, _, ok in AVRO_PAIRS) + ") t(name, compatible)")
def avro_matrix(spark: SparkSession, sf: str) -> DataFrame:
    pairs = prepare(spark).createDataFrame([(n, a, b) for n, a, b, _ in AVRO_PAIRS], "name string, old string, new string")
    return R.compatibility_matrix(pairs, "BACKWARD").select("name", "compatible")


@query("avr_2_promotions", "SELECT * FROM (VALUES ('int', 'long'), ('int', 'float'), ('int', 'double'), ('long', 'float'), ('long', 'double'), ('float', 'double'), ('string', 'bytes'), ('bytes', 'string')) t(writer, reader)")
def avro_promotions(spark: SparkSession, sf: str) -> DataFrame:
    return prepare(spark).createDataFrame([(w, r) for w in sorted(avro.PRIMITIVES) for r in sorted(avro.PRIMITIVES) if avro.can_promote(r, w)], "writer string, reader string")


# ---------------------------------------------------------------- types and documents


@query("gen_2_parsed_by_schema", "SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY event_type")
def parsed_by_schema(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads parsed by the type that their contract implies."""
    return schema_types.parsed(_table(spark, sf, "events"), "props", EVENT_SCHEMA).groupBy("event_type").agg(F.sum("data.k").alias("k"))




# ---------------------------------------------------------------- relational forms

_reg("flt_1_projection", "SELECT subject, version FROM v", lambda s, v: v.select("subject", "version"))
_reg("flt_2_equality", "SELECT subject, version FROM v WHERE subject = 'Brand#2' AND version = 3", lambda s, v: v.where((F.col("subject") == "Brand#2") & (F.col("version") == 3)).select("subject", "version"))
_reg("flt_3_boolean", "SELECT subject, version FROM v WHERE NOT deleted AND (version < 3 OR subject = 'Brand#1')", lambda s, v: v.where(~F.col("deleted") & ((F.col("version") < 3) | (F.col("subject") == "Brand#1"))).select("subject", "version"))
_reg("flt_4_casts", "SELECT CAST(id AS VARCHAR) AS id, CAST(id AS INTEGER) AS small, id > 0 AS positive FROM schemas", lambda s, v: s.select(F.col("id").cast("string").alias("id"), F.col("id").cast("int").alias("small"), (F.col("id") > 0).alias("positive")))
_reg("joi_1_inner", "SELECT subject, version, schema FROM v JOIN schemas ON schema_id = id", lambda s, v: R.with_schemas(v, s).select("subject", "version", "schema"))
_reg("joi_2_semi", "SELECT subject, version FROM v WHERE schema_id IN (SELECT schema_id FROM v WHERE subject = 'Brand#1')", lambda s, v: v.join(v.where("subject = 'Brand#1'").select("schema_id"), "schema_id", "left_semi").select("subject", "version"))
_reg("joi_5_latest_schema", "SELECT subject, arg_max(schema, version) AS schema FROM v JOIN schemas ON schema_id = id WHERE NOT deleted GROUP BY subject", lambda s, v: R.with_schemas(R.latest(v), s).select("subject", "schema"))
_reg("agg_1_distinct", "SELECT DISTINCT subject FROM v WHERE NOT deleted", lambda s, v: R.subjects(v))
_reg("agg_2_max", "SELECT max(version) AS version FROM v WHERE subject = 'Brand#2' AND NOT deleted", lambda s, v: R.live(v).where("subject = 'Brand#2'").agg(F.max("version").alias("version")))
_reg("srt_2_order_by", "SELECT subject, version FROM v WHERE NOT deleted ORDER BY subject, version", lambda s, v: R.live(v).select("subject", "version").orderBy("subject", "version"))


@query("joi_3_cte", _REG_SQL + ", r AS (SELECT schema_id FROM v WHERE subject = 'Brand#2' AND version = 2) SELECT subject, version FROM v WHERE schema_id IN (SELECT schema_id FROM r) AND NOT deleted")
def joi_cte(spark: SparkSession, sf: str) -> DataFrame:
    """The same as SQL text on Spark: a common table expression and a subquery."""
    _, v = _registry(spark, sf)
    return spark.sql("WITH r AS (SELECT schema_id FROM {v} WHERE subject = 'Brand#2' AND version = 2) SELECT subject, version FROM {v} WHERE schema_id IN (SELECT schema_id FROM r) AND NOT deleted", v=v)


@query("flt_7_topics", "SELECT event_type AS topic, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type")
def flt_topics(spark: SparkSession, sf: str) -> DataFrame:
    return _log(spark, sf).where(F.col("topic").isin("click", "view")).groupBy("topic").agg(F.count("*").alias("n"))


@query("agg_7_combined_results", f"{_BASE} SELECT k, k <= 500 AND s = 'O' AS valid, (CASE WHEN k > 500 THEN 1 ELSE 0 END + CASE WHEN s <> 'O' THEN 1 ELSE 0 END)::INTEGER AS n_errors FROM b")
def combined_results(spark: SparkSession, sf: str) -> DataFrame:
    from streamcontract.plans.validation import combine

    v = validate_full(instances(spark, sf), "doc", _prop("k", {"maximum": 500}), "a")
    v = validate_full(v, "doc", _prop("s", {"const": "O"}), "b")
    v = v.withColumn("c", combine(F.col("a"), F.col("b")))
    return v.select("k", "c.valid", F.size("c.errors").alias("n_errors"))


@query("set_1_missing_properties", f"{_BASE} SELECT k, CASE WHEN {_N} THEN 0 ELSE 1 END + CASE WHEN {_Z} THEN 0 ELSE 1 END AS n_missing FROM b")
def set_missing(spark: SparkSession, sf: str) -> DataFrame:
    keys = F.json_object_keys("doc")
    return instances(spark, sf).select("k", F.size(F.array_except(F.array(F.lit("n"), F.lit("z"), F.lit("k")), keys)).alias("n_missing"))


@query("set_2_union_of_properties", f"{_BASE} SELECT k, 6 + CASE WHEN {_N} THEN 1 ELSE 0 END + CASE WHEN {_Z} THEN 1 ELSE 0 END + 1 AS n_names FROM b")
def set_union(spark: SparkSession, sf: str) -> DataFrame:
    return instances(spark, sf).select("k", F.size(F.array_union(F.json_object_keys("doc"), F.array(F.lit("k"), F.lit("extra")))).alias("n_names"))


# ---------------------------------------------------------------- stored topics and streams


def _scratch(spark: SparkSession) -> str:
    """A new folder among those that the cluster shares; a local session gets a temporary one where none is named."""
    import tempfile
    import uuid

    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the driver and the executors share")
        return tempfile.mkdtemp(prefix="topics-")
    path = f"{named}/topics-{uuid.uuid4().hex}"
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def _published(spark: SparkSession, sf: str) -> object:
    from streamcontract.sources.topics import TopicStore

    store = TopicStore(prepare(spark), _scratch(spark))
    store.publish(_log(spark, sf).withColumn("key", F.col("metadata")["user"]))
    return store


@query("snk_1_publish", "SELECT event_type AS topic, count(*) AS n, 0::BIGINT AS first_offset, count(*) - 1 AS last_offset, count(DISTINCT user_id) AS keys FROM events GROUP BY event_type")
def publish(spark: SparkSession, sf: str) -> DataFrame:
    """Events appended to a topic store; publishing them again adds nothing."""
    store = _published(spark, sf)
    store.publish(_log(spark, sf))
    return store.read().groupBy("topic").agg(F.count("*").alias("n"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"), F.countDistinct("key").alias("keys"))


@query("src_1_subscribe", "SELECT event_type AS topic, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type")
def subscribe(spark: SparkSession, sf: str) -> DataFrame:
    """A consumer group over two topics from the beginning."""
    from streamcontract.streaming.consumers import Consumer

    store = _published(spark, sf)
    out = f"{store.path}/seen"
    Consumer(store, E.StreamConfig("g", ("click", "view"), start="0"), lambda df, n: df.select("topic", "event_id").write.mode("overwrite").parquet(f"{out}/batch={n}")).run_once()
    return spark.read.parquet(out).groupBy("topic").agg(F.count("*").alias("n"))


@query("snk_11_dead_letter", "SELECT event_type AS topic, count(*) AS n FROM events WHERE event_type IN ('click', 'view') AND user_id % 10 = 0 GROUP BY event_type")
def dead_letter(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that the handler refuses are set aside."""
    from streamcontract.streaming.consumers import Consumer

    store = _published(spark, sf)
    refuse = lambda df, n: df.where(F.col("metadata")["user"].cast("int") % 10 == 0).withColumn("error", F.lit("refused"))
    Consumer(store, E.StreamConfig("g", ("click", "view"), start="0"), refuse).run_once()
    return spark.read.parquet(f"{store.path}/dead_letter/g").groupBy("topic").agg(F.count("*").alias("n"))


@query("str_7_stream_balances", "SELECT CAST(user_id AS VARCHAR) AS account, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS balance, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def stream_balances(spark: SparkSession, sf: str) -> DataFrame:
    """Running sums as a stateful stream, over what is there."""
    from streamcontract.streaming.consumers import balance_stream, read_stream

    store = _published(spark, sf)
    stream = read_stream(store, E.StreamConfig("g", ("purchase",), start="0"))
    name = f"balances_{abs(hash(store.path))}"
    q = balance_stream(stream, F.col("key"), F.get_json_object("payload", "$.k")).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{store.path}/balances").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select("account", F.col("balance").cast("bigint").alias("balance"), "n")


@query("snk_9_outbox_run", "SELECT event_type AS topic, count(*) AS n FROM events GROUP BY event_type")
def outbox_run(spark: SparkSession, sf: str) -> DataFrame:
    """An outbox with a backlog of many batches, run until it is empty."""
    from streamcontract.sources.topics import TopicStore

    folder = _scratch(spark)
    topics = TopicStore(prepare(spark), f"{folder}/topics")
    box = O.Outbox(spark, f"{folder}/outbox", topics, O.OutboxConfig(batch_size=50_000))
    box.write(_log(spark, sf).withColumn("key", F.lit(None).cast("string")))
    box.run()
    return topics.read().groupBy("topic").agg(F.count("*").alias("n"))


from streamcontract import more_queries  # noqa: E402, F401  adds its queries
