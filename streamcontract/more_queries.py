"""Queries of the operators that work on schemas, names, services and resources: one for each, driven by table rows, with its SQL."""

from __future__ import annotations

import datetime as dt
import json
import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamcontract import queries as Q
from streamcontract.functions import ecma, idn
from streamcontract.operators import avro, events as E, outbox as O, registry as R
from streamcontract.plans import dialects, layers as L, openapi, types as schema_types
from streamcontract.plans.adjacent import Adjacent
from streamcontract.plans.jsonschema import Config, Documents, Evaluator, render
from streamcontract.plans.validation import validate
from streamcontract.queries import QUERIES, SQL, query
from streamcontract.runtime import prepare
from streamcontract.sources import loaders, metaschemas
from streamcontract.sources.tables import Table
from streamcontract.sources.topics import TopicStore
from streamcontract.streaming.consumers import Consumer

NOW = dt.datetime(2024, 1, 1)


def mapped(df: DataFrame, f: Callable[..., tuple], ddl: str) -> DataFrame:
    """f of each row's values, in Arrow batches."""
    prepare(df.sparkSession)
    names = [x.strip().split(" ")[0] for x in ddl.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([f(*r) for r in pdf.itertuples(index=False, name=None)], columns=names)

    return df.mapInPandas(run, ddl)


def per_key(name: str, f: Callable[[int], tuple], ddl: str, sql: str) -> None:
    """A query over the order keys: f(key) -> the columns after k; sql: their expressions over k."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        keys = Q._table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
        return mapped(keys, lambda k: (k, *f(int(k))), f"k long, {ddl}")

    QUERIES[name] = run
    SQL[name] = f"SELECT k, {sql} FROM (SELECT o_orderkey AS k FROM orders)"


def nations(spark: SparkSession, sf: str) -> list[tuple[int, str, int]]:
    """The 25 rows of a dimension that does not grow."""
    return [tuple(r) for r in Q._table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()]


def driver_query(name: str, f: Callable[[SparkSession, str, list], list], ddl: str, sql: str) -> None:
    """A query whose rows come from objects of the driver, one or a few for each nation."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return prepare(spark).createDataFrame(f(spark, sf, nations(spark, sf)), ddl)

    QUERIES[name] = run
    SQL[name] = sql


# ---------------------------------------------------------------- schemas and dialects

_PICK = [*dialects.URIS, None, "https://example.com/other"]


def _detected(k: int) -> tuple:
    uri = _PICK[k % 7]
    schema = {} if uri is None else {"$schema": uri + "#" * (k % 2)}
    try:
        return (dialects.draft_of(schema),)
    except dialects.SchemaError:
        return ("unknown",)


per_key("kw_52_schema_detection", _detected, "draft string", "CASE k % 7 WHEN 0 THEN 'draft-04' WHEN 1 THEN 'draft-06' WHEN 2 THEN 'draft-07' WHEN 3 THEN '2019-09' WHEN 6 THEN 'unknown' ELSE '2020-12' END AS draft")
per_key("snk_13_render", lambda k: (render({"title": f"t{k % 50}", "$id": f"urn:{k}", "type": "object"}), render({"title": "é", "type": "object", "$id": f"urn:{k}"}, ("$id", "title"))), "whole string, some string", """'{"$id": "urn:' || k || '", "title": "t' || (k % 50) || '", "type": "object"}' AS whole, '{"$id": "urn:' || k || '", "title": "é"}' AS some""")
per_key("eng_10_metaschema", lambda k: (not metaschemas.violations({"maxLength": k % 11 - 5, "type": "integer" if k % 3 else "whole"}, dialects.DRAFTS[k % 5]),), "fine boolean", "k % 11 >= 5 AND k % 3 <> 0 AS fine")
per_key("src_10_metaschema_lookup", lambda k: ((found := metaschemas.lookup(_PICK[k % 7] or "urn:x") if k % 2 else metaschemas.lookup(f"{_PICK[k % 7] or 'urn:x'}#frag")) is not None, None if found is None else dialects.draft_of(found)), "known boolean, draft string", "k % 7 < 5 AS known, CASE k % 7 WHEN 0 THEN 'draft-04' WHEN 1 THEN 'draft-06' WHEN 2 THEN 'draft-07' WHEN 3 THEN '2019-09' WHEN 4 THEN '2020-12' END AS draft")


def _unknown(k: int) -> tuple:
    mode = ("ignore", "collect", "error")[k % 3]
    d = dialects.Dialect("urn:d", unknown=mode)
    schema = {"type": "object", **({f"x-{k}": 1} if k % 2 else {})}
    try:
        return (mode, ",".join(dialects.registry.unknown_keywords(schema, d)))
    except dialects.SchemaError:
        return (mode, "refused")


per_key("eng_2_unknown_keywords", _unknown, "mode string, found string", "CASE k % 3 WHEN 0 THEN 'ignore' WHEN 1 THEN 'collect' ELSE 'error' END AS mode, CASE WHEN k % 2 = 0 OR k % 3 = 0 THEN '' WHEN k % 3 = 1 THEN 'x-' || k ELSE 'refused' END AS found")

_RANGE = Adjacent({"x-low": lambda v, need: v, "x-high": lambda v, need: lambda x: None if need("x-low") <= x <= v else "out of range", "x-a": lambda v, need: need("x-b"), "x-b": lambda v, need: need("x-a")})


def _adjacent(k: int) -> tuple:
    schema = {"x-high": 60, "x-low": 40} if k % 3 else {"x-a": 1, "x-b": 1}
    try:
        return ("; ".join(_RANGE.errors(schema, k % 100)),)
    except dialects.SchemaError as e:
        return (str(e),)


per_key("eng_6_adjacent_keywords", _adjacent, "errors string", "CASE WHEN k % 3 = 0 THEN 'keywords need each other: x-a -> x-b -> x-a' WHEN k % 100 BETWEEN 40 AND 60 THEN '' ELSE 'out of range' END AS errors")


def _closure(k: int) -> tuple:
    n = k % 6 + 1
    docs = {f"urn:d{i}": {"$id": f"urn:d{i}", "allOf": [{"$ref": f"urn:d{(i + 1) % n}"}], "minimum": i} for i in range(n)}
    asked: list[str] = []
    d = Documents(lambda uri: asked.append(uri) or docs[uri])
    d.add(root := {"$ref": "urn:d0"}, "urn:root")
    d.close(root)
    return len(asked), len(set(asked))


per_key("eng_7_external_references", _closure, "loads int, documents int", "(k % 6 + 1)::INTEGER AS loads, (k % 6 + 1)::INTEGER AS documents")


def _dialect_problems(k: int) -> tuple:
    reg = dialects.VocabularyRegistry()
    own = dialects.Vocabulary("urn:own", frozenset({"maximum" if k % 2 else "x-mine"}))
    d = reg.compose(reg.dialects[dialects.URI_OF["2020-12"]], "urn:d", own, draft="2020-12" if k % 3 else "1999")
    problems = reg.validate_dialect(d)
    return len(d.vocabularies), len(problems)


per_key("eng_12_dialects", _dialect_problems, "vocabularies int, problems int", f"{len(dialects.STANDARD['2020-12']) + 1}::INTEGER AS vocabularies, ((k % 2 = 1)::INTEGER + (k % 3 = 0)::INTEGER)::INTEGER AS problems")


def _vocabularies(spark: SparkSession, sf: str, rows: list) -> list:
    """Each nation's vocabulary has a word of its own and its region's; every fifth one is taken out again."""
    reg = dialects.VocabularyRegistry()
    for n, name, region in rows:
        reg.register(dialects.Vocabulary(f"urn:{name}", frozenset({f"x-{name}", f"x-region-{region}"})))
        if n % 5 == 4:
            reg.unregister(f"urn:{name}")
    return [(name, len(reg.lookup(f"x-{name}")), len(reg.lookup(f"x-region-{region}"))) for _, name, region in rows]


driver_query("eng_11_vocabularies", _vocabularies, "name string, own int, shared int", "SELECT n_name AS name, (n_nationkey % 5 <> 4)::INTEGER AS own, (SELECT count(*) FROM nation m WHERE m.n_regionkey = nation.n_regionkey AND m.n_nationkey % 5 <> 4)::INTEGER AS shared FROM nation")


def _conflicts(spark: SparkSession, sf: str, rows: list) -> list:
    reg = dialects.VocabularyRegistry()
    for _, name, region in rows:
        reg.register(dialects.Vocabulary(f"urn:{name}", frozenset({f"x-{name}", f"x-region-{region}"})))
    return [(k, len(us)) for k, us in reg.conflicts([f"urn:{name}" for _, name, _ in rows]).items()]


driver_query("agg_8_keyword_conflicts", _conflicts, "keyword string, n int", "SELECT 'x-region-' || n_regionkey AS keyword, count(*)::INTEGER AS n FROM nation GROUP BY n_regionkey HAVING count(*) > 1")


def _duplicates(spark: SparkSession, sf: str, rows: list) -> list:
    reg, refused = dialects.VocabularyRegistry(), {}
    for _, _, region in rows:
        refused.setdefault(region, 0)
        try:
            reg.register_dialect(dialects.Dialect(f"urn:{region}"))
        except dialects.SchemaError:
            refused[region] += 1
    return list(refused.items())


driver_query("agg_9_duplicate_dialects", _duplicates, "region int, refused int", "SELECT n_regionkey AS region, (count(*) - 1)::INTEGER AS refused FROM nation GROUP BY n_regionkey")


@query("eng_15_extended_keywords", f"{Q._BASE} SELECT k, k % 2 = 0 AND t <= 100000 AS valid FROM b")
def extended(spark: SparkSession, sf: str) -> DataFrame:
    """A keyword of the caller's own beside standard ones; a dialect that refuses unknown keywords accepts it once it is registered."""
    dialects.keyword("x-even")(lambda value, x: "odd" if value and isinstance(x, int) and x % 2 else None)
    try:
        schema = {"properties": {"k": {"x-even": True}, "t": {"maximum": 100000}}}
        dialects.registry.unknown_keywords(schema["properties"]["k"], dialects.Dialect("urn:d", unknown="error"))
        return validate(Q.instances(spark, sf), "doc", schema).select("k", "valid")
    finally:
        dialects.registry.keywords.pop("x-even")


@query("udf_3_reference_loader", f"{Q._BASE} SELECT k, k % 2 = 0 AND s = 'O' AS valid FROM b")
def reference_loader(spark: SparkSession, sf: str) -> DataFrame:
    docs = {"https://example.com/k": {"multipleOf": 2}, "https://example.com/s": {"$ref": "more#/$defs/o"}, "https://example.com/more": {"$defs": {"o": {"const": "O"}}}}
    return validate(Q.instances(spark, sf), "doc", {"properties": {"k": {"$ref": "https://example.com/k"}, "s": {"$ref": "https://example.com/s"}}}, loader=docs.__getitem__).select("k", "valid")


# ---------------------------------------------------------------- loaders


def _loaded_files(spark: SparkSession, sf: str, rows: list) -> list:
    folder = f"{Q._scratch(spark)}/files"
    spark.createDataFrame([(name, json.dumps({"const": n})) for n, name, _ in rows], "name string, value string").repartition(1).write.partitionBy("name").text(folder)
    load = loaders.standard(spark)
    missing = loaders.first_of(loaders.metaschema_loader, loaders.mapping_loader({}))
    out = []
    for n, name, _ in rows:
        try:
            missing(f"urn:{n}")
        except loaders.LoadError:
            out.append((name, int(load(f"{folder}/name={name}")["const"]), dialects.draft_of(load(dialects.URI_OF[dialects.DRAFTS[n % 5]]))))
    return out


driver_query("src_7_loaders", _loaded_files, "name string, value int, draft string", "SELECT n_name AS name, n_nationkey AS value, ['draft-04', 'draft-06', 'draft-07', '2019-09', '2020-12'][n_nationkey % 5 + 1] AS draft FROM nation")


def _cached_loads(spark: SparkSession, sf: str, rows: list) -> list:
    asked: list[str] = []
    by_region = loaders.cached(lambda uri: asked.append(uri) or {"const": uri.rpartition(":")[2]})
    load = loaders.Schemes().register("region", by_region).register("nation", lambda uri: {"const": "n"})
    got = [(region, load(f"region:{region}")["const"], load(f"nation:{name}")["const"]) for _, name, region in rows]
    return sorted({(region, value, other, asked.count(f"region:{region}")) for region, value, other in got})


driver_query("src_8_cached_loader", _cached_loads, "region int, value string, other string, loads int", "SELECT DISTINCT n_regionkey AS region, CAST(n_regionkey AS VARCHAR) AS value, 'n' AS other, 1::INTEGER AS loads FROM nation")


@query("src_9_resolve_uri", "SELECT page_id, regexp_extract(url, '^([a-z]+://[^/]+)', 1) || '/a/b?c' AS absolute, regexp_replace(url, '#.*$', '') || '#f' AS fragment, regexp_extract(url, '^([a-z]+://[^/?#]+/([^?#/]*/)*)', 1) || 'x' AS relative FROM pages")
def resolve_uri(spark: SparkSession, sf: str) -> DataFrame:
    f = loaders.resolve_relative
    return mapped(Q._table(spark, sf, "pages").select("page_id", "url"), lambda i, u: (i, f(u, "/a/./b?c"), f(u, "#f"), f(u, "x")), "page_id long, absolute string, fragment string, relative string")


# ---------------------------------------------------------------- Avro

per_key("src_11_avro_text", lambda k: (avro.format_type(s := avro.parse(json.dumps({"type": "record", "namespace": "n", "name": f"R{k % 9}", "fields": [{"name": f"f{i}", "type": ["null", "int"]} for i in range(k % 4)]}))), len(s.fields)), "type string, fields int", "'record R' || (k % 9) AS type, (k % 4)::INTEGER AS fields")


def _reference(k: int) -> tuple:
    home = {"type": "record", "name": "Home", "fields": [{"name": "a", "type": {"type": "record", "name": "Address", "fields": []}}, {"name": "b", "type": "Address" if k % 2 else "Elsewhere"}]}
    s = avro.parse(json.dumps(home))
    found = avro.resolve_reference(s.fields[1].type)
    return found.name if found else None, "; ".join(sorted({p.kind for p in avro.compare(s, avro.parse(json.dumps(home)))}))


per_key("avr_3_references", _reference, "found string, problems string", "CASE WHEN k % 2 = 1 THEN 'Address' END AS found, CASE WHEN k % 2 = 1 THEN '' ELSE 'UnknownReference' END AS problems")


def _record(*fields: str) -> avro.Schema:
    return avro.parse(Q._record(*({"name": x, "type": "int"} for x in fields)))


def _transitive(k: int) -> tuple:
    """The oldest version has the field `old` in every third row; the latest never has."""
    history = [_record("id", "old") if k % 3 == 0 else _record("id"), _record("id")]
    new = _record("id")
    return tuple(not avro.check_level(level, history, new) for level in ("BACKWARD", "BACKWARD_TRANSITIVE", "FORWARD_TRANSITIVE", "FULL_TRANSITIVE", "NONE"))


per_key("avr_4_transitive_levels", _transitive, "latest boolean, backward boolean, forward boolean, both boolean, none boolean", "true AS latest, k % 3 <> 0 AS backward, k % 3 <> 0 AS forward, k % 3 <> 0 AS both, true AS none")


def _path(k: int) -> tuple:
    of = lambda t: avro.parse(Q._record({"name": f"f{k % 7}", "type": {"type": "array", "items": {"type": "map", "values": t}}}))
    (p,) = avro.compare(of("int"), of("string" if k % 2 else "long"))
    return p.path, str(p)


per_key("avr_9_formats", _path, "path string, text string", "'.f' || (k % 7) || '[].value' AS path, '.f' || (k % 7) || '[].value: TypeMismatch: int does not read ' || CASE WHEN k % 2 = 1 THEN 'string' ELSE 'long' END AS text")


@query(
    "reg_13_compatibility",
    "WITH x AS (SELECT p_partkey, p_size % 8 AS o, p_partkey % 8 AS n, p_partkey % 3 = 0 AS d FROM part) SELECT p_partkey, (o & n) = o AND (n = o OR d) AS compatible FROM x",
)
def compatibility(spark: SparkSession, sf: str) -> DataFrame:
    """Records with the fields of three bits: no field may go, new ones need a default."""
    fields = lambda bits, old, default: F.concat_ws(",", *(F.when(bits.bitwiseAND(1 << i) > 0, F.concat(F.lit(f'{{"name":"f{i}","type":"int"'), F.when(default & (old.bitwiseAND(1 << i) == 0), F.lit(',"default":0')).otherwise(""), F.lit("}"))) for i in range(3)))
    record = lambda f: F.concat(F.lit('{"type":"record","name":"R","fields":['), f, F.lit("]}"))
    old, new = F.col("p_size") % 8, F.col("p_partkey").cast("int") % 8
    pairs = Q._table(spark, sf, "part").select("p_partkey", record(fields(old, old, F.lit(False))).alias("old"), record(fields(new, old, F.col("p_partkey") % 3 == 0)).alias("new"))
    return R.compatibility_matrix(pairs, "BACKWARD").select("p_partkey", "compatible")


# ---------------------------------------------------------------- the registry's service

Q._reg("reg_7_subject_version", "SELECT subject, version, schema FROM v JOIN schemas ON schema_id = id WHERE NOT deleted AND subject = 'Brand#2' AND version = 3", lambda s, v: R.with_schemas(R.live(v).where("subject = 'Brand#2' AND version = 3"), s).select("subject", "version", "schema"))


def _service(spark: SparkSession, sf: str) -> tuple[R.Registry, list[tuple[int, str]]]:
    """A stored registry with one version for each region."""
    reg = R.Registry(prepare(spark), Q._scratch(spark), clock=lambda: NOW, default_level="BACKWARD")
    regions = [tuple(r) for r in Q._table(spark, sf, "region").select("r_regionkey", "r_name").orderBy("r_regionkey").collect()]
    requests = spark.createDataFrame([(name, Q._record(Q._ID, name=f"R{k}"), "AVRO", k) for k, name in regions], "subject string, schema string, schema_type string, seq long")
    new, rows = R.register_bulk(requests, reg.schemas.read(), reg.versions.read(), NOW)
    reg.schemas.append(new)
    reg.versions.append(rows)
    return reg, regions


def service_query(name: str, f: Callable[[R.Registry, list], list], ddl: str, sql: str) -> None:
    QUERIES[name] = lambda spark, sf: spark.createDataFrame(f(*_service(spark, sf)), ddl)
    SQL[name] = sql


service_query("reg_14_check_latest", lambda reg, rs: [(name, not reg.check_latest(name, Q._record(Q._ID, Q._NAME | ({"default": ""} if k % 2 else {}), name=f"R{k}"))) for k, name in rs] + [("nowhere", not reg.check_latest("nowhere", '"int"'))], "subject string, compatible boolean", "SELECT r_name AS subject, r_regionkey % 2 = 1 AS compatible FROM region UNION ALL SELECT 'nowhere', true")


def _global_config(reg: R.Registry, rs: list) -> list:
    out = [("before", reg.config())]
    reg.set_config("FORWARD")
    reg.set_config("NONE", rs[0][1])
    return out + [(name, reg.config(name)) for _, name in rs]


service_query("reg_15_global_config", _global_config, "subject string, level string", "SELECT r_name AS subject, CASE WHEN r_regionkey = 0 THEN 'NONE' ELSE 'FORWARD' END AS level FROM region UNION ALL SELECT 'before', 'BACKWARD'")


def _modes(reg: R.Registry, rs: list) -> list:
    out = [("before", reg.mode())]
    reg.set_mode("IMPORT")
    reg.set_mode("READONLY", rs[0][1])
    reg.set_mode("READONLY", rs[1][1])
    reg.delete_mode(rs[1][1])
    return out + [(name, reg.mode(name)) for _, name in rs]


service_query("reg_17_modes", _modes, "subject string, mode string", "SELECT r_name AS subject, CASE WHEN r_regionkey = 0 THEN 'READONLY' ELSE 'IMPORT' END AS mode FROM region UNION ALL SELECT 'before', 'READWRITE'")
service_query("reg_18_tables", lambda reg, rs: [(t, getattr(reg, t).read().count()) for t in ("schemas", "versions", "configs", "modes")], "name string, n long", "SELECT 'schemas' AS name, count(*) AS n FROM region UNION ALL SELECT 'versions', count(*) FROM region UNION ALL SELECT 'configs', 0 UNION ALL SELECT 'modes', 0")


def _errors(reg: R.Registry, rs: list) -> list:
    calls = [lambda n: reg.version(n, 7), lambda n: reg.set_config(f"level of {n}"), lambda n: 1 / len("")]
    out = []
    for k, name in rs:
        try:
            calls[k % 3](name)
        except Exception as e:
            found = R.error_response(e)
            out.append((name, found["error_code"], found["message"]))
    return out


service_query("reg_19_errors", _errors, "subject string, code int, message string", "SELECT r_name AS subject, CASE r_regionkey % 3 WHEN 0 THEN 404 WHEN 1 THEN 422 ELSE 500 END::INTEGER AS code, CASE r_regionkey % 3 WHEN 0 THEN r_name || ' 7' WHEN 1 THEN 'level of ' || r_name ELSE 'division by zero' END AS message FROM region")

# ---------------------------------------------------------------- topics, consumers, outbox


@query("src_12_consumer_groups", "SELECT event_type AS topic, CASE WHEN event_type = 'click' THEN 0 ELSE count(*) END::BIGINT AS position FROM events GROUP BY event_type")
def consumer_groups(spark: SparkSession, sf: str) -> DataFrame:
    """A group begins at a topic's end, or where it was if it is there already."""
    store = Q._published(spark, sf)
    store.create_group("g", ("click",), "0")
    topics = [r[0] for r in store.read().select("topic").distinct().collect()]  # a few topics
    store.create_group("g", tuple(topics), "$")
    return store.offsets().where("group_id = 'g'").select("topic", "position")


@query("src_13_places", "SELECT DISTINCT 'log/topic=' || event_type AS place FROM events")
def places(spark: SparkSession, sf: str) -> DataFrame:
    return Q._published(spark, sf).read().select(F.regexp_extract(F.input_file_name(), "(log/topic=[^/]+)/", 1).alias("place")).distinct()


_COUNTS = "SELECT event_type AS topic, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type"


@query("str_1_micro_batches", f"SELECT topic, n, true AS several FROM ({_COUNTS})")
def micro_batches(spark: SparkSession, sf: str) -> DataFrame:
    """One file a batch: several batches, each row once."""
    store = TopicStore(prepare(spark), Q._scratch(spark))
    for i in range(3):
        store.publish(Q._log(spark, sf).where(F.crc32("event_id") % 3 == i).coalesce(1))
    seen = f"{store.path}/seen"
    numbers: list[int] = []
    Consumer(store, E.StreamConfig("g", ("click", "view"), batch_size=1, start="0"), lambda df, n: numbers.append(n) or df.select("topic").write.mode("overwrite").parquet(f"{seen}/batch={n}")).run_once()
    return spark.read.parquet(seen).groupBy("topic").agg(F.count("*").alias("n"), F.lit(len(numbers) >= 3).alias("several"))


@query("str_2_shared_position", f"SELECT g.name, topic, CASE WHEN g.name = 'g again' THEN 0 ELSE n END::BIGINT AS n FROM ({_COUNTS}), (VALUES ('g'), ('g again'), ('h')) g(name)")
def shared_position(spark: SparkSession, sf: str) -> DataFrame:
    """Members of a group share its position; another group has its own."""
    store = Q._published(spark, sf)
    topics, out = ("click", "view"), []
    for name in ("g", "g again", "h"):
        got = dict.fromkeys(topics, 0)

        def count(df: DataFrame, _: int, got=got) -> None:
            for r in df.groupBy("topic").count().collect():  # one row a topic
                got[r["topic"]] += r["count"]

        Consumer(store, E.StreamConfig(name.split(" ")[0], topics, start="0"), count).run_once()
        out += [(name, t, n) for t, n in got.items()]
    return spark.createDataFrame(out, "name string, topic string, n long")


@query("src_3_restarts", f"SELECT topic, n, 2::INTEGER AS failures FROM ({_COUNTS})")
def restarts(spark: SparkSession, sf: str) -> DataFrame:
    """A consumer whose handler fails twice is started again until it gets through, then stopped."""
    store = Q._published(spark, sf)
    seen, failures = f"{store.path}/seen", []

    def handle(df: DataFrame, n: int) -> None:
        if len(failures) < 2:
            raise RuntimeError("not yet")
        df.select("topic").write.mode("overwrite").parquet(f"{seen}/batch={n}")
        if spark.read.parquet(seen).count() == wanted:
            threading.Timer(0.5, consumer.stop).start()

    wanted = store.read("click", "view").count()
    consumer = Consumer(store, E.StreamConfig("g", ("click", "view"), poll_ms=100, start="0"), handle)
    consumer.run_forever(sleep=failures.append, log=lambda text: None)
    return spark.read.parquet(seen).groupBy("topic").agg(F.count("*").alias("n"), F.lit(len(failures)).alias("failures"))


def _outbox_box(spark: SparkSession, sf: str) -> O.Outbox:
    folder = Q._scratch(spark)
    return O.Outbox(spark, f"{folder}/outbox", TopicStore(prepare(spark), f"{folder}/topics"), O.OutboxConfig(batch_size=1_000_000), clock=lambda: NOW)


@query("snk_8_outbox_table", "SELECT event_type AS topic, count(*) AS n, count(*) AS waiting, 0::BIGINT AS retries FROM events GROUP BY event_type")
def outbox_table(spark: SparkSession, sf: str) -> DataFrame:
    """A new outbox, made twice, written once."""
    box = _outbox_box(spark, sf)
    box.table.create()
    box.write(Q._log(spark, sf).withColumn("key", F.lit(None).cast("string")))
    rows = box.table.read()
    return rows.groupBy("topic").agg(F.count("*").alias("n"), F.sum(F.col("processed_at").isNull().cast("long")).alias("waiting"), F.sum("retries").alias("retries"))


@query("str_6_pause", "SELECT event_type AS topic, 0::BIGINT AS paused, count(*) AS n FROM events GROUP BY event_type")
def pause(spark: SparkSession, sf: str) -> DataFrame:
    """A stopped outbox publishes nothing; an active one all."""
    box = _outbox_box(spark, sf)
    box.write(Q._log(spark, sf).withColumn("key", F.lit(None).cast("string")))
    box.stop()
    paused = box.run()
    box.active = True
    box.run()
    return box.topics.read().groupBy("topic").agg(F.lit(paused).cast("long").alias("paused"), F.count("*").alias("n"))


# ---------------------------------------------------------------- types and documents


@query("gen_3_names", "SELECT DISTINCT p_name AS name, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), '') AS type, replace(p_name, ' ', '_') AS snake, p_name[1] || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), '')[2:] AS camel FROM part")
def names(spark: SparkSession, sf: str) -> DataFrame:
    o = schema_types.Options
    return mapped(Q._table(spark, sf, "part").select("p_name").distinct(), lambda n: (n, schema_types.type_name(n), schema_types.field_name(n, o("snake")), schema_types.field_name(n, o("camel"))), "name string, type string, snake string, camel string")


_KINDS = ("string", "integer", "boolean", "number")
per_key("gen_4_describe", lambda k: (schema_types.describe({"type": "object", "properties": {f"f{k % 5}": {"type": "array", "items": {"type": _KINDS[k % 4]}}}}),), "type string", "'struct<f' || (k % 5) || ':array<' || ['string', 'bigint', 'boolean', 'decimal(38,18)'][k % 4 + 1] || '>>' AS type")
per_key("gen_5_options", lambda k: (schema_types.spark_type({"type": "integer" if k % 2 else "number"}, schema_types.Options(wide_integers=k % 3 == 0, doubles=k % 3 == 1)).simpleString(), schema_types.field_name(f"preOrderDate{k % 9}", schema_types.Options("snake", prefix="pre"))), "type string, field string", "CASE WHEN k % 2 = 1 THEN CASE WHEN k % 3 = 0 THEN 'decimal(38,0)' ELSE 'bigint' END ELSE CASE WHEN k % 3 = 1 THEN 'double' ELSE 'decimal(38,18)' END END AS type, 'order_date' || (k % 9) AS field")


def _document(rows: list, version: str = "3.1.0") -> dict:
    """A path and a schema for each nation."""
    return {
        "openapi": version, "info": {"title": "Nations", "version": "1"}, "servers": [{"url": "https://example.com"}], "tags": [{"name": f"region{r}"} for r in sorted({r for *_, r in rows})],
        "paths": {f"/{name}": {("get" if n % 2 else "post"): {"operationId": f"op{n}", "tags": [f"region{r}"], "deprecated": n % 5 == 0, "parameters": [{"$ref": "#/components/parameters/id"}, {"name": "q", "in": "query"}][: n % 3], "responses": {"200": {"$ref": "#/components/responses/fine"}}}} for n, name, r in rows},
        "components": {"schemas": {name: {"type": "integer", "maximum": n} for n, name, _ in rows}, "parameters": {"id": {"name": "id", "in": "path", "schema": {"type": "integer"}}}, "responses": {"fine": {"content": {"application/json": {"schema": {"type": "string"}}}}}},
    }


@query("oas_1_operations", "SELECT '/' || n_name AS path, CASE WHEN n_nationkey % 2 = 1 THEN 'get' ELSE 'post' END AS method, 'op' || n_nationkey AS operation_id, (n_nationkey % 3)::BIGINT AS n_parameters, n_nationkey % 5 = 0 AS deprecated FROM nation")
def operations(spark: SparkSession, sf: str) -> DataFrame:
    return openapi.operations_table(prepare(spark), openapi.parse(json.dumps(_document(nations(spark, sf))))).select("path", "method", "operation_id", F.size("parameters").cast("long").alias("n_parameters"), "deprecated")


def _components(spark: SparkSession, sf: str, rows: list) -> list:
    spec = openapi.parse(_document(rows))
    by = {o.path: o for o in spec.operations}
    return [(name, render(spec.schemas[name]), Evaluator(openapi.schema_document(spec, name)).is_valid(10), by[f"/{name}"].tags[0] in spec.tags, ",".join(by[f"/{name}"].responses["200"]), spec.servers[0]) for _, name, _ in rows]


driver_query("oas_2_components", _components, "name string, schema string, valid boolean, tagged boolean, response string, server string", """SELECT n_name AS name, '{"maximum": ' || n_nationkey || ', "type": "integer"}' AS schema, 10 <= n_nationkey AS valid, true AS tagged, 'application/json' AS response, 'https://example.com' AS server FROM nation""")

# ---------------------------------------------------------------- expressions and names

per_key("rgx_5_groups", lambda k: ((r := ecma.compile_regex(f"(?<g{k % 20}>a)" + "(b)" * (k % 3), "gi" if k % 2 else "")).capture_count, r.flags, ",".join(r.names)), "capture_count int, flags string, names string", "(2 + k % 3)::INTEGER AS capture_count, CASE WHEN k % 2 = 1 THEN 'gi' ELSE '' END AS flags, 'g' || (k % 20) AS names")


@query("rgx_8_engine", "SELECT p_partkey, contains(p_name, 'l') AND contains(p_name, 'e') AS ahead, regexp_matches(p_name, 'aa|bb|cc|dd|ee|ff|gg|ll|mm|nn|oo|pp|rr|ss|tt') AS doubled, regexp_extract(p_name, '^(.*?)[aeiou]', 1) AS lazy, true AS bounded FROM part")
def engine(spark: SparkSession, sf: str) -> DataFrame:
    """Lookahead, a reference back, a lazy quantifier; a pattern that would backtrack for ever ends."""

    def run(k: int, name: str) -> tuple:
        try:
            ecma.Regex("^(a|aa)+$", limit_s=0.05).test("a" * 40 + "b") if k % 500 == 0 else None
            bounded = k % 500 != 0
        except ecma.RegexError:
            bounded = True
        m = ecma.compile_regex("^(.*?)[aeiou]").match(name)
        return k, ecma.compile_regex("^(?=.*l)(?=.*e)").test(name), ecma.compile_regex(r"([a-z])\1").test(name), m["captures"][0]["text"] if m else "", bounded

    return mapped(Q._table(spark, sf, "part").select("p_partkey", "p_name"), run, "p_partkey long, ahead boolean, doubled boolean, lazy string, bounded boolean")


def _label(label: str) -> tuple:
    try:
        idn.validate_label(label)
    except idn.IdnError as e:
        return (e.kind,)
    return ("",)


#: Labels by their number, with what is wrong with them: contextual rules, right-to-left rules, properties of characters.
CONTEXTUAL = [("l·l", ""), ("a·l", "ContextRule"), ("͵α", ""), ("͵a", "ContextRule"), ("א׳", ""), ("a׳", "ContextRule"), ("・ア", ""), ("a・b", "ContextRule"), ("ب‌ب", ""), ("a‌b", "ContextRule"), ("क्‍ष", ""), ("a‍b", "ContextRule"), ("ب٠١", ""), ("٠۰", "ContextRule")]
BIDI = [("אב1", ""), ("1אב", "BidiRule"), ("אaב", "BidiRule"), ("aאb", "BidiRule"), ("ab1", ""), ("א1٢", "BidiRule"), ("אב", ""), ("ابج", "")]
PROPERTIES = [("bücher", ""), ("́a", "LeadingCombiningMark"), ("ａ", "DisallowedCodePoint"), ("ａb", "DisallowedCodePoint"), ("☃", "DisallowedCodePoint"), ("日本", ""), ("ß", ""), ("ـa", "DisallowedCodePoint"), ("ﬁ", "DisallowedCodePoint"), ("ς", "")]


def _labels(name: str, cases: list[tuple[str, str]]) -> None:
    texts = ", ".join(f"'{e}'" for _, e in cases)
    per_key(name, lambda k: (cases[k % len(cases)][0], *_label(cases[k % len(cases)][0])), "label string, error string", f"[{', '.join(f"'{t}'" for t, _ in cases)}][k % {len(cases)} + 1] AS label, [{texts}][k % {len(cases)} + 1] AS error")


_labels("idn_5_contextual_rules", CONTEXTUAL)
_labels("idn_6_bidi_rules", BIDI)
_labels("idn_7_properties", PROPERTIES)

# Vectors published with RFC 3492 and RFC 5891.
VECTORS = {
    "bücher": "bcher-kva",
    "münchen": "mnchen-3ya",
    "faß": "fa-hia",
    "他们为什么不说中文": "ihqwcrb4cv8a8dqg056pqjye",
    "почемужеонинеговорятпорусски": "b1abfaaepdrnnbgefbadotcwatmq2g4l",
    "なぜみんな日本語を話してくれないのか": "n8jok5ay5dzabd5bym9f0cm5685rrjetr6pdxa",
}
_WORDS = "(SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS word FROM conversations) WHERE word <> '')"
_ASCII = "regexp_full_match(word, '[ -~]*')"
_VECTOR_ROWS = ", ".join(f"('{w}', '{p}')" for w, p in VECTORS.items())


def _with_vectors(words: DataFrame) -> DataFrame:
    return words.unionByName(words.sparkSession.createDataFrame([(w,) for w in VECTORS], "word string")).distinct()


def _basic(value: object, word: object, known: object) -> object:
    """All of it for ASCII words and published vectors; of others the part that the word itself shows."""
    return F.when(known | word.rlike("^[ -~]*$"), value).otherwise(F.regexp_extract(value, "^(.*-)?[^-]*$", 1))


@query("pun_1_encode", f"WITH v(word, p) AS (VALUES {_VECTOR_ROWS}), b AS (SELECT word, regexp_replace(word, '[^ -~]', '', 'g') AS basic FROM {_WORDS} UNION SELECT word, regexp_replace(word, '[^ -~]', '', 'g') FROM v) SELECT word, coalesce(p, CASE WHEN basic = '' THEN '' ELSE basic || '-' END) AS punycode FROM b LEFT JOIN v USING (word)")
def pun_encode(spark: SparkSession, sf: str) -> DataFrame:
    words = idn.with_punycode(_with_vectors(Q._words(spark, sf)), "word")
    return words.select("word", _basic(F.col("punycode.value"), F.col("word"), F.col("word").isin(*VECTORS)).alias("punycode"))


@query(
    "idn_1_to_ascii",
    f"WITH v(word, p) AS (VALUES {_VECTOR_ROWS}), b AS (SELECT word, regexp_replace(word, '[^ -~]', '', 'g') AS basic FROM {_WORDS} UNION SELECT word, regexp_replace(word, '[^ -~]', '', 'g') FROM v) SELECT word, CASE WHEN {_ASCII} THEN word WHEN p IS NOT NULL THEN 'xn--' || p ELSE 'xn--' || CASE WHEN basic = '' THEN '' ELSE basic || '-' END END AS ascii, CAST(NULL AS VARCHAR) AS error FROM b LEFT JOIN v USING (word)",
)
def idn_to_ascii(spark: SparkSession, sf: str) -> DataFrame:
    words = idn.with_ascii(_with_vectors(Q._words(spark, sf)), "word")
    return words.select("word", _basic(F.col("ascii.value"), F.col("word"), F.col("word").isin(*VECTORS)).alias("ascii"), "ascii.error")


@query("idn_2_to_unicode", f"SELECT word AS unicode FROM {_WORDS}")
def idn_to_unicode(spark: SparkSession, sf: str) -> DataFrame:
    """Names through ASCII and back."""
    there = idn.with_ascii(Q._words(spark, sf), "word").select("word", F.col("ascii.value").alias("a"))
    return idn.with_unicode(there, "a").select(F.col("unicode.value").alias("unicode"))


@query("idn_3_validate_label", f"SELECT word, CAST(NULL AS VARCHAR) AS plain, 'InvalidHyphen' AS hyphen, 'DisallowedCodePoint' AS capital, CASE WHEN length(word) * 4 > 63 THEN 'LabelTooLong' END AS long FROM {_WORDS}")
def idn_validate(spark: SparkSession, sf: str) -> DataFrame:
    """A word, with a hyphen in front, with a capital, and four times itself."""
    words = Q._words(spark, sf).select("word", F.concat(F.lit("-"), "word").alias("h"), F.concat("word", F.lit("A")).alias("c"), F.repeat("word", 4).alias("l"))
    for column, name in (("word", "plain"), ("h", "hyphen"), ("c", "capital"), ("l", "long")):
        words = idn.with_label_check(words, column, "r").withColumn(name, F.col("r.error")).drop("r")
    return words.select("word", "plain", "hyphen", "capital", "long")


# ---------------------------------------------------------------- keywords that say little by themselves

for _name, _schema, _condition, *_config in [
    ("kw_14_format", {"anyOf": [Q._prop("p", {"format": "date"}), {**Q._prop("k", {"multipleOf": 2}), **Q._prop("d", {"format": "date"})}], "allOf": [Q._prop("d", {"format": "date"}), Q._prop("k", {"multipleOf": 2})]}, "k % 2 = 0", Config(format_assertion=True)),
    ("kw_16_content_media_type", {"anyOf": [Q._prop("d", {"contentMediaType": "application/json"}), Q._prop("k", {"multipleOf": 3})]}, "k % 3 = 0", Config(draft="draft-07")),
]:
    Q._keyword(_name, _schema, _condition, *_config)


@query("kw_49_vocabulary", f"{Q._BASE} SELECT k, NOT ({Q._Z}) AS valid FROM b")
def kw_49_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """A metaschema without the validation vocabulary: assertions are dropped, applicators stay."""
    meta = {"$schema": dialects.URI_OF["2020-12"], "$id": "https://example.com/meta", "$vocabulary": {dialects.URI_OF["2020-12"].replace("/schema", "/vocab/applicator"): True}}
    return validate(Q.instances(spark, sf), "doc", {"$schema": "https://example.com/meta", "properties": {"k": {"maximum": 3}, "z": False}, "required": ["nothing"]}, loader=lambda uri: {"https://example.com/meta": meta}[uri]).select("k", "valid")


# ---------------------------------------------------------------- layers


def _held(log: list[str], name: str, fails: bool = False) -> L.Layer:
    def acquire(_: object) -> str:
        if fails:
            raise ValueError(name)
        log.append(f"+{name}")
        return name

    return L.resource(acquire, lambda v: log.append(f"-{v}"), name)


def _layer_query(name: str, f: Callable[[int, list[str]], object], sql: str) -> None:
    """Over nations: what the layer gave and what happened in which order."""

    def one(n: int) -> tuple[str, str]:
        log: list[str] = []
        try:
            value = str(f(n, log))
        except Exception as e:
            value = f"{type(e).__name__}: {e}"
        return value, " ".join(log)

    driver_query(name, lambda spark, sf, rows: [(n, *one(n)) for n, *_ in rows], "n int, value string, log string", f"SELECT n, {sql} FROM (SELECT n_nationkey AS n FROM nation)")


class _Opened:
    """A context manager that notes when it is opened and closed."""

    def __init__(self, log: list[str], n: int) -> None:
        self.log, self.n = log, n

    def __enter__(self) -> str:
        self.log.append(f"open{self.n}")
        return f"v{self.n}"

    def __exit__(self, *_: object) -> None:
        self.log.append(f"close{self.n}")


_layer_query("lay_1_resources", lambda n, log: L.bracketed(lambda d: _Opened(log, n)).then(L.effect(lambda v: f"{v}!")).run(lambda v: log.append("use") or v) if n % 2 else L.pure(n).run(lambda v: v + 1), "CASE WHEN n % 2 = 1 THEN 'v' || n || '!' ELSE CAST(n + 1 AS VARCHAR) END AS value, CASE WHEN n % 2 = 1 THEN 'open' || n || ' use close' || n ELSE '' END AS log")


def _shared(n: int, log: list[str]) -> object:
    s = L.service(_held(log, f"s{n}", fails=n % 5 == 0), "key")
    return s.zip(s).run(lambda v: "".join(v))


_layer_query("lay_2_services", _shared, "CASE WHEN n % 5 = 0 THEN 'ValueError: s' || n ELSE 's' || n || 's' || n END AS value, CASE WHEN n % 5 = 0 THEN '' ELSE '+s' || n || ' -s' || n END AS log")
_layer_query("lay_3_composition", lambda n, log: _held(log, "a").then(L.effect(lambda v: f"{v}{n}").zip(_held(log, "b", fails=n % 4 == 0))).run(lambda v: "/".join(v)), "CASE WHEN n % 4 = 0 THEN 'ValueError: b' ELSE 'a' || n || '/b' END AS value, CASE WHEN n % 4 = 0 THEN '+a -a' ELSE '+a +b -b -a' END AS log")
_layer_query("lay_4_instances", lambda n, log: _held(log, "a").then(_held(log, "b", fails=n % 3 == 0)).or_else(_held(log, "c")).map(str.upper).flat_map(lambda v: L.effect(lambda d: f"{v}{d}")).contramap(lambda d: d * 2).run(lambda v: v, n), "CASE WHEN n % 3 = 0 THEN 'C' ELSE 'B' END || (n * 2) AS value, CASE WHEN n % 3 = 0 THEN '+a -a +c -c' ELSE '+a +b -b -a' END AS log")
_layer_query("lay_5_running", lambda n, log: _held(log, "a").run(lambda v: log.append("use") or (1 // (n % 2))), "CASE WHEN n % 2 = 0 THEN 'ZeroDivisionError: integer division or modulo by zero' ELSE '1' END AS value, '+a use -a' AS log")
_layer_query("lay_6_environment", lambda n, log: L.assemble(lambda i, s: f"{s}{i}", int, str).run(lambda v: v, L.Environment(n).merge(L.Environment(n + 1)).append("x") if n % 2 else L.Environment(n)), "CASE WHEN n % 2 = 1 THEN 'x' || (n + 1) ELSE 'LookupError: str' END AS value, '' AS log")


class _Hooks(L.Interceptor):
    def __init__(self, log: list[str], mark: str) -> None:
        self.on_start = lambda name: log.append(f"{mark}start:{name}")
        self.on_release = lambda name, s: log.append(f"{mark}release:{name}")
        self.on_compose = lambda a, b: log.append(f"{mark}compose")
        self.on_failed = lambda name, e: log.append(f"{mark}failed:{name}")
        self.on_end = lambda: log.append(f"{mark}end")


_layer_query("lay_7_interceptors", lambda n, log: _held([], "a").then(_held([], "b", fails=n % 2 == 0)).run(lambda v: v, None, L.combine(_Hooks(log, "1"), _Hooks(log, "2"), L.Interceptor())), "CASE WHEN n % 2 = 0 THEN 'ValueError: b' ELSE 'b' END AS value, '1compose 2compose 1start:a 2start:a 1start:b 2start:b ' || CASE WHEN n % 2 = 0 THEN '1failed:b 2failed:b ' ELSE '1release:b 2release:b ' END || '1release:a 2release:a 1end 2end' AS log")


def _diagnosed(n: int, log: list[str]) -> str:
    d = L.Diagnostics()
    s = L.service(_held([], f"r{n}"), 1)
    try:
        s.then(s).then(_held([], "x", fails=n % 3 == 0)).run(lambda v: log.append(d.tree().split(" (")[0]), None, d)
    except ValueError:
        log.append("failed")
    return "; ".join(f"{x['name']} {x['status']} {x['hits']} {x['error']}".strip() for x in json.loads(d.to_json()))


_layer_query("lay_8_diagnostics", _diagnosed, "'r' || n || ' released 1; x ' || CASE WHEN n % 3 = 0 THEN 'failed 0 x' ELSE 'released 0' END AS value, CASE WHEN n % 3 = 0 THEN 'failed' ELSE '+ r' || n END AS log")
