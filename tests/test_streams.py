import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from streamcontract.operators import avro, events as E, outbox as O, registry as R
from streamcontract.plans import layers, openapi, types
from streamcontract.sources import loaders
from streamcontract.sources.tables import ConflictError, Table
from streamcontract.sources.topics import TopicStore
from streamcontract.streaming.consumers import Consumer, balance_stream, deduplicated

NOW = dt.datetime(2024, 1, 1)


def eid(n):
    return f"00000000-0000-4000-8000-{n:012d}"


def made(spark, n, topic="t", first=0):
    rows = [(eid(i), "posted", 1, NOW + dt.timedelta(seconds=i), "s", json.dumps({"account": i % 2, "amount": i}), {"user": str(i % 3)}, topic, None) for i in range(first, first + n)]
    return spark.createDataFrame(rows, E.ENVELOPE + ", topic string, key string")


def test_wire_round_trip(spark):
    e = made(spark, 3)
    back = E.from_wire(E.to_wire(e))
    assert back.where("error IS NULL").select(*E.WIRE).collect() == e.select(*E.WIRE).collect()


def test_publish_info_replay(spark, tmp_path):
    s = TopicStore(spark, str(tmp_path))
    assert s.read("t").count() == 0
    assert s.publish(made(spark, 5)) == 5
    assert s.publish(made(spark, 7)) == 2  # five are there already
    assert s.publish(made(spark, 2, "u")) == 2
    assert [r["offset"] for r in s.read("t").orderBy("offset").collect()] == list(range(7))
    s.commit("g", "t", 3, NOW)
    s.commit("g", "t", 5, NOW)
    info = {r["topic"]: r for r in s.info().collect()}
    assert (info["t"]["length"], info["t"]["last_offset"], info["t"]["groups"]) == (7, 6, ["g"])
    assert info["u"]["groups"] == []
    assert s.position("g", "t") == 5
    assert s.position("g", "u") == "$"
    assert [s.reset("g", "t", x) for x in ("0", "$", "4-0", NOW + dt.timedelta(seconds=2))] == [0, 7, 4, 2]
    c = E.ReplayConfig(("t",), NOW + dt.timedelta(seconds=1), NOW + dt.timedelta(seconds=6), (("user", "1"),))
    assert [r["event_id"] for r in s.replay(c).orderBy("offset").collect()] == [eid(1), eid(4)]
    assert s.replay_into(c, "again") == 2
    assert len(s.publish_one("one", "x", "{}")) == 36


def test_outbox(spark, tmp_path):
    s = TopicStore(spark, str(tmp_path / "topics"))
    o = O.Outbox(spark, str(tmp_path / "outbox"), s, O.OutboxConfig(batch_size=2, max_retries=2), clock=lambda: NOW)
    o.write(made(spark, 3))
    refuse = lambda d: d.withColumn("decode_error", F.when(F.col("row_id") == eid(0), "no").otherwise(F.col("decode_error")))
    assert o.process(refuse) == (1, 1)
    assert o.process(refuse) == (1, 1)
    assert o.process(refuse) == (0, 0)  # out of retries
    rows = {r.event_id: r for r in o.table.read().collect()}
    assert (rows[eid(0)].retries, rows[eid(0)].error, rows[eid(0)].processed_at) == (2, "no", None)
    assert rows[eid(1)].processed_at == NOW
    assert s.read("t").count() == 2
    o.update_event(eid(0), 0, None)
    assert o.run() == 1
    assert s.read("t").count() == 3
    s2 = s.publish(made(spark, 3))
    assert s2 == 0
    o.write(made(spark, 1, first=9))
    o.mark_processed(eid(9))
    assert o.process() == (0, 0)


def test_outbox_backlog_goes_out_in_one_turn(spark, tmp_path):
    times = iter([NOW, NOW + dt.timedelta(hours=1), *[NOW + dt.timedelta(hours=2)] * 9])
    s = TopicStore(spark, str(tmp_path / "topics"))
    o = O.Outbox(spark, str(tmp_path / "outbox"), s, O.OutboxConfig(batch_size=2), clock=lambda: next(times))
    o.write(made(spark, 4, first=3))
    o.write(made(spark, 3))  # earlier events, written later
    version = o.table.version()
    assert o.run() == 7
    assert o.table.version() == version + 1
    assert [r["event_id"] for r in s.read("t").orderBy("offset").collect()] == [eid(i) for i in (3, 4, 5, 6, 0, 1, 2)]
    assert o.table.read().where("processed_at IS NULL").count() == 0
    assert (o.run(), o.process()) == (0, (0, 0))  # nothing to do: nothing is written
    assert o.table.version() == version + 1


def test_consumer_groups(spark, tmp_path):
    s = TopicStore(spark, str(tmp_path))
    s.publish(made(spark, 4))
    got = []

    def handler(df, n):
        got.extend(sorted(r["event_id"] for r in df.collect()))
        return df.where(F.col("event_id") == eid(1)).withColumn("error", F.lit("refused"))

    c = Consumer(s, E.StreamConfig("g", ("t",), start="0"), handler)
    c.run_once()
    assert got == [eid(i) for i in range(4)]
    s.publish(made(spark, 6))
    Consumer(s, E.StreamConfig("g", ("t",), start="0"), handler).run_once()
    assert got == [eid(i) for i in range(6)]  # the group goes on where it was
    assert s.position("g", "t") == 6
    assert spark.read.parquet(f"{tmp_path}/dead_letter/g").count() == 1
    late = []
    Consumer(s, E.StreamConfig("end", ("t",), start="$"), lambda df, n: late.extend(df.collect())).run_once()
    assert late == []
    some = []
    Consumer(s, E.StreamConfig("from4", ("t",), start="4-0"), lambda df, n: some.extend(r["offset"] for r in df.collect())).run_once()
    assert sorted(some) == [4, 5]


def test_typed_consumer_sets_poison_aside(spark, tmp_path):
    s = TopicStore(spark, str(tmp_path))
    s.publish(made(spark, 2).unionByName(made(spark, 1, first=5).withColumn("payload", F.lit("{broken"))))
    got = []
    Consumer(s, E.StreamConfig("g", ("t",), start="0"), lambda df, n: got.extend(r["data"]["amount"] for r in df.collect()), payload_schema="account int, amount int").run_once()
    assert sorted(got) == [0, 1]
    assert spark.read.parquet(f"{tmp_path}/poison/g").count() == 1


def test_streaming_state(spark, tmp_path):
    s = TopicStore(spark, str(tmp_path))
    s.publish(made(spark, 6))
    stream = spark.readStream.schema(s.read().schema).parquet(s.log)
    amount = F.get_json_object("payload", "$.amount").cast("double")
    q = balance_stream(stream, F.get_json_object("payload", "$.account"), amount).writeStream.outputMode("complete").format("memory").queryName("balances").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.account, float(r.balance)) for r in spark.table("balances").collect()} == {("0", 6.0), ("1", 9.0)}
    q = deduplicated(stream).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 6


def test_table_conflicts(spark, tmp_path):
    t = Table(spark, str(tmp_path), "a int").create()
    t.append(spark.createDataFrame([(1,)], "a int"))
    t.append(spark.createDataFrame([(2,)], "a int"), compact_after=2)
    assert sorted(r.a for r in t.read().collect()) == [1, 2]

    def racing(df):
        t.append(spark.createDataFrame([(3,)], "a int"))
        return df

    with pytest.raises(ConflictError):
        t.update(racing)
    assert t.read().count() == 3
    assert t.read(1).count() == 0


V1 = json.dumps({"type": "record", "name": "T", "fields": [{"name": "id", "type": "int"}]})
V2 = json.dumps({"type": "record", "name": "T", "fields": [{"name": "id", "type": "int"}, {"name": "e", "type": "string", "default": ""}]})
BAD = json.dumps({"type": "record", "name": "T", "fields": [{"name": "id", "type": "string"}]})


def test_registry(spark, tmp_path):
    r = R.Registry(spark, str(tmp_path), clock=lambda: NOW)
    with pytest.raises(R.NotFoundError):
        r.latest("s")
    one = r.register("s", V1)
    assert r.register("other", V1) == one
    two = r.register("s", V2)
    assert two != one
    assert r.subjects() == ["other", "s"]
    assert r.subject_versions("s") == [1, 2]
    assert r.schema_text("s", 1) == V1
    assert r.latest("s").version == 2
    assert r.schema_by_id(two).schema == V2
    assert r.schema_versions(one) == [("other", 1), ("s", 1)]
    assert r.referenced_by("s", 1) == [("other", 1), ("s", 1)]
    assert r.config() == "FULL"
    r.set_config("BACKWARD")
    r.set_config("NONE", "s")
    assert (r.config("s"), r.config("other")) == ("NONE", "BACKWARD")
    assert r.check_latest("s", BAD) == []
    r.delete_config("s")
    assert [p.kind for p in r.check_latest("s", BAD)] == ["TypeMismatch", "MissingField"]
    assert r.check("s", 1, V2) == []
    assert r.check("s", 1, '{"type":"object"}', "JSON")
    r.set_config("BACKWARD_TRANSITIVE")
    assert any(p.path.startswith("v1") for p in r.check_latest("s", BAD))
    assert r.delete_version("s", 1) == 1
    assert r.register("s", V1) == one
    assert r.subject_versions("s") == [2, 3]
    assert r.delete_subject("s") == [2, 3]
    with pytest.raises(R.NotFoundError):
        r.version("s", 2)
    r.set_mode("READONLY", "s")
    assert (r.mode("s"), r.mode()) == ("READONLY", "READWRITE")
    with pytest.raises(R.InvalidError):
        r.register("s", V1)
    r.delete_mode("s")
    strict = R.Registry(spark, str(tmp_path), enforce=True)
    with pytest.raises(R.InvalidError):
        strict.register("other", BAD)
    assert R.error_response(R.NotFoundError("x")) == {"error_code": 404, "message": "x"}


AVRO = [
    ('"int"', '"long"', True), ('"float"', '"int"', False), (V1, V2, True), (V2, V1, False), (V1, BAD, False),
    ('["null","int"]', '["null","int","string"]', True), ('["int","string"]', '"int"', True), ('"int"', '["string","int"]', True), ('"int"', '["string"]', False),
    ('{"type":"map","values":"int"}', '{"type":"map","values":"long"}', True),
    ('{"type":"record","name":"a.Old","fields":[]}', '{"type":"record","name":"b.New","aliases":["Old"],"fields":[]}', True),
    ('{"type":"record","name":"R","fields":[{"name":"x","type":"int"}]}', '{"type":"record","name":"R","fields":[{"name":"y","aliases":["x"],"type":"int"}]}', True),
    ('{"type":"enum","name":"E","symbols":["A","B"]}', '{"type":"enum","name":"E","symbols":["A"],"default":"A"}', True),
    ('{"type":"fixed","name":"F","size":4}', '{"type":"fixed","name":"F","size":4,"logicalType":"decimal"}', False),
    ('{"type":"record","name":"L","fields":[{"name":"next","type":["null","L"]}]}', '{"type":"record","name":"L","fields":[{"name":"next","type":["null","L"]}]}', True),
]


@pytest.mark.parametrize(("old", "new", "want"), AVRO)
def test_avro(old, new, want):
    assert (avro.backward(avro.parse(old), avro.parse(new)) == []) is want
    assert (avro.forward(avro.parse(new), avro.parse(old)) == []) is want


def test_avro_levels_and_paths():
    s = [avro.parse(x) for x in ('"string"', '"bytes"', '"string"')]
    assert all(avro.check_level(level, s[:2], s[2]) == [] for level in avro.LEVELS)
    deep = lambda t: avro.parse({"type": "record", "name": "R", "fields": [{"name": "user", "type": {"type": "array", "items": {"type": "map", "values": t}}}]})
    assert [p.path for p in avro.backward(deep("int"), deep("string"))] == [".user[].value"]
    assert avro.backward(avro.parse('"int"'), avro.parse('"Nope"'))[0].path == "@Nope"
    with pytest.raises(avro.AvroError):
        avro.parse("{")


def test_types():
    t = types.struct_for({"type": "object", "required": ["id"], "properties": {"id": {"type": "integer"}, "nameFirst": {"type": ["string", "null"]}, "tags": {"type": "array", "items": {"type": "string"}}, "any": {}, "in": {"$ref": "#/$defs/p"}}, "$defs": {"p": {"type": "object", "properties": {"x": {"type": "number"}}}}}, types.Options(fields="snake"))
    assert t.simpleString() == "struct<id:bigint,name_first:string,tags:array<string>,any:variant,in:struct<x:decimal(38,18)>>"
    assert not t["id"].nullable
    assert [types.strategy(s) for s in ({"x-newtype": True}, {"oneOf": [{}]}, {"enum": [1]}, {"properties": {"a": {}}, "required": ["a"]}, {"type": "object", "properties": {"a": {}, "b": {}}}, {"type": "string"})] == ["newtype", "sum", "enum", "newtype", "record", "value"]
    assert types.type_name("my-type 2") == "MyType2"
    assert types.field_name("2nd-Name", types.Options(fields="camel")) == "_2ndName"
    assert types.shape({"enum": ["a", "b"]}, "color").symbols == ["a", "b"]


def test_openapi(spark):
    doc = {"swagger": "2.0", "info": {"title": "t", "version": 1}, "host": "h", "basePath": "/b", "consumes": ["application/json"], "produces": ["application/json"], "paths": {"/a/{id}": {"parameters": [{"name": "id", "in": "path", "type": "string"}], "put": {"deprecated": True, "parameters": [{"name": "body", "in": "body", "schema": {"$ref": "#/definitions/P"}}], "responses": {"200": {"description": "", "schema": {"type": "string"}}}}}}, "definitions": {"P": {"type": "object", "properties": {"q": {"$ref": "#/definitions/Q"}}}, "Q": {"type": "integer"}}}
    spec = openapi.parse(json.dumps(doc))
    assert (spec.version, spec.servers, spec.operations[0].method) == ("2.0", ["https://h/b"], "put")
    row = openapi.operations_table(spark, spec).first()
    assert row.deprecated
    assert row.parameters[0].required
    assert row.responses["200"] == {"application/json": '{"type": "string"}'}
    from streamcontract.plans.jsonschema import Evaluator

    e = Evaluator(openapi.schema_document(spec, "P"))
    assert e.is_valid({"q": 1})
    assert not e.is_valid({"q": "x"})
    with pytest.raises(openapi.OpenApiError):
        openapi.parse("{}")


def test_layers():
    log = []
    res = lambda n, fail=False: layers.resource(lambda d: (_ for _ in ()).throw(RuntimeError(n)) if fail else log.append(f"+{n}") or n, lambda v: log.append(f"-{v}"), n)
    d = layers.Diagnostics()
    both = res("a").then(layers.effect(lambda a: a + "!").zip(res("b")))
    assert both.run(lambda v: v, interceptor=d) == ("a!", "b")
    assert log == ["+a", "+b", "-b", "-a"]
    assert [n.status for n in d.nodes] == ["released", "released"]
    assert "a" in d.tree()
    assert json.loads(d.to_json())[0]["name"] == "a"
    log.clear()
    with pytest.raises(RuntimeError):
        res("a").zip(res("b", True)).run(lambda v: v)
    assert log == ["+a", "-a"]
    log.clear()
    assert res("c").flat_map(lambda _: res("x", True)).or_else(res("d")).map(str.upper).run(lambda v: v) == "D"
    assert log == ["+c", "-c", "+d", "-d"]
    log.clear()
    shared = layers.service(res("s"), "s")
    assert shared.zip(shared).run(lambda v: v) == ("s", "s")
    assert log == ["+s", "-s"]
    env = layers.Environment(1).append("x")
    assert layers.assemble(lambda i, s: s * (i + 1), int, str).run(lambda v: v, deps=env) == "xx"
    with pytest.raises(LookupError):
        layers.assemble(lambda f: f, float).run(lambda v: v, deps=env)
    assert layers.pure(1).first().run(lambda v: v, deps=(0, 2)) == (1, 2)


def test_loaders(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"type":"string"}')
    calls = []
    slow = loaders.cached(lambda uri: calls.append(uri) or {"const": 1})
    load = loaders.Schemes(loaders.file_loader(spark)).register("mem", slow)
    assert load("mem:x") == load("mem:x") == {"const": 1}
    assert calls == ["mem:x"]
    assert load(str(tmp_path / "a.json")) == {"type": "string"}
    with pytest.raises(loaders.LoadError):
        loaders.first_of(loaders.no_loader, loaders.mapping_loader({}))("x")
    assert loaders.standard(spark)("http://json-schema.org/draft-07/schema#")["$id"].endswith("schema#")
    assert loaders.resolve_relative("http://x/a/b", "../c") == "http://x/c"


def test_a_dead_writer_leaves_the_table(spark, tmp_path, monkeypatch):
    """A writer that stops before its version is published; other errors are no conflicts."""
    from streamcontract.sources import tables

    t = Table(spark, str(tmp_path / "t"), "a int").create()
    t.append(spark.createDataFrame([(1,)], "a int"))

    def die(*_):
        raise KeyboardInterrupt

    for name in ("write", "publish"):
        with monkeypatch.context() as m:
            m.setattr(tables.Versions, name, die)
            with pytest.raises(KeyboardInterrupt):
                t.append(spark.createDataFrame([(2,)], "a int"))
        assert [r.a for r in t.read().collect()] == [1]
    t.append(spark.createDataFrame([(3,)], "a int"))
    assert sorted(r.a for r in t.read().collect()) == [1, 3]
    (tmp_path / "f").write_text("a file")
    with pytest.raises(Exception) as other:
        tables.Versions(spark, str(tmp_path / "f")).publish(1, "x")
    assert not isinstance(other.value, ConflictError)
