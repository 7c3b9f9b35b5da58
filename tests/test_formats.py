"""Segment files and Avro: round trips, errors, compatibility and evolution by the fixtures."""

import datetime as dt
import decimal
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.sources import avro, seglog

records = st.lists(st.tuples(st.none() | st.binary(max_size=20), st.binary(max_size=40)), max_size=30)


@given(st.integers(-(2**63), 2**63 - 1))
def test_varint_round_trip(n):
    out = bytearray()
    seglog.put_i64(n, out)
    assert seglog.get_i64(out, 0) == (n, len(out))


@given(records)
def test_records_round_trip(rs):
    data = seglog.encode_records(rs)
    assert seglog.decode_records(data, len(rs)) == rs
    assert seglog.decode_records(data + b"\xff", len(rs)) == rs  # what follows isn't looked at


@given(st.lists(st.tuples(st.integers(1, 9), st.integers(100, 110), records), max_size=4))
@settings(max_examples=40)
def test_object_round_trip(parts):
    w = seglog.ObjectWriter()
    for t, s, rs in parts:
        w.add(t, s, rs, 1_000)
    data = w.finish()
    segs = seglog.read_footer(data)
    assert [(s.topic_id, s.schema_id, s.record_count) for s in segs] == [(t, s, len(r)) for t, s, r in parts]
    assert [seglog.read_segment(data, s) for s in segs] == [r for _, _, r in parts]


def test_object_errors():
    w = seglog.ObjectWriter()
    seg = w.add(1, 100, [(b"k", b"v"), (None, b"w"), (b"", b"")], 5)
    data = w.finish()
    broken = bytes([data[0] ^ 1]) + data[1:]
    for bad, what in ((b"123", "small"), (data[:-1] + b"X", "magic"), (b"\0\0\0\xff" + seglog.MAGIC, "longer")):
        with pytest.raises(ValueError, match=what):
            seglog.read_footer(bad)
    with pytest.raises(ValueError, match="check"):
        seglog.read_segment(broken, seg)
    assert seglog.decode_records(seglog.encode_records([(None, b"a"), (b"", b"b")])) == [(None, b"a"), (b"", b"b")]


def test_seglog_source(spark, tmp_path):
    seglog.register(spark)
    rows = [(t, 100 + t % 2, 1_000 * t, None if k % 3 == 0 else f"k{k}".encode(), f"v{t}-{k}".encode()) for t in (1, 2, 3) for k in range(20)]
    df = spark.createDataFrame(rows, "topic_id long, schema_id long, ingest_us long, key binary, value binary").coalesce(2)
    df.write.format("seglog").mode("append").save(str(tmp_path / "log"))
    back = spark.read.format("seglog").load(str(tmp_path / "log"))
    assert sorted((r["topic_id"], bytes(r["value"])) for r in back.collect()) == sorted((r[0], r[4]) for r in rows)
    assert back.where("topic_id = 2").count() == 20 and back.where("topic_id = 2 AND position < 5").count() >= 5
    two, three = (spark.read.format("seglog").option("topic_id", t).load(str(tmp_path / "log")) for t in (2, 3))
    assert two.count() == 20 and two.unionByName(three.where("position >= 0")).select("topic_id").distinct().count() == 2
    assert back.where("topic_id = 1").unionByName(back.where("topic_id = 2")).count() == 40  # two scans of one load
    assert back.where("key IS NULL").count() == sum(r[3] is None for r in rows)


ALL = {
    "type": "record", "name": "All", "fields": [
        {"name": "b", "type": "boolean"}, {"name": "i", "type": "int"}, {"name": "l", "type": ["null", "long"]}, {"name": "f", "type": "float"}, {"name": "d", "type": "double"}, {"name": "y", "type": "bytes"},
        {"name": "s", "type": ["string", "null"]}, {"name": "e", "type": {"type": "enum", "name": "E", "symbols": ["A", "B"]}}, {"name": "x", "type": {"type": "fixed", "name": "X", "size": 3}},
        {"name": "a", "type": {"type": "array", "items": ["null", "int"]}}, {"name": "m", "type": {"type": "map", "values": "long"}}, {"name": "r", "type": {"type": "record", "name": "R", "fields": [{"name": "v", "type": "int"}]}},
        {"name": "dec", "type": {"type": "bytes", "logicalType": "decimal", "precision": 10, "scale": 2}}, {"name": "day", "type": {"type": "int", "logicalType": "date"}}, {"name": "ts", "type": {"type": "long", "logicalType": "local-timestamp-micros"}},
        {"name": "du", "type": {"type": "fixed", "name": "D", "size": 12, "logicalType": "duration"}},
    ],
}
ROW = {
    "b": True, "i": -5, "l": None, "f": 0.5, "d": -2.25, "y": b"\0\1", "s": "é", "e": "B", "x": b"abc", "a": [1, None, 3], "m": {"k": 7}, "r": {"v": 9}, "dec": decimal.Decimal("-12.34"), "day": dt.date(2024, 2, 29),
    "ts": dt.datetime(2024, 1, 1, 1, 2, 3, 4), "du": {"months": 1, "days": 2, "millis": 3},
}


def plain(row):
    return {k: dict(v) if k == "m" else v for k, v in row.items()}


def test_datum_round_trip():
    node = avro.parse(json.dumps(ALL))
    out = bytearray()
    avro.encode(node, ROW, out)
    got, at = avro.reader(node)(bytes(out), 0)
    assert plain(got) == ROW and at == len(out) and avro.skipper(node)(bytes(out), 0) == at
    for cut in range(len(out)):
        with pytest.raises(ValueError):
            avro.reader(node)(bytes(out[:cut]), 0)


def test_columns_round_trip_and_pruning(spark):
    schema = json.dumps(ALL)
    df = spark.createDataFrame([tuple(ROW.values())] * 3, avro.spark_type(avro.parse(schema)))
    coded = avro.encode_column(df, schema, "datum").select("datum")
    back = avro.decode_column(coded, "datum", schema).drop("datum").collect()
    assert back == df.collect()
    some = avro.decode_column(coded, "datum", schema, ["s", "dec"])
    assert some.columns == ["datum", "s", "dec"] and some.first()["dec"] == ROW["dec"]
    bad = spark.createDataFrame([(b"",), (None,)], "datum binary")
    assert avro.decode_column(bad, "datum", schema, ["i"], strict=False).select("i").collect() == [(None,), (None,)]


@pytest.mark.parametrize("codec", ["null", "deflate"])
def test_container_round_trip(codec):
    schema = json.dumps(ALL)
    data = avro.write_container([ROW] * 5, schema, codec, block=2)
    got, rows = avro.read_container(data)
    assert got == schema and [plain(r) for r in rows] == [ROW] * 5
    with pytest.raises(ValueError, match="sync"):
        avro.read_container(data[:-1] + bytes([data[-1] ^ 1]))


def test_stream_and_containers(spark, tmp_path):
    schema = '{"type":"record","name":"U","fields":[{"name":"id","type":"long"},{"name":"name","type":"string"}]}'
    out = bytearray()
    for i in range(3):
        avro.encode(avro.parse(schema), {"id": i, "name": f"n{i}"}, out)
    assert [r["id"] for r in avro.read_stream(bytes(out), schema)] == [0, 1, 2]
    with pytest.raises(ValueError):
        avro.read_stream(b"", schema)
    (tmp_path / "a.avro").write_bytes(avro.write_container([{"id": 1, "name": "x"}], schema))
    assert [tuple(r) for r in avro.containers(spark, str(tmp_path), schema).collect()] == [(1, "x")]


def test_schema_errors():
    for bad in ([], ["null", ["int", "string"]], {"type": "record", "name": "A", "fields": [{"name": "a", "type": ["null", "A"]}]}, "nothing"):
        with pytest.raises(avro.SchemaError):
            avro.parse(bad)


def test_rabin_and_canonical_form():
    assert avro.rabin(avro.parsing_form("int").encode()).hex() == "8f5c393f1ad57572"  # the specification's example
    assert avro.parsing_form({"type": "record", "name": "R", "namespace": "n", "doc": "x", "fields": [{"name": "f", "type": {"type": "int"}, "default": 1}]}) == '{"name":"n.R","type":"record","fields":[{"name":"f","type":"int"}]}'
    assert avro.canonical({"b": 1, "a": {"doc": "x", "z": [2, 1]}}) == '{"a":{"z":[2,1]},"b":1}'
    assert avro.schema_hash('{"a": 1, "doc": 2}') == avro.schema_hash({"a": 1})


def rec(*fields):
    return {"type": "record", "name": "T", "fields": [dict(zip(("name", "type"), f[:2]), **(f[2] if len(f) > 2 else {})) for f in fields]}


@pytest.mark.parametrize(
    ("new", "old", "ok"),
    [
        ("long", "int", True), ("double", "float", True), ("double", "long", False), ("float", "int", False), ("int", "long", False), (["null", "string"], "string", True), ("string", ["null", "string"], True),
        (["null", "string"], ["null", "long"], False), ({"type": "array", "items": "long"}, {"type": "array", "items": "int"}, True), ({"type": "map", "values": "int"}, {"type": "map", "values": "long"}, False),
        ({"type": "enum", "name": "S", "symbols": ["P", "C", "X"]}, {"type": "enum", "name": "S", "symbols": ["P", "C"]}, True), ({"type": "enum", "name": "S", "symbols": ["P"]}, {"type": "enum", "name": "S", "symbols": ["P", "C"]}, False),
        (rec(("a", "long"), ("b", "string", {"default": "USD"})), rec(("a", "long")), True), (rec(("a", "long"), ("b", "string")), rec(("a", "long")), False), (rec(("a", "long"), ("c", ["null", "string"])), rec(("a", "int"), ("b", "string")), True),
        (rec(("n", "long", {"aliases": ["o"]})), rec(("o", "long")), True), (rec(("n", "string", {"aliases": ["o"]})), rec(("o", "long")), False), ({"type": "fixed", "name": "F", "size": 2}, {"type": "fixed", "name": "F", "size": 3}, False),
    ],
)
def test_compatibility(new, old, ok):
    assert avro.compatible(new, old) is ok


def test_wide_union_is_an_error_in_the_new_schema_only():
    with pytest.raises(avro.SchemaError):
        avro.compatible(["null", "string", "long"], "string")
    assert avro.compatible(["null", "string"], ["null", "string"])


def test_evolution_and_projection(spark):
    old = rec(("parcel", "int"), ("colour", "string"))
    new = rec(("box", "long", {"aliases": ["parcel"]}), ("height", ["null", "string"], {"default": None})) | {"shop.deletions": ["colour"]}
    assert avro.evolution(new, old, "shop") == [("RENAME", "parcel", "box"), ("DELETE", "colour"), ("WIDEN", "box", "long"), ("ADD", "height", ["null", "string"])]
    df = spark.createDataFrame([(1, "x")], "parcel int, colour string")
    got = df.select(*avro.projection(json.dumps(new), json.dumps(old)))
    assert got.dtypes == [("box", "bigint"), ("height", "string")] and got.first() == (1, None)


def test_wide_unions_decode_to_json():
    node = avro.parse(["string", "null", "long", {"type": "array", "items": "int"}, {"type": "record", "name": "P", "fields": [{"name": "x", "type": "boolean"}]}])
    for value, text in (("a", '"a"'), (None, None), (5, "5"), ([1, 2], "[1,2]"), ({"x": True}, '{"x":true}')):
        out = bytearray()
        avro.encode(node, value, out)
        assert avro.reader(node)(bytes(out), 0) == (text, len(out)) and avro.skipper(node)(bytes(out), 0) == len(out)
    with pytest.raises(ValueError, match="branch"):
        avro.reader(node)(b"\x0e", 0)
    with pytest.raises(ValueError, match="branch"):
        avro.encode(node, 2.5, bytearray())


@pytest.mark.parametrize("text", ["0", "-12.340", "123456789012345678901234567890.5", "99"])
def test_big_decimals(text):
    node = avro.parse({"type": "bytes", "logicalType": "big-decimal"})
    out = bytearray()
    avro.encode(node, text, out)
    assert avro.reader(node)(bytes(out), 0) == (text, len(out)) and avro.skipper(node)(bytes(out), 0) == len(out)
    with pytest.raises(ValueError):
        avro.reader(node)(bytes([out[0] + 2]) + bytes(out[1:]) + b"\0", 0)


def test_nanoseconds_are_cut_to_microseconds():
    node, out = avro.parse({"type": "long", "logicalType": "timestamp-nanos"}), bytearray()
    seglog.put_i64(1_700_000_000_123_456_789, out)
    assert avro.reader(node)(bytes(out), 0)[0] == dt.datetime(2023, 11, 14, 22, 13, 20, 123456)


def logical(kind, name, **more):
    return {"type": kind, "logicalType": name, **more}


@pytest.mark.parametrize(
    ("new", "old", "ok"),
    [
        (logical("bytes", "decimal", precision=10, scale=4), logical("bytes", "decimal", precision=10, scale=2), False), (logical("bytes", "decimal", precision=10, scale=2), logical("bytes", "decimal", precision=10, scale=2), True),
        (logical("long", "timestamp-micros"), logical("long", "timestamp-millis"), False), (logical("long", "timestamp-micros"), "long", False), ("long", logical("int", "date"), False), (logical("string", "decimal"), "string", True),
        (rec(("a", {"type": "fixed", "name": "H", "size": 4}), ("b", "H")), rec(("a", {"type": "fixed", "name": "H", "size": 4}), ("b", {"type": "fixed", "name": "H", "size": 4})), True),
    ],
)
def test_compatibility_of_logical_and_named_types(new, old, ok):
    assert avro.compatible(new, old) is ok


def test_schema_of_nodes_is_the_schema():
    for s in (ALL, ["null", "string"], {"type": "map", "values": ["long", "null"]}, logical("bytes", "decimal", precision=9, scale=2)):
        again = avro.to_json(avro.parse(json.dumps(s)))
        assert avro.parse(json.dumps(again)) == avro.parse(json.dumps(s)) and avro.expanded(again) == avro.expanded(s)


def test_field_ids_are_depth_first():
    s = rec(("a", "long"), ("r", {"type": "record", "name": "In", "fields": [{"name": "x", "type": "int"}, {"name": "l", "type": {"type": "array", "items": "string"}}]}), ("m", {"type": "map", "values": ["null", "int"]}), ("z", ["null", "string"]))
    t = avro.with_field_ids(json.dumps(s))
    assert [f.metadata["field_id"] for f in t] == [1, 2, 6, 9]
    assert [f.metadata for f in t["r"].dataType] == [{"field_id": 3}, {"field_id": 4, "element_id": 5}] and t["m"].metadata == {"field_id": 6, "key_id": 7, "value_id": 8}


def test_values_by_type():
    out = bytearray()
    avro.encode(avro.parse(json.dumps(ALL)), ROW, out)
    v = avro.read_value(bytes(out), json.dumps(ALL))
    assert v.get("i").as_int() == -5 and v.get("i").as_str() is None and v.get("l").is_null() and v.get(0).as_bool() is True and v.get("no") is None
    assert v.get("a").get(2).as_int() == 3 and v.get("a").get(9) is None and v.get("m").get("k").as_int() == 7 and v.get("r").get("v").as_int() == 9 and [x.as_int() for x in v.get("a").as_list()] == [1, None, 3]


def test_containers_of_several_schemas(spark, tmp_path):
    old, new = rec(("id", "int"), ("old", "string")), rec(("id", "long"), ("name", "string", {"aliases": ["old"]}), ("note", ["null", "string"], {"default": None}))
    for k, codec in enumerate(("null", "deflate", "bzip2", "xz", "zstandard")):
        (tmp_path / f"{k}.avro").write_bytes(avro.write_container([{"id": k, "old": f"n{k}"}], json.dumps(old), codec))
    (tmp_path / "n.avro").write_bytes(avro.write_container([{"id": 9, "name": "x", "note": "y"}], json.dumps(new)))
    got = sorted(tuple(r) for r in avro.containers(spark, str(tmp_path), json.dumps(new)).collect())
    assert got == [(k, f"n{k}", None) for k in range(5)] + [(9, "x", "y")]
    with pytest.raises(avro.SchemaError):
        avro.resolved(json.dumps(rec(("id", "int"))), json.dumps(new))


def test_json_by_any_schema(spark):
    schema = json.dumps(rec(("id", "long"), ("tags", {"type": "array", "items": "string"}, {"default": []}), ("u", ["null", "string", "long"], {"default": None}), ("p", ["null", {"type": "record", "name": "P", "fields": [{"name": "x", "type": "double"}]}], {"default": None})))
    texts = ['{"id": 1}', '{"id": 2, "tags": ["a"], "u": 7, "p": {"x": 1.5}}', '{"tags": []}', '{"id": 1, "zz": 2}', '{"id": "x"}', "nonsense", '{"id": 3, "u": "s"}']
    df = avro.ingested(spark.createDataFrame([(t,) for t in texts], "j string"), "j", schema)
    got = avro.decode_column(df, "datum", schema).collect()
    assert [r["status"] == "OK" for r in got] == [True, True, False, False, False, False, True]
    assert (got[1]["tags"], got[1]["u"], got[1]["p"]["x"], got[6]["u"], got[0]["tags"]) == (["a"], "7", 1.5, '"s"', []) and "zz" in got[3]["status"] and "id" in got[2]["status"]


def test_host_types():
    import dataclasses
    import enum
    import typing

    from tidelog.sources import hosttypes as h

    @dataclasses.dataclass
    class Place:
        city: str

    class Kind(enum.Enum):
        A = "a-value"
        B = "b-value"

    @dataclasses.dataclass
    class Parcel:
        code: typing.Annotated[str, h.NonNull]
        weight: float
        n: h.Int32
        tags: list[str]
        counts: dict[str, int]
        kind: Kind
        place: Place
        note: str | None = None

    Parcel.__annotations__.update(place=Place, kind=Kind)
    hints = typing.get_type_hints
    h.typing.get_type_hints = lambda c, include_extras=False: c.__annotations__
    try:
        s = h.schema_of(Parcel, renames={"id": "code"}, deletions=("old",))
        assert s["fields"][0] == {"name": "code", "type": "string", "aliases": ["id"]} and s["fields"][2]["type"] == ["null", "int"] and s["evolution.deletions"] == ["old"]
        p = Parcel("c", 1.5, 3, ["x"], {"a": 1}, Kind.B, Place("Bern"))
        assert h.from_bytes(Parcel, h.to_bytes(p)) == p
        for bad in ({"renames": {"id": "nothing"}}, {"deletions": ("code",)}, {"renames": {"id": "code"}, "deletions": ("id",)}):
            with pytest.raises(avro.SchemaError):
                h.schema_of(Parcel, **bad)
    finally:
        h.typing.get_type_hints = hints


def test_object_store(tmp_path):
    s = seglog.ObjectStore(str(tmp_path))
    s.put("a/b.bin", b"0123456789")
    s.put("a/c.bin", b"")
    assert s.get("a/b.bin") == b"0123456789" and s.get_range("a/b.bin", 2, 3) == b"234" and s.size("a/b.bin") == 10 and s.list("a/") == ["a/b.bin", "a/c.bin"] and s.list("x") == []
    for start, n in ((8, 3), (-1, 2), (11, 0)):
        with pytest.raises(ValueError, match="range"):
            s.get_range("a/b.bin", start, n)
    s.delete("a/c.bin")
    assert s.list() == ["a/b.bin"]


def test_registry(spark, tmp_path):
    from tidelog.operators.registry import Registry, RegistryError

    r = Registry(str(tmp_path))
    t, u = r.create_topic("parcels"), r.create_topic("letters")
    v1, v2, bad = rec(("a", "int")), rec(("a", "long"), ("b", ["null", "string"], {"default": None})), rec(("a", "string"))
    assert r.check(t, bad) and r.register(t, v1, 1) == 100 == r.register(t, json.dumps(v1 | {"doc": "x"}), 2) == r.register(u, v1, 3)
    assert r.register(t, v2, 4) == 101 and r.of_topic(t) == [101, 100] and not r.check(t, bad) and r.by_hash(avro.schema_hash(v2)) == 101 and r.get(101) == v2 and r.get(7) is None
    for topic, schema in ((t, bad), (99, v1)):
        with pytest.raises(RegistryError):
            r.register(topic, schema)
    with pytest.raises(avro.SchemaError):
        r.register(u, rec(("a", ["null", "int", "string"])))
    assert Registry(str(tmp_path)).doc == r.doc and len(r.doc["schemas"]) == 2  # what was refused left no trace
    with pytest.raises(RegistryError, match="exists"):
        r.create_topic("letters")
    assert sorted((x["topic_id"], x["schema_id"]) for x in r.table(spark).collect()) == [(t, 100), (t, 101), (u, 100)]
    assert r.delete_topic(t) and not r.delete_topic(t) and r.of_topic(t) == [] and r.get(101) == v2


def test_table_schema_moves_on(spark, tmp_path):
    from tidelog.operators.tablesink import SinkTable

    t = SinkTable(spark, str(tmp_path))
    old, new = json.dumps(rec(("a", "int"))), json.dumps(rec(("a", "long"), ("b", ["null", "string"], {"default": None})))
    meta = "CAST(1 AS LONG) AS _offset, 1 AS _partition_id, timestamp_micros(5) AS _ingest_time, X'00' AS _key"
    assert t.ensure("x", old) and not t.ensure("x", old)
    assert t.append("c1", spark.sql(f"SELECT 7 AS a, {meta}"), [1]) and not t.append("c1", spark.sql(f"SELECT 8 AS a, {meta}"), [1])
    assert not t.ensure("x", new) and t.append("c2", spark.sql(f"SELECT CAST(9 AS LONG) AS a, 'z' AS b, {meta}"), [2])
    assert sorted((r["a"], r["b"]) for r in t.read().collect()) == [(7, None), (9, "z")]
    with pytest.raises(avro.SchemaError):
        t.ensure("x", json.dumps(rec(("a", "string"))))
