"""Typed reading and writing, flight recordings, amended files, file forms of text outputs."""

import io
import json
import struct

import pytest

from tempolog.engine import Engine
from tempolog.functions import decode
from tempolog.model import LogError
from tempolog.sources import records as r
from tempolog.sources.ulog import MAGIC, read_ulog
from tests.test_rewrites import META, SENT, content, make

DEFINITION = "uint64 big\nfloat64[] xs\nstring name\nPoint p\ntime at\n================\nMSG: geo/Point\nfloat32 x\nbool ok\n"
VALUE = {"big": 2**63 + 5, "xs": [1.5, float("inf")], "name": "é", "p": {"x": 0.5, "ok": True}, "at": {"sec": 4, "nsec": 5}}


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark)


def test_typed_ros(engine, tmp_path):
    types = decode.parse_definition("geo/Thing", DEFINITION)
    b = io.BytesIO()
    w = r.Writer(b)
    s = w.add_schema("geo/Thing", "ros1msg", DEFINITION.encode())
    c = w.add_channel(s, "/thing", "ros1", {})
    for i in range(3):
        w.write(c, i, i, i, decode.Ros1Encoder(types, "geo/Thing")(VALUE | {"name": f"n{i}"}))
    w.finish()
    (tmp_path / "a.tlog").write_bytes(b.getvalue())
    p = str(tmp_path / "a.tlog")
    rows = engine.read_ros1(p, "/thing", start=1).collect()
    assert [x.value.name for x in rows] == ["n1", "n2"]
    v = rows[0].value
    assert int(v.big) == 2**63 + 5 and v.xs == [1.5, float("inf")] and (v.p.x, v.p.ok) == (0.5, True) and (v["at"].sec, v["at"].nsec) == (4, 5)
    with pytest.raises(LogError, match="encoded as ros1"):
        engine.read_ros2(p, "/thing")
    with pytest.raises(LogError, match="no schema"):
        engine.typed(p, "/none")


@pytest.mark.parametrize("kind", [("ros1", "ros1msg"), ("cdr", "ros2msg"), ("json", "jsonschema")])
def test_typed_writing(engine, spark, tmp_path, kind):
    text = "int32 n\nstring name\nfloat64[] xs\n"
    rows = spark.createDataFrame([(i, (i, f"é{i}", [i / 2, 1.0])) for i in range(5)], "log_time long, value struct<n:int,name:string,xs:array<double>>")
    engine.write_typed(rows, str(tmp_path / "out"), "/t", *kind, "pkg/T", text.encode())
    got = engine.typed(str(tmp_path / "out"), "/t")
    if kind[0] == "json":
        assert sorted((x.log_time, json.loads(x.json)) for x in got.collect()) == [(i, {"n": i, "name": f"é{i}", "xs": [i / 2, 1.0]}) for i in range(5)]
    else:
        assert sorted((x.log_time, x.value.n, x.value.name, x.value.xs) for x in got.collect()) == [(i, i, f"é{i}", [i / 2, 1.0]) for i in range(5)]


def test_protobuf_both_ways():
    pb = pytest.importorskip("google.protobuf.descriptor_pb2")
    files = pb.FileDescriptorSet()
    f = files.file.add(name="t.proto", package="t", syntax="proto3")
    f.message_type.add(name="M").field.add(name="n", number=1, type=5, label=1)
    args = ("protobuf", "protobuf", "t.M", files.SerializeToString())
    assert decode.decoder_for(*args)(decode.encoder_for(*args)({"n": 7})) == {"n": 7}


def ulog():
    rec = lambda kind, body: struct.pack("<Hc", len(body), kind) + body
    out = MAGIC + b"\x01" + struct.pack("<Q", 0)
    out += rec(b"F", b"point:float x;float y;") + rec(b"F", b"pos:uint64_t timestamp;point p;int16_t[2] a;char[4] tag;uint8_t[3] _padding0;")
    out += rec(b"A", struct.pack("<BH", 0, 3) + b"pos") + rec(b"A", struct.pack("<BH", 1, 4) + b"pos")
    for i, t in ((3, 20), (4, 10), (3, 30)):
        out += rec(b"D", struct.pack("<H", i) + struct.pack("<Qff2h4s", t, 0.5, float("nan"), -1, 2, b"ab\0\0"))
    return out + rec(b"L", struct.pack("<BQ", 54, 25) + b"hello") + rec(b"I", b"\x00") + b"\x20"


def test_flight_recordings(engine, tmp_path):
    rows = list(read_ulog(ulog()))
    assert [(x["topic"], x["sequence"], x["log_time"]) for x in rows] == [("pos", 0, 20_000), ("pos/1", 0, 10_000), ("pos", 1, 30_000), ("log_message", 0, 25_000)]
    assert json.loads(rows[0]["data"]) == {"timestamp": 20, "p": {"x": 0.5, "y": None}, "a": [-1, 2], "tag": "ab"}
    (tmp_path / "x.ulg").write_bytes(ulog())
    engine.convert(str(tmp_path / "x.ulg"), str(tmp_path / "out"))
    assert [x.topic for x in engine.relation(str(tmp_path / "out")).orderBy("log_time").collect()] == ["pos/1", "pos", "log_message", "pos"]
    with pytest.raises(LogError):
        list(read_ulog(b"nothing"))


@pytest.mark.parametrize("options", [{}, {"summary_offsets": False}, {"repeat_schemas": False, "repeat_channels": False}, {"data_crc": False}, {"use_chunking": False, "statistics": False, "repeat_schemas": False, "repeat_channels": False, "summary_offsets": False, "attachment_index": False, "metadata_index": False}])
def test_amended_files(engine, tmp_path, options):
    (tmp_path / "a.tlog").write_bytes(make(SENT, metadata=META, options=options))
    p, q, z = (str(tmp_path / f"{n}.tlog") for n in "aqz")
    before = content(engine, p)
    engine.add(p, q, metadata=("more", {"x": "y"}))
    engine.add(q, z, attachment={"name": "new", "media_type": "t", "log_time": 1, "create_time": 2, "data": b"d"})
    after = content(engine, z)
    assert after["messages"] == before["messages"]
    assert after["attachments"] == sorted([*before["attachments"], ("new", "t", 1, 2, b"d")]) and after["metadata"] == sorted([*before["metadata"], ("more", (("x", "y"),))])
    data = (tmp_path / "z.tlog").read_bytes()
    s = r.read_summary(io.BytesIO(data), len(data))
    old = r.read_summary(io.BytesIO(make(SENT, options=options)), len(make(SENT, options=options)))
    if old and old.statistics:
        assert s.statistics == old.statistics | {"attachment_count": 2, "metadata_count": 2}
    whole = [(op, r.decode(op, body)) for op, _, _, body in r.scan(data) if op == r.DATA_END][0][1]["data_section_crc"]
    end = next(at for op, c, at, _ in r.scan(data) if op == r.DATA_END)
    import zlib

    assert whole in (0, zlib.crc32(data[:end])) and (whole != 0) == options.get("data_crc", True)
    assert not [x for x in engine.doctor(z).df.collect() if x.severity == "error" and x.rule not in ("schema-not-in-summary", "channel-not-in-summary", "statistics-channel-not-in-summary")]
