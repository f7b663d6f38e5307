"""Records, files and the data source."""

import io
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from tempolog.engine import Engine
from tempolog.functions import decode
from tempolog.functions import time as tm
from tempolog.model import LogError
from tempolog.operators import select
from tempolog.sources import records as r
from tempolog.sources.datasource import register
from tempolog.sources.rosbag import MAGIC, read_bag
from tempolog.sources.sqlite import read_db3

PLAIN = {"library": "", "use_chunking": False, "repeat_schemas": False, "repeat_channels": False, "statistics": False, "summary_offsets": False}


def log(messages, options=None, schema=True, extra=None):
    b = io.BytesIO()
    w = r.Writer(b, r.WriteOptions(**(options or {})))
    if schema:
        w.add_schema("Example", "c", bytes([4, 5, 6]), 1)
    w.add_channel(1 if schema else 0, "example", "a", {"foo": "bar"}, 1)
    for m in messages:
        w.write(1, *m)
    if extra:
        extra(w)
    w.finish()
    return b.getvalue()


def test_one_message_checksums():
    """Checksums of the format's published conformance case (fixed values)."""
    data = log([(10, 2, 1, bytes([1, 2, 3]))], PLAIN)
    found = [(op, r.decode(op, body)) for op, _, _, body in r.scan(data)]
    assert [r.NAMES[op] for op, _ in found] == ["header", "schema", "channel", "message", "data_end", "footer"]
    assert found[-2][1]["data_section_crc"] == 4213219615
    assert found[-1][1]["summary_crc"] == 1875167664


@pytest.mark.parametrize("compression", ["", "lz4", "zstd"])
@pytest.mark.parametrize("chunked", [True, False])
def test_round_trip(compression, chunked):
    sent = [(i, t, t + 1, b"x" * i) for i, t in enumerate([0, 2, 1, 3, 3, 5, 4, 7, 8, 9])]
    data = log(sent, {"compression": compression, "use_chunking": chunked, "chunk_size": 60})
    got = [r.decode(op, body) for op, _, _, body in r.scan(data) if op == r.MESSAGE]
    assert [(m["sequence"], m["log_time"], m["publish_time"], m["data"]) for m in got] == sent
    s = r.read_summary(io.BytesIO(data), len(data))
    assert s.statistics["message_count"] == 10 and s.statistics["message_end_time"] == 9
    assert s.proves_complete == chunked


def test_definitions_conflict():
    w = r.Writer(io.BytesIO())
    assert w.add_schema("a", "b", b"c") == w.add_schema("a", "b", b"c") == 1
    with pytest.raises(LogError):
        w.add_schema("a", "b", b"d", 1)
    with pytest.raises(LogError):
        w.add_schema("a", "b", b"d", 0)
    with pytest.raises(LogError):
        w.write(7, 0, 0, 0, b"")


def test_padding_and_unknown_records_are_ignored():
    raw = r.content(r.CHANNEL, {"id": 1, "schema_id": 0, "topic": "t", "message_encoding": "", "metadata": {}})
    assert r.decode(r.CHANNEL, raw + b"more")["topic"] == "t"


def test_private_records():
    data = log([(0, 0, 0, b"")], {"use_chunking": False}, extra=lambda w: w.private_record(0x81, b"own"))
    assert (0x81, b"own") in [(op, bytes(body)) for op, _, _, body in r.scan(data)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("logs")
    sent = [(i, t, t, b'{"n":%d}' % i) for i, t in enumerate([0, 2, 1, 3, 3, 5, 4, 7, 8, 9])]
    extra = lambda w: (w.add_metadata("m", {"k": "v"}), w.attach("f", "text/plain", 5, 1, b"123"))
    (d / "a.tlog").write_bytes(log(sent, {"chunk_size": 60, "compression": "zstd"}, extra=extra))
    (d / "b.tlog").write_bytes(log(sent, {"use_chunking": False}, schema=False))
    return d


def test_relations(spark, folder):
    e = Engine(spark)
    a, b = str(folder / "a.tlog"), str(folder / "b.tlog")
    order = [row.sequence for row in e.messages(a).collect()]
    assert order == [0, 2, 1, 3, 4, 6, 5, 7, 8, 9]
    assert [row.sequence for row in e.messages(a, reverse=True).collect()] == order[::-1]
    assert [row.sequence for row in e.messages(a, order_by="file").collect()] == list(range(10))
    assert [row.log_time for row in e.messages(a, start=3, end=5).collect()] == [3, 3, 4]
    assert [row.log_time for row in e.messages(a, start=3, end=5, inclusive_end=True).collect()] == [3, 3, 4, 5]
    assert e.messages(a, topics=[]).count() == 0 and e.messages(a, topics=["no"]).count() == 0
    assert e.messages(a, include=["exam.*"]).count() == 10 and e.messages(a, exclude=["exam.*"]).count() == 0
    assert e.messages(a, where=lambda t: t.startswith("x")).count() == 0
    with pytest.raises(LogError):
        e.messages(a, start=5, end=3)
    assert e.messages(b).first().schema_name is None
    assert e.messages(str(folder)).count() == 20
    assert e.statistics(b).first().message_count == e.statistics(a).first().message_count == 10
    assert bytes(e.attachment(a, "f").first().data) == b"123"
    with pytest.raises(LogError):
        e.attachment(a, "g")
    assert e.metadata(a, "m").first().metadata == {"k": "v"}
    assert e.relation(a, "message_index").select(F.explode("entries")).count() == 10
    assert e.doctor(a).df.where("rule not in ('decreasing-log-time')").collect() == []
    assert {x.rule for x in e.doctor(a).df.collect()} == {"decreasing-log-time"}
    for what in ("channels", "schemas", "chunks", "attachments", "metadata"):
        assert e.listed(a, what).count() >= 1
    assert e.du(a)["topics"].first().topic == "example" and e.du(a, True)["channels"].first().bytes == sum(len(b'{"n":0}') for _ in range(10))
    assert set(e.info(a)) >= {"statistics", "compression", "overlap"}


def test_pushdown_prunes_chunks(spark, folder):
    register(spark)
    df = spark.read.format("tlog").load(str(folder / "a.tlog")).where("log_time >= 8 and topic = 'example'")
    assert sorted(x.log_time for x in df.collect()) == [8, 9]
    with pytest.raises(Exception, match="maxScanBytes"):
        spark.read.format("tlog").option("maxScanBytes", "10").load(str(folder / "a.tlog")).count()


def test_engine_writes(spark, folder, tmp_path):
    e = Engine(spark)
    a = str(folder / "a.tlog")
    e.filter(a, str(tmp_path / "out"), start=4, last_per_channel=["exam.*"])
    got = [x.log_time for x in e.messages(str(tmp_path / "out"), order_by=None).orderBy("log_time").collect()]
    assert got == [3, 4, 5, 7, 8, 9]
    e.merge([a, str(folder / "b.tlog")], str(tmp_path / "merged"), "auto")
    m = e.relation(str(tmp_path / "merged"))
    assert m.count() == 20 and m.select("channel_id", "file").where("topic = 'example'").count() == 20
    e.compress(a, str(tmp_path / "z"))
    e.decompress(a, str(tmp_path / "n"))
    assert e.messages(str(tmp_path / "n")).count() == e.messages(str(tmp_path / "z")).count() == 10
    e.add(a, str(tmp_path / "more.tlog"), metadata=("x", {"y": "z"}))
    assert {x.name for x in e.listed(str(tmp_path / "more.tlog"), "metadata").collect()} == {"m", "x"}
    assert e.messages(str(tmp_path / "more.tlog")).count() == 10


def test_recover(spark, folder, tmp_path):
    data = (folder / "a.tlog").read_bytes()
    chunks = r.read_summary(io.BytesIO(data), len(data)).chunks
    (tmp_path / "cut.tlog").write_bytes(data[: chunks[2]["chunk_offset"] + 20])
    e = Engine(spark)
    with pytest.raises(Exception):
        e.messages(str(tmp_path / "cut.tlog")).count()
    out = e.recover(str(tmp_path / "cut.tlog"), str(tmp_path / "saved"))
    assert out.exit_code == 3 and 0 < e.messages(str(tmp_path / "saved")).count() < 10


def test_cat(spark, tmp_path):
    b = io.BytesIO()
    w = r.Writer(b)
    w.add_channel(0, "/example", "json", {}, 1)
    for i in range(3):
        w.write(1, i, i + 1, i + 1, b'{"b":{"c":%d},"a":[1,null]}' % i)
    w.finish()
    (tmp_path / "j.tlog").write_bytes(b.getvalue())
    e = Engine(spark)
    p = str(tmp_path / "j.tlog")
    assert e.cat(p).df.first().value == "1970-01-01T00:00:00.000000001Z /example [] [123 34 98 34 58 123 34 99 34 58]..."
    assert e.cat(p, "ndjson").df.first().value.startswith('{"topic":"/example","sequence":0,"log_time":"1970-01-01T00:00:00.000000001Z"')
    out = e.cat(p, "csv")
    assert out.df.columns == ["log_time", "publish_time", "sequence", "a.0", "a.1", "b.c"] and out.exit_code == 0
    assert [tuple(x) for x in out.df.orderBy("sequence").collect()][1] == (2, 2, 1, "1", "", "1")


def _bag(compression="none"):
    field = lambda k, v: struct.pack("<I", len(k) + 1 + len(v)) + k + b"=" + v
    record = lambda head, body: struct.pack("<I", len(head)) + head + struct.pack("<I", len(body)) + body
    conn = record(field(b"op", b"\x07") + field(b"conn", struct.pack("<I", 0)) + field(b"topic", b"/chatter"), field(b"type", b"std_msgs/String") + field(b"message_definition", b"string data\n") + field(b"md5sum", b"x"))
    raw = conn
    for sec, text in ((1, b"hello"), (3, b"world")):
        raw += record(field(b"op", b"\x02") + field(b"conn", struct.pack("<I", 0)) + field(b"time", struct.pack("<II", sec, sec + 1)), struct.pack("<I", len(text)) + text)
    import bz2

    packed = bz2.compress(raw) if compression == "bz2" else raw
    return MAGIC + record(field(b"op", b"\x05") + field(b"compression", compression.encode()) + field(b"size", struct.pack("<I", len(raw))), packed)


@pytest.mark.parametrize("compression", ["none", "bz2"])
def test_bag(spark, tmp_path, compression):
    rows = list(read_bag(_bag(compression)))
    assert [(x["sequence"], x["log_time"]) for x in rows] == [(0, 1_000_000_002), (1, 3_000_000_004)]
    (tmp_path / "x.bag").write_bytes(_bag(compression))
    e = Engine(spark)
    e.convert(str(tmp_path / "x.bag"), str(tmp_path / "out"))
    assert [x.json for x in e.decoded(str(tmp_path / "out")).orderBy("log_time").collect()] == ['{"data": "hello"}', '{"data": "world"}']


def test_db3(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "x.db3")
    db.executescript(
        "create table topics(id integer, name text, type text, serialization_format text); create table messages(id integer, topic_id integer, timestamp integer, data blob);"
        "create table message_definitions(id integer, topic_type text, encoding text, encoded_message_definition text);"
        "insert into topics values (1, '/a', 'std_msgs/msg/UInt32', 'cdr'); insert into message_definitions values (1, 'std_msgs/msg/UInt32', 'ros2msg', 'uint32 data');"
    )
    for i, t in ((1, 20), (2, 10), (3, 20)):
        db.execute("insert into messages values (?, 1, ?, ?)", (i, t, b"\x00\x01\x00\x00" + struct.pack("<I", i)))
    db.commit()
    assert [(x["sequence"], x["log_time"]) for x in read_db3(str(tmp_path / "x.db3"))] == [(0, 10), (1, 20), (2, 20)]
    e = Engine(spark)
    e.convert(str(tmp_path / "x.db3"), str(tmp_path / "out"))
    assert [x.json for x in e.decoded(str(tmp_path / "out")).orderBy("log_time", "sequence").collect()] == ['{"data": 2}', '{"data": 1}', '{"data": 3}']


DEFINITION = """# comment
std_msgs/Header header
int32 MAX=5
float64[] xs
uint8[3] ys
Point p
string name
================
MSG: std_msgs/Header
uint32 seq
time stamp
string frame_id
================
MSG: geo/Point
float32 x
bool ok
"""


def test_ros_decoders():
    types = decode.parse_definition("geo/Thing", DEFINITION)
    value = {"header": {"seq": 1, "stamp": {"sec": 2, "nsec": 3}, "frame_id": "f"}, "xs": [1.5, 2.5], "ys": [1, 2, 3], "p": {"x": 0.5, "ok": True}, "name": "n"}
    raw = decode.Ros1Encoder(types, "geo/Thing")(value)
    assert decode.decoder_for("ros1", "ros1msg", "geo/Thing", DEFINITION.encode())(raw) == value
    two = "float64 a\nuint8 b\nfloat64 c\nstring<=5 s\nint16[<=4] q\n"
    types = decode.parse_definition("pkg/msg/T", two)
    value = {"a": 1.0, "b": 2, "c": 3.0, "s": "hé", "q": [1, -2]}
    assert decode.decoder_for("cdr", "ros2msg", "pkg/msg/T", two.encode())(decode.CdrEncoder(types, "pkg/msg/T")(value)) == value
    assert decode.decoder_for("cdr", "ros2msg", "std_msgs/msg/Empty", b"")(b"\0\1\0\0\0") == {}
    with pytest.raises(decode.DecoderNotFound):
        decode.decoder_for("cbor", "", "", b"")


def test_protobuf():
    pb = pytest.importorskip("google.protobuf.descriptor_pb2")
    files = pb.FileDescriptorSet()
    f = files.file.add(name="t.proto", package="t", syntax="proto3")
    m = f.message_type.add(name="M")
    m.field.add(name="n", number=1, type=5, label=1)
    assert decode.decoder_for("protobuf", "protobuf", "t.M", files.SerializeToString())(b"\x08\x07") == {"n": 7}


def test_times():
    assert tm.parse_time("123") == 123 and tm.parse_time("1970-01-01T00:00:01.5Z") == 1_500_000_000 and tm.parse_time("1970-01-01T01:00:00+01:00") == 0
    for bad in ("x", "1969-12-31T23:59:59Z"):
        with pytest.raises(LogError):
            tm.parse_time(bad)
    assert select.bound_nanos("7", 8, 9) == 7 and select.bound_nanos(None, 8, 9) == 8 and select.bound_nanos(None, None, 9) == 9_000_000_000


def test_stream_of_growing_files(spark, tmp_path):
    from tempolog.streaming import live

    d = tmp_path / "live"
    d.mkdir()
    sent = [(i, t, t, b"{}") for i, t in enumerate([0, 2, 1, 3, 3, 5, 4, 7, 8, 9])]
    full = log(sent, {"chunk_size": 60})
    chunks = r.read_summary(io.BytesIO(full), len(full)).chunks
    (d / "a.tlog").write_bytes(full[: chunks[2]["chunk_offset"] + 20])
    q = live.read(spark, str(d)).writeStream.format("memory").queryName("grown").start()
    try:
        q.processAllAvailable()
        first = spark.table("grown").count()
        (d / "a.tlog").write_bytes(full)
        q.processAllAvailable()
        got = sorted(x.sequence for x in spark.table("grown").collect())
    finally:
        q.stop()
    assert 0 < first < 10 and got == list(range(10))


def test_commands(spark, folder, tmp_path, capsys):
    from tempolog.__main__ import parser, run

    e, a = Engine(spark), str(folder / "a.tlog")

    def do(*args):
        code = run(parser().parse_args(list(args)), e)
        return code, capsys.readouterr().out

    assert do("list", "channels", a) == (0, "id\tschema_id\ttopic\tmessage_encoding\tmetadata\n1\t1\texample\ta\t{\"foo\":\"bar\"}\n")
    code, out = do("cat", a, "--start-nsecs", "3", "--end", "5", "--topics", "example")
    assert code == 0 and [line.split()[0][-4:] for line in out.splitlines()] == ["003Z", "003Z", "004Z"]
    assert do("filter", a, "-o", str(tmp_path / "f"), "-y", "exam.*", "--end-nsecs", "3")[0] == 0
    assert e.messages(str(tmp_path / "f")).count() == 3
    assert do("get", "metadata", a, "--name", "m")[1] == '{"k":"v"}\n'
    assert do("doctor", a)[0] == 0 and do("doctor", a, "--strict-message-order")[0] == 1
    assert "# statistics" in do("info", a)[1] and "# topics" in do("du", a)[1]
    assert do("add", "metadata", a, "-o", str(tmp_path / "g.tlog"), "--name", "q", "--key", "x=y=z")[0] == 0
    assert do("get", "metadata", str(tmp_path / "g.tlog"), "--name", "q")[1] == '{"x":"y=z"}\n'
    with pytest.raises(LogError, match="'m'"):  # a name of metadata records that comes twice
        do("merge", a, a, "-o", str(tmp_path / "h"), "--coalesce-channels", "force")
    assert do("merge", a, a, "-o", str(tmp_path / "h"), "--coalesce-channels", "force", "--allow-duplicate-metadata")[0] == 0
    assert do("filter", a, "-o", str(tmp_path / "i"), "--exclude-metadata", "--exclude-attachments")[0] == 0 and e.relation(str(tmp_path / "i"), "metadata").count() == 0
    assert do("recover", a, "-o", str(tmp_path / "j"))[0] == 0
    assert all(w in do("completion", s)[1] for s in ("bash", "zsh", "fish") for w in ("merge", "allow-duplicate-metadata"))
    with pytest.raises(LogError):
        do("cat", a, "--start-nsecs", "5", "--end-nsecs", "3")


def test_point_clouds(spark, tmp_path):
    from tempolog.sources import pointcloud

    (tmp_path / "p.csv").write_text("t,x,y\n1,1.5,2\n1,0.5,3\n2,7,8\n")
    got = pointcloud.messages(spark, str(tmp_path / "p.csv"), "t").orderBy("log_time").collect()
    assert [bytes(r.data).decode() for r in got] == ['{"points":[{"x":0.5,"y":3.0},{"x":1.5,"y":2.0}]}', '{"points":[{"x":7.0,"y":8.0}]}']


def test_sorted_release(spark, tmp_path):
    from tempolog.streaming import live

    rows = [("a", t, i) for i, t in enumerate([5, 3, 9, 1, 20])]
    spark.createDataFrame(rows, "topic string, log_time long, sequence long").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("topic string, log_time long, sequence long").parquet(str(tmp_path / "in"))
    q = live.sorted_release(s, 10).writeStream.format("memory").queryName("released").outputMode("append").start()
    try:
        q.processAllAvailable()
        assert sorted(r.log_time for r in spark.table("released").collect()) == [1, 3, 5, 9]
    finally:
        q.stop()
