"""Rewrites keep every record; orders and rules over several files; reads by offset."""

import io

import pytest
from pyspark.sql import functions as F

from tempolog.engine import Engine
from tempolog.model import LogError
from tempolog.operators import integrity, listing, order
from tempolog.sources import datasource, files
from tempolog.sources import records as r

META = {"k": "v"}


def make(messages, extra=True, metadata=META, name="a", options=None):
    """A log of ``(channel, sequence, log time)`` with an attachment and a metadata record."""
    b = io.BytesIO()
    w = r.Writer(b, r.WriteOptions(profile="ros1", chunk_size=100, **(options or {})))
    w.add_schema("Example", "jsonschema", b'{"type":"object"}', 1)
    for c, topic in ((1, "/one"), (2, "/two"), (3, "/one")):
        w.add_channel(1, topic, "json", metadata, c) if c < 3 else w.add_channel(1, topic, "json", {**metadata, "other": "x"}, c)
    for c, seq, t in messages:
        w.write(c, seq, t, t + 1, b'{"n":%d}' % seq)
    if extra:
        w.attach(f"att {name}", "text/plain", 5, 6, b"attached " + name.encode())
        w.add_metadata(f"meta {name}", {"from": name})
    w.finish()
    return b.getvalue()


SENT = [(i % 3 + 1, i, t) for i, t in enumerate([0, 2, 1, 3, 3, 5, 4, 7, 8, 9])]


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark)


@pytest.fixture
def one(tmp_path):
    (tmp_path / "a.tlog").write_bytes(make(SENT))
    return str(tmp_path / "a.tlog")


def content(e, path):
    """Everything that a rewrite must keep."""
    rows = e.with_schema_data(e.relation(path), path)
    return {
        "messages": sorted((x.topic, x.sequence, x.log_time, x.publish_time, bytes(x.data), x.schema_name, bytes(x.schema_data), tuple(sorted(x.channel_metadata.items()))) for x in rows.collect()),
        "attachments": sorted((x.name, x.media_type, x.log_time, x.create_time, bytes(x.data)) for x in e.relation(path, "attachments").collect()),
        "metadata": sorted((x.name, tuple(sorted(x.metadata.items()))) for x in e.relation(path, "metadata").collect()),
        "profile": e.profile(path),
    }


@pytest.mark.parametrize("rewrite", ["filter", "sort", "compress", "decompress"])
@pytest.mark.parametrize("indexed", [True, False])
def test_rewrites_keep_every_record(engine, tmp_path, rewrite, indexed):
    options = {} if indexed else {"use_chunking": False, "statistics": False}
    (tmp_path / "a.tlog").write_bytes(make(SENT, options=options))
    path, out = str(tmp_path / "a.tlog"), str(tmp_path / "out")
    getattr(engine, rewrite)(path, out)
    assert content(engine, out) == content(engine, path) and len(content(engine, out)["messages"]) == 10
    assert len(content(engine, out)["attachments"]) == len(content(engine, out)["metadata"]) == 1
    none = str(tmp_path / "none")
    getattr(engine, rewrite)(path, none, include_attachments=False, include_metadata=False)
    assert content(engine, none) == content(engine, path) | {"attachments": [], "metadata": []}


def test_attachments_stay_whatever_the_time(engine, one, tmp_path):
    engine.filter(one, str(tmp_path / "out"), include=["/two"], start=4, end=5)
    got = content(engine, str(tmp_path / "out"))
    assert [m[:3] for m in got["messages"]] == [] and len(got["attachments"]) == 1 and len(got["metadata"]) == 1


@pytest.mark.parametrize("order_by", ["log_time", "topic", "file"])
def test_orders_of_sort(engine, one, tmp_path, order_by):
    engine.sort(one, str(tmp_path / "out"), order_by=order_by)
    got = [(x.topic, x.log_time, x.sequence) for p in files.listed(str(tmp_path / "out")) for x in engine.messages(p, order_by="file").collect()]
    plain = [({1: "/one", 2: "/two", 3: "/one"}[c], t, s, c) for c, s, t in SENT]
    want = {"log_time": sorted(plain, key=lambda x: x[1]), "topic": sorted(plain, key=lambda x: (x[0], x[3], x[1])), "file": plain}[order_by]
    assert got == [x[:3] for x in want]


def test_merge_keeps_records_and_channels_apart(engine, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.tlog").write_bytes(make(SENT, name=name))
    paths = [str(tmp_path / f"{n}.tlog") for n in "ab"]
    both = [content(engine, p) for p in paths]
    for mode in ("auto", "none", "force"):
        out = str(tmp_path / mode)
        engine.merge(paths, out, mode)
        got = content(engine, out)
        assert got["attachments"] == sorted(both[0]["attachments"] + both[1]["attachments"])
        assert got["metadata"] == sorted(both[0]["metadata"] + both[1]["metadata"]) and got["profile"] == "ros1"
        if mode != "force":
            assert got["messages"] == sorted(both[0]["messages"] + both[1]["messages"])  # no made-up metadata
        assert len(got["messages"]) == 20
        most = engine.relation(out, "summary_channels").groupBy("file").count().agg(F.max("count")).first()[0]
        assert most <= {"auto": 3, "force": 2, "none": 6}[mode]
    single = str(tmp_path / "single")  # in one file, so that the counts are exact
    engine.spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for mode, n in (("auto", 3), ("force", 2), ("none", 6)):
            engine.merge(paths, single + mode, mode)
            assert engine.relation(single + mode, "summary_channels").count() == n
    finally:
        engine.spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_duplicate_metadata_names(engine, tmp_path):
    (tmp_path / "a.tlog").write_bytes(make(SENT))
    p = str(tmp_path / "a.tlog")
    with pytest.raises(LogError, match="meta a"):
        engine.merge([p, p], str(tmp_path / "x"))
    engine.merge([p, p], str(tmp_path / "y"), allow_duplicate_metadata=True)
    assert [m[0] for m in content(engine, str(tmp_path / "y"))["metadata"]] == ["meta a"]
    engine.merge([p, p], str(tmp_path / "z"), include_metadata=False)
    assert content(engine, str(tmp_path / "z"))["metadata"] == []


def tally(found):
    return {x.kind: (x.recovered, x.discarded) for x in found.df.collect() if x.recovered or x.discarded}


def test_recover(engine, tmp_path):
    whole = make(SENT)
    (tmp_path / "a.tlog").write_bytes(whole)
    p = str(tmp_path / "a.tlog")
    got = engine.recover(p, str(tmp_path / "out"))
    assert got.exit_code == 0 and not got.df.where("truncated").head(1)
    assert content(engine, str(tmp_path / "out")) | {"profile": "ros1"} == content(engine, p)
    assert tally(got)["message"] == (10, 0) and tally(got)["attachment"] == tally(got)["metadata"] == (1, 0)
    # cut inside the second chunk: what stands before is saved, and the loss is told
    second = sorted(c["chunk_offset"] for c in r.read_summary(io.BytesIO(whole), len(whole)).chunks)[1]
    (tmp_path / "cut.tlog").write_bytes(whole[: second + 30])
    got = engine.recover(str(tmp_path / "cut.tlog"), str(tmp_path / "cut"))
    assert got.exit_code == 3 and got.df.where("truncated").head(1) and any("break off" in w for w in got.warnings)
    assert 0 < len(content(engine, str(tmp_path / "cut"))["messages"]) < 10
    # a message of no channel is discarded
    b = io.BytesIO()
    w = r.Writer(b, r.WriteOptions(use_chunking=False))
    w.add_channel(0, "/a", "json", {"k": "v"}, 1)
    w.write(1, 0, 1, 1, b"{}")
    w._put(r.encode(r.MESSAGE, channel_id=9, sequence=0, log_time=1, publish_time=1, data=b""))
    w._put(r.frame(r.METADATA, b"\xff\xff\xff\xff"))
    w.finish()
    (tmp_path / "odd.tlog").write_bytes(b.getvalue())
    got = engine.recover(str(tmp_path / "odd.tlog"), str(tmp_path / "odd"))
    assert got.exit_code == 3 and tally(got)["message"] == (1, 1) and tally(got)["metadata"] == (0, 1)
    assert engine.relation(str(tmp_path / "odd")).count() == 1


def test_recover_keeps_channel_metadata(engine, one, tmp_path):
    engine.recover(one, str(tmp_path / "out"))
    assert {tuple(sorted(x.metadata.items())) for x in engine.relation(str(tmp_path / "out"), "channels").collect()} == {(("k", "v"),), (("k", "v"), ("other", "x"))}


# ---- orders


@pytest.mark.parametrize("buckets", [1, 3, 8])
def test_rank_with_hot_values_and_texts(spark, buckets):
    rows = [("hot" if i % 3 else f"it's \\{i}", 7 if i % 2 else i, i) for i in range(300)]
    df = spark.createDataFrame(rows, "topic string, t long, seq long").repartition(3)
    for keys, at in ((["topic", "t", "seq"], (0, 1, 2)), (["t", "seq"], (1, 2)), (["seq"], (2,))):
        for down in (False, True):
            want = sorted(rows, key=lambda x: tuple(x[k] for k in at), reverse=down)
            got = order.global_rank(df, keys, down, buckets=buckets).orderBy("rank").collect()
            assert [(x.topic, x.t, x.seq, x["rank"]) for x in got] == [(*x, i + 1) for i, x in enumerate(want)]
    one_bucket = order.bucketed(df, ["t", "seq"], 8).where("t = 7").select("_b").distinct().count()
    assert one_bucket >= 3  # a hot leading value is cut by what follows


@pytest.mark.parametrize("buckets", [1, 2, 8])
def test_running_max(spark, buckets):
    for rows in ([("f", 0, i, (i * 7) % 10) for i in range(10)], [(f"f{i % 3}", i // 9, i, (i * 37) % 50) for i in range(60)], [("f", 0, 0, 5)], []):
        df = spark.createDataFrame(rows, "file string, chunk_offset long, msg_offset long, log_time long")
        got = {(x.file, x.msg_offset): x.max_before for x in order.running_max_before(df, ("chunk_offset", "msg_offset"), "log_time", buckets=buckets, by="file").collect()}
        assert got == {(f, m): max((v for g, c2, m2, v in rows if g == f and (c2, m2) < (c, m)), default=None) for f, c, m, _ in rows}
        got = {(x.file, x.msg_offset): x.max_before for x in order.running_max_before(df, ("chunk_offset", "msg_offset", "file"), "log_time", buckets=buckets).collect()}
        assert got == {(f, m): max((v for g, c2, m2, v in rows if (c2, m2, g) < (c, m, f)), default=None) for f, c, m, _ in rows}


# ---- doctor


def found(engine, path, strict=False):
    return sorted({(x.severity, x.rule) for x in engine.doctor(path, strict).df.collect()})


def test_sound_files_have_no_fault(engine, tmp_path):
    (tmp_path / "a.tlog").write_bytes(make(sorted(SENT, key=lambda m: m[2])))
    (tmp_path / "b.tlog").write_bytes(make([(c, s, t - 0) for c, s, t in sorted(SENT, key=lambda m: m[2])][:5]))
    (tmp_path / "c.tlog").write_bytes(make([(1, 0, 3)]))  # one chunk
    assert found(engine, str(tmp_path)) == []
    assert engine.validate(str(tmp_path)).exit_code == 0


def broken():
    """A log for each rule, and what the rule finds."""
    enc = r.encode

    def built(fill, options=None, patch=None):
        b = io.BytesIO()
        w = r.Writer(b, r.WriteOptions(**({"chunk_size": 100, "profile": ""} | (options or {}))))
        w.add_schema("S", "jsonschema", b"{}", 1)
        w.add_channel(1, "/t", "json", {}, 1)
        fill(w)
        w.finish()
        return patch(b.getvalue()) if patch else b.getvalue()

    def some(w):
        for i in range(8):
            w.write(1, i, i + 1, i + 1, b"{}")

    def without(op):
        def patch(data):
            out = bytearray(data[:8])
            for o, _, body in r.split(memoryview(data)[8 : len(data) - 8]):
                if o != op:
                    out += r.frame(o, bytes(body))
            return bytes(out) + data[-8:]

        return patch

    def change(op, edit, times=1):
        def patch(data):
            out, left = bytearray(data[:8]), times
            for o, _, body in r.split(memoryview(data)[8 : len(data) - 8]):
                body = bytes(body)
                if o == op and left:
                    left -= 1
                    body = edit(body)
                if body is not None:
                    out += r.frame(o, body) if isinstance(body, bytes) else b"".join(body)
            return bytes(out) + data[-8:]

        return patch

    def fields(op, **new):
        return lambda body: r.content(op, r.decode(op, body) | {k: f(r.decode(op, body)[k]) for k, f in new.items()})

    E, W = "error", "warning"
    loose = {"use_chunking": False}
    yield (W, "empty-library"), built(some, {"library": ""})
    yield (W, "unknown-profile"), built(some, {"profile": "strange"})
    yield (E, "no-data-end"), built(some, None, without(r.DATA_END))
    yield (E, "no-footer"), built(some, None, without(r.FOOTER))
    yield (E, "several-statistics"), built(some, None, change(r.STATISTICS, lambda b: [r.frame(r.STATISTICS, b)] * 2))
    yield (W, "unknown-opcode"), built(lambda w: (some(w), w.flush(), w._raw(r.frame(0x7F, b"x"))))
    yield (E, "illegal-in-chunk"), built(lambda w: (some(w), w._put(enc(r.METADATA, name="m", metadata={}))))
    yield (W, "message-outside-chunk"), built(lambda w: (some(w), w.flush(), w._raw(enc(r.MESSAGE, channel_id=1, sequence=9, log_time=9, publish_time=9, data=b""))))
    yield (E, "schema-id-zero"), built(lambda w: (some(w), w._raw(enc(r.SCHEMA, id=0, name="z", encoding="e", data=b"d"))), loose)
    yield (E, "schema-data-without-encoding"), built(lambda w: (some(w), w._raw(enc(r.SCHEMA, id=4, name="z", encoding="", data=b"d"))), loose)
    yield (W, "schema-encoding-without-data"), built(lambda w: (some(w), w._raw(enc(r.SCHEMA, id=4, name="z", encoding="e", data=b""))), loose)
    yield (E, "conflicting-schema"), built(lambda w: (some(w), w._raw(enc(r.SCHEMA, id=1, name="other", encoding="e", data=b"d"))), loose)
    yield (W, "duplicate-schema"), built(lambda w: (some(w), w._raw(enc(r.SCHEMA, id=1, name="S", encoding="jsonschema", data=b"{}"))), loose)
    yield (E, "conflicting-channel"), built(lambda w: (some(w), w._raw(enc(r.CHANNEL, id=1, schema_id=1, topic="/u", message_encoding="json", metadata={}))), loose)
    yield (W, "duplicate-channel"), built(lambda w: (some(w), w._raw(enc(r.CHANNEL, id=1, schema_id=1, topic="/t", message_encoding="json", metadata={}))), loose)
    yield (E, "unknown-schema"), built(lambda w: (some(w), w._raw(enc(r.CHANNEL, id=7, schema_id=70, topic="/u", message_encoding="json", metadata={}))), loose)
    yield (E, "unknown-channel"), built(lambda w: (some(w), w._raw(enc(r.MESSAGE, channel_id=70, sequence=9, log_time=9, publish_time=9, data=b""))), loose)
    yield (E, "message-before-channel"), built(lambda w: (some(w), w._raw(enc(r.MESSAGE, channel_id=2, sequence=9, log_time=9, publish_time=9, data=b"")), w._raw(enc(r.CHANNEL, id=2, schema_id=0, topic="/u", message_encoding="json", metadata={}))), loose)
    yield (W, "decreasing-log-time"), built(lambda w: (some(w), w.write(1, 9, 2, 2, b"")))
    yield (E, "schema-only-in-summary"), built(some, None, change(r.STATISTICS, lambda b: [enc(r.SCHEMA, id=9, name="x", encoding="e", data=b"d"), r.frame(r.STATISTICS, b)]))
    yield (E, "channel-only-in-summary"), built(some, None, change(r.STATISTICS, lambda b: [enc(r.CHANNEL, id=9, schema_id=1, topic="/x", message_encoding="json", metadata={}), r.frame(r.STATISTICS, b)]))
    yield (E, "chunk-start"), built(some, None, change(r.CHUNK, fields(r.CHUNK, start_time=lambda v: v + 1)))
    yield (E, "chunk-end"), built(some, None, change(r.CHUNK, fields(r.CHUNK, end_time=lambda v: v + 1)))
    yield (E, "chunk-index-mismatch"), built(some, None, change(r.CHUNK_INDEX, fields(r.CHUNK_INDEX, uncompressed_size=lambda v: v + 1)))
    yield (E, "duplicate-chunk-index"), built(some, None, change(r.CHUNK_INDEX, lambda b: [r.frame(r.CHUNK_INDEX, b)] * 2))
    yield (E, "chunk-index-points-at-no-chunk"), built(some, None, change(r.CHUNK_INDEX, fields(r.CHUNK_INDEX, chunk_offset=lambda v: v + 1)))
    yield (E, "channel-not-in-summary"), built(some, {"repeat_channels": False, "statistics": False})
    yield (E, "schema-not-in-summary"), built(some, {"repeat_schemas": False})
    for field in ("message_count", "message_start_time", "message_end_time"):
        yield (E, f"statistics-{field.replace('_', '-')}"), built(some, None, change(r.STATISTICS, fields(r.STATISTICS, **{field: lambda v: v + 1})))
    yield (E, "statistics-channel-not-in-summary"), built(some, None, change(r.STATISTICS, fields(r.STATISTICS, channel_message_counts=lambda v: v | {44: 1})))


def test_a_broken_log_for_each_rule(engine, tmp_path):
    """All in one folder: each file has its own finding."""
    cases = list(broken())
    for i, (_, data) in enumerate(cases):
        (tmp_path / f"{i:03d}.tlog").write_bytes(data)
    (tmp_path / "zzz.tlog").write_bytes(make(sorted(SENT, key=lambda m: m[2])))
    by: dict[str, set] = {}
    for x in engine.doctor(str(tmp_path)).df.collect():
        by.setdefault(x.file.rsplit("/", 1)[-1], set()).add((x.severity, x.rule))
    missing = [(want, by.get(f"{i:03d}.tlog")) for i, (want, _) in enumerate(cases) if want not in by.get(f"{i:03d}.tlog", ())]
    assert not missing and "zzz.tlog" not in by
    late = next(i for i, (want, _) in enumerate(cases) if want[1] == "decreasing-log-time")
    assert found(engine, str(tmp_path / f"{late:03d}.tlog"), strict=True) == [("error", "decreasing-log-time")]


# ---- reads


class Counting(io.BytesIO):
    read_bytes = 0

    def read(self, n=-1):
        got = super().read(n)
        Counting.read_bytes += len(got)
        return got


def rows_of(path, monkeypatch, data, **options):
    """Rows of a relation in this process, and how many bytes were read for them."""
    monkeypatch.setattr(files, "open_random", lambda p: (Counting(data), len(data)))
    Counting.read_bytes = 0
    o = datasource.Options({"path": path, **{k: str(v) for k, v in options.items()}})
    return list(datasource.relation(path, o)), Counting.read_bytes


def big():
    b = io.BytesIO()
    w = r.Writer(b, r.WriteOptions(chunk_size=10_000, compression=""))
    c = w.add_channel(0, "/t", "json")
    for i in range(2000):
        w.write(c, i, i, i, b"x" * 200)
    w.attach("a", "t", 1, 2, b"y" * 100)
    w.add_metadata("m", {"k": "v"})
    w.finish()
    return b.getvalue()


def test_records_are_read_by_offset(monkeypatch):
    data = big()
    whole = {}
    for name in ("attachments", "metadata", "message_index"):
        got, n = rows_of("x", monkeypatch, data, relation=name)
        monkeypatch.setattr(datasource, "_by_offset", lambda *a: None)
        whole[name], all_ = rows_of("x", monkeypatch, data, relation=name)
        monkeypatch.undo()
        drop = lambda rows: [{k: v for k, v in x.items() if k != "file_pos"} for x in rows]
        assert drop(got) == drop(whole[name]) and got
        assert n < len(data) / 5 <= all_


def test_point_lookup_reads_one_chunk(engine, tmp_path, monkeypatch):
    (tmp_path / "a.tlog").write_bytes(big())
    p = str(tmp_path / "a.tlog")
    some = engine.relation(p).orderBy("sequence").collect()[777]
    got = engine.message(p, some.chunk_offset, some.msg_offset).collect()
    assert [x.sequence for x in got] == [777]
    assert engine.chunk(p, some.chunk_offset).count() == engine.relation(p).where(F.col("chunk_offset") == some.chunk_offset).count() > 1
    o = datasource.Options({"path": p})
    o.chunk_offsets = {some.chunk_offset}
    reader = datasource.LogReader.__new__(datasource.LogReader)
    reader.o = o
    assert sum(len(x.chunks) for x in reader.partitions()) == 1


@pytest.mark.parametrize("size", [100, 3000, 10**9])
def test_splits_give_each_message_once(engine, tmp_path, size):
    """Beyond ``planFiles`` files nothing is opened to plan."""
    for i in range(3):
        (tmp_path / f"{i}.tlog").write_bytes(make(SENT, options={} if i else {"use_chunking": False}))
    got = engine.relation(str(tmp_path), planFiles=0, partitionBytes=size)
    key = ["file", "sequence", "log_time", "topic", "chunk_offset", "msg_offset"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, engine.relation(str(tmp_path)).select(key).collect())) and got.count() == 30
    assert got.where("log_time >= 3 and log_time < 5 and topic = '/one'").count() == engine.relation(str(tmp_path)).where("log_time >= 3 and log_time < 5 and topic = '/one'").count()


def test_summary_by_scan(engine, one):
    for name, df in engine.summary(one).items():
        again = engine.summary(one, scan=True)[name]
        cols = [c for c in df.columns if c in again.columns and c not in ("file_pos", "message_index_offsets", "message_index_length", "metadata")]
        assert sorted(map(str, df.select(cols).collect())) == sorted(map(str, again.select(cols).collect())), name


def test_get_attachment(engine, spark):
    df = spark.createDataFrame([("many", i, b"x") for i in range(1500)] + [("one", 7, b"y")], "name string, offset long, data binary")
    assert listing.get_attachment(df, "many", 1499).count() == 1 and listing.get_attachment(df, "one").count() == 1
    for name, at in (("many", None), ("many", 5000), ("none", None), ("one", 8)):
        with pytest.raises(LogError):
            listing.get_attachment(df, name, at)


def test_file_rotation_and_level(engine, one, tmp_path):
    out = str(tmp_path / "out")
    engine.write(engine.with_schema_data(engine.relation(one), one).coalesce(1), out, order_by=None, maxFileMessages=3, compressionLevel=9)
    assert sorted(x.message_count for x in engine.relation(out, "statistics").collect()) == [1, 3, 3, 3]
    assert content(engine, out)["messages"] == content(engine, one)["messages"]
    small = str(tmp_path / "small")
    engine.write(engine.with_schema_data(engine.relation(one), one).coalesce(1), small, order_by=None, maxFileBytes=400)
    assert engine.relation(small, "statistics").count() > 1 and engine.relation(small).count() == 10


def test_limits_and_invalid_chunks(engine, tmp_path):
    data = bytearray(make(SENT, options={"compression": ""}))
    at = data.index(b'{"n":0}')
    data[at + 5] = ord("7")  # the chunk's checksum differs now
    (tmp_path / "bad.tlog").write_bytes(data)
    p = str(tmp_path / "bad.tlog")
    with pytest.raises(Exception, match="checksum"):
        engine.relation(p).count()
    assert engine.relation(p, emitInvalidChunks=True).count() == 10
    (tmp_path / "a.tlog").write_bytes(make(SENT))
    with pytest.raises(Exception, match="limit"):
        engine.relation(str(tmp_path / "a.tlog"), maxDecompressedSize=10).count()
    b = io.BytesIO()
    w = r.Writer(b, r.WriteOptions(use_chunking=False, statistics=False))
    w.add_channel(0, "/a", "json", {}, 1)
    w._raw(r.encode(r.MESSAGE, channel_id=1, sequence=0, log_time=1, publish_time=1, data=b""))
    w.write(1, 1, 2, 2, b"")
    w.finish()
    (tmp_path / "early.tlog").write_bytes(b.getvalue())
    assert engine.relation(str(tmp_path / "early.tlog")).count() == 2
    assert [x.sequence for x in engine.relation(str(tmp_path / "early.tlog"), dropUndefined=True).collect()] == [1]


def test_codecs_on_executors(engine, one, tmp_path, monkeypatch):
    (tmp_path / "own_codec.py").write_text("import zlib\nfrom tempolog.sources.records import register_codec\nregister_codec('deflate', zlib.compress, lambda b, n: zlib.decompress(b))\n")
    engine.spark.sparkContext.addPyFile(str(tmp_path / "own_codec.py"))
    out = str(tmp_path / "out")
    engine.write(engine.with_schema_data(engine.relation(one), one), out, compression="deflate", forceCompression=True, codecs="own_codec")
    assert engine.relation(out, codecs="own_codec").count() == 10
    with pytest.raises(Exception, match="unknown compression"):
        engine.relation(out).count()


def test_record_callbacks(engine, one, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    def put(name):
        def fn(rows):
            import uuid

            (seen / f"{name}-{uuid.uuid4().hex}").write_text("\n".join(str(x["file"] is not None) for x in rows))

        return fn

    engine.on_records(one, {"messages": put("m"), "channels": put("c"), "attachments": put("a")})
    count = lambda k: sum(len(f.read_text().split()) for f in seen.glob(f"{k}-*"))
    assert (count("m"), count("c"), count("a")) == (10, 3, 1)


def test_http_ranges(engine, tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    data, asked = big(), []

    class Handler(BaseHTTPRequestHandler):
        def do_HEAD(self):  # noqa: N802
            self.send_response(200)
            self.send_header("Accept-Ranges", "bytes")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()

        def do_GET(self):  # noqa: N802
            lo, hi = map(int, self.headers["Range"][6:].split("-"))
            asked.append(hi - lo + 1)
            self.send_response(206)
            self.end_headers()
            self.wfile.write(data[lo : hi + 1])

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/a.tlog"
        f = files.HttpFile(url, 1000)
        assert f.seek(-8, io.SEEK_END) and f.read() == data[-8:] and len(asked) == 1
        assert f.seek(100) == 100 and f.read(50) == data[100:150]
        assert engine.relation(url).where("log_time >= 10 and log_time < 30").count() == 20
        with pytest.raises(Exception, match="maxScanBytes"):
            engine.relation(url, maxScanBytes=1000).count()
    finally:
        server.shutdown()


def test_out_of_order_by_file(spark):
    rows = [("a", 0, i, i) for i in range(5)] + [("b", 0, i, i - 3) for i in range(5)]
    assert integrity.out_of_order(spark.createDataFrame(rows, "file string, chunk_offset long, msg_offset long, log_time long")).count() == 0
