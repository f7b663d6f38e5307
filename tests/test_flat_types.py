"""Compiled codecs of flat ROS types against the general ones."""

import math
import random
import struct

import pytest

from tempolog.engine import Engine
from tempolog.functions import decode
from tempolog.model import LogError

TYPES = ["bool", "byte", "char", "int8", "uint8", "int16", "uint16", "int32", "uint32", "int64", "uint64", "float32", "float64", "string", "uint8[]", "float64[]", "int16[3]", "bool[2]", "uint64[]", "float32[1]"]


def value(rnd, kind):
    base, _, size = kind.partition("[")
    if size:
        return [value(rnd, base) for _ in range(int(size[:-1]) if size != "]" else rnd.randrange(4))]
    if base == "bool":
        return rnd.random() < 0.5
    if base == "string":
        return rnd.choice(["", "a", "é—x", "abcdefg"])
    code = decode.BASIC[base]
    return struct.unpack("<" + code, struct.pack("<" + code, rnd.random() * 9))[0] if code in "fd" else rnd.randrange(100)


@pytest.mark.parametrize("kind", [("ros1", "ros1msg"), ("cdr", "ros2msg")])
def test_flat_codecs_equal_the_general_ones(kind):
    rnd = random.Random(5)
    for _ in range(400):
        kinds = [rnd.choice(TYPES) for _ in range(rnd.randrange(1, 8))]
        args = (*kind, "p/T", "".join(f"{k} f{i}\n" for i, k in enumerate(kinds)).encode())
        v = {f"f{i}": value(rnd, k) for i, k in enumerate(kinds)}
        raw = decode.encoder_for(*args)(v)
        fields, encode = decode.flat_encoder(*args)
        assert encode(*[x.encode() if isinstance(x, str) else x for x in v.values()]) == raw
        names, read = decode.flat_decoder(*args)
        assert dict(zip(names, read(raw))) == decode.decoder_for(*args)(raw) == v
        for cut in range(len(raw)):
            try:
                want = tuple(decode.decoder_for(*args)(raw[:cut]).values())
            except LogError:
                with pytest.raises(LogError):
                    read(raw[:cut])
            else:
                assert read(raw[:cut]) == want
        if kind[0] == "cdr":
            for head in (0, 6, 7, 8, 10):
                other = bytes((0, head, 0, 0)) + raw[4:]
                try:
                    want = tuple(decode.decoder_for(*args)(other).values())
                except (LogError, MemoryError, OverflowError):
                    continue
                assert repr(read(other)) == repr(want)
    assert decode.flat_decoder(*kind, "p/T", b"p/U x\n===\nMSG: p/U\nint8 y\n") is None


@pytest.mark.parametrize("kind", [("ros1", "ros1msg"), ("cdr", "ros2msg")])
def test_numbers_that_json_has_no_form_of(spark, tmp_path, kind):
    """They went through JSON text and could not be written."""
    e = Engine(spark)
    rows = spark.createDataFrame([(1, (float("nan"), 2**32 - 1, [float("inf")])), (2, (0.5, 7, []))], "log_time long, value struct<x:double,n:long,xs:array<double>>")
    e.write_typed(rows, str(tmp_path / "o"), "/t", *kind, "p/T", b"float64 x\nuint32 n\nfloat64[] xs\n")
    a, b = e.typed(str(tmp_path / "o"), "/t").collect()
    assert math.isnan(a.value.x) and (a.value.n, a.value.xs) == (2**32 - 1, [float("inf")]) and (b.value.x, b.value.n, b.value.xs) == (0.5, 7, [])
    assert '"n":7' in b.json


def test_typed_keeps_only_wanted_columns(spark, tmp_path):
    e = Engine(spark)
    rows = spark.createDataFrame([(1, (3,)), (2, (4,))], "log_time long, value struct<n:int>")
    e.write_typed(rows, str(tmp_path / "o"), "/t", "cdr", "ros2msg", "p/T", b"int32 n\n")
    got = e.typed(str(tmp_path / "o"), "/t", columns=["log_time"], order_by=None)
    assert got.columns == ["log_time", "value", "json"] and sorted((x.log_time, x.value.n) for x in got.collect()) == [(1, 3), (2, 4)]
    assert [x.log_time for x in e.typed(str(tmp_path / "o"), "/t", columns=["log_time"]).collect()] == [1, 2]
