"""Checksums of joined pieces against those of the whole."""

import zlib

from pyspark.sql import functions as F

from tempolog.functions import checksum


def test_combined(spark):
    pieces = [b"", b"a", b"\x00", b"hello world", bytes(range(256)) * 5, b"\x00" * 70_001]
    rows = [(i, x + y, x, y) for i, (x, y) in enumerate((x, y) for x in pieces for y in pieces)]
    df = spark.createDataFrame(rows, "i int, whole binary, x binary, y binary")
    got = df.select(F.crc32("whole").alias("want"), checksum.combined(F.crc32("x"), F.crc32("y"), F.octet_length("y")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got] == [zlib.crc32(w) for _, w, _, _ in rows]


def test_long_lengths(spark):
    """Pieces joined in either order give one result, with lengths beyond what can be held."""
    c, n = F.lit(zlib.crc32(b"log")).cast("long"), F.lit(1 << 40)
    left = checksum.combined(checksum.combined(c, c, n), c, n)
    right = checksum.combined(c, checksum.combined(c, c, n), n + n)
    got = spark.range(1).select(left.alias("left"), right.alias("right")).first()
    assert got.left == got.right != zlib.crc32(b"log")


def test_nulls(spark):
    df = spark.sql("select cast(null as bigint) as n, 7L as c")
    got = df.select(checksum.combined(F.col("c"), F.col("c"), F.col("n")).alias("a"), checksum.combined(F.col("n"), F.col("c"), F.col("c")).alias("b"), checksum.combined(F.col("c"), F.col("n"), F.col("c")).alias("d")).first()
    assert tuple(got) == (None, None, None)
