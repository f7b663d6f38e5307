"""Recordings of other formats in bounded memory."""

import struct

import pytest

from tempolog.plans import recordings
from tempolog.sources.rosbag import _records, read_bag
from tempolog.model import LogError


def test_bags_are_streamed_in_chunks(monkeypatch):
    monkeypatch.setattr(recordings, "CHUNK_BYTES", 500)
    rows = [(f"t{i % 3}", i * 1_000_000_007, b"x" * (i % 40)) for i in range(100)]
    raw = recordings.bag(rows)
    assert len(list(_records(raw, 13))) > 5  # one chunk before
    assert [(x["topic"], x["log_time"], x["data"]) for x in read_bag(raw)] == rows

    class File:
        """Never gives all."""

        at = most = 0

        def read(self, n):
            File.most = max(File.most, n)
            self.at += n
            return raw[self.at - n : self.at]

    assert sum(1 for _ in read_bag(File())) == 100 and File.most < len(raw) / 2
    for cut in (len(raw) - 1, len(raw) - 300, 15):
        with pytest.raises((LogError, struct.error)):
            list(read_bag(raw[:cut]))


def test_files_grow_in_number_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(recordings, "FILE_MESSAGES", 100)
    df = spark.range(1000)
    assert recordings.deal(df, "id", 1000).rdd.getNumPartitions() == 10 and recordings.deal(df, "id", 50).rdd.getNumPartitions() == 3
