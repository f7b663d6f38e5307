"""Chunks and their indexes from messages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import MESSAGE_OVERHEAD

CHUNK_BYTES = 1 << 20


def greedy_chunks(messages: DataFrame, target: int = CHUNK_BYTES, order: tuple[str, ...] = ("log_time", "sequence"), by: str | None = None) -> DataFrame:
    """``messages`` with ``partition``, ``chunk`` (in its partition) and ``msg_offset``: a chunk closes once its size exceeds ``target``.

    A running size that starts anew can't be a window sum, so each sorted range is walked once, batch by batch.  With ``by``
    each value of that column is a log of its own, chunked from 0.
    """
    rows = messages.drop("chunk", "msg_offset")
    rows = rows.repartition(by).sortWithinPartitions(by, *order) if by else rows.repartitionByRange(order[0]).sortWithinPartitions(*order)
    schema = rows.withColumns({"partition": F.lit(0), "chunk": F.lit(0).cast("long"), "msg_offset": F.lit(0).cast("long")}).schema

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, chunk, size, now = TaskContext.get().partitionId(), 0, 0, None
        for batch in batches:
            chunks, offsets = [], []
            of = batch.column(by).to_pylist() if by else [None] * batch.num_rows
            for n, own in zip(pa.compute.binary_length(batch.column("data")).to_pylist(), of):
                if own != now:
                    now, chunk, size = own, 0, 0
                if size > target:
                    chunk, size = chunk + 1, 0
                chunks.append(chunk)
                offsets.append(size)
                size += MESSAGE_OVERHEAD + (n or 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(chunks, pa.int64()), pa.array(offsets, pa.int64())], [*batch.schema.names, "partition", "chunk", "msg_offset"])

    import pyarrow.compute  # noqa: F401

    return rows.mapInArrow(walk, schema)


def chunk_index(messages: DataFrame) -> DataFrame:
    """``chunks`` of uncompressed messages that have a chunk and an offset."""
    size = F.octet_length("data") + MESSAGE_OVERHEAD
    return messages.groupBy("file", "chunk_offset").agg(
        F.min("log_time").alias("start_time"), F.max("log_time").alias("end_time"), F.lit("").alias("compression"),
        F.sum(size).alias("compressed_size"), F.sum(size).alias("uncompressed_size"), F.count("*").alias("message_count"), F.array_sort(F.collect_set("channel_id")).alias("channel_ids"),
    )


def message_index(messages: DataFrame) -> DataFrame:
    """Per chunk and channel the (time, offset) list; a chunk's size bounds it."""
    entries = F.array_sort(F.collect_list(F.struct("log_time", "msg_offset")))
    return messages.groupBy("file", "chunk_offset", "channel_id").agg(entries.alias("entries"))
