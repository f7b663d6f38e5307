"""Relations of a message log, and its canonical orders.

A log is a star: ``messages`` (fact), ``channels`` and ``schemas`` (dimensions),
and the relations of its container: chunks, message index, attachments,
metadata, statistics.  Times are nanoseconds in BIGINT; a TIMESTAMP would lose
the last three digits.
"""

from __future__ import annotations

MESSAGES = (
    "file string, channel_id int, topic string, schema_id int, schema_name string, schema_encoding string, message_encoding string, "
    "sequence bigint, log_time bigint, publish_time bigint, data binary, chunk_offset bigint, msg_offset bigint"
)
CHANNELS = "file string, id int, schema_id int, topic string, message_encoding string, metadata map<string,string>"
SCHEMAS = "file string, id int, name string, encoding string, data binary"
CHUNKS = (
    "file string, chunk_offset bigint, chunk_length bigint, start_time bigint, end_time bigint, compression string, compressed_size bigint, "
    "uncompressed_size bigint, message_index_offsets map<int,bigint>, message_index_length bigint"
)
ATTACHMENTS = "file string, `offset` bigint, length bigint, log_time bigint, create_time bigint, name string, media_type string, data_size bigint, data binary"
METADATA = "file string, `offset` bigint, length bigint, name string, metadata map<string,string>"
STATISTICS = (
    "file string, message_count bigint, schema_count int, channel_count bigint, attachment_count bigint, metadata_count bigint, chunk_count bigint, "
    "message_start_time bigint, message_end_time bigint, channel_message_counts map<int,bigint>"
)
MESSAGE_INDEX = "file string, chunk_offset bigint, channel_id int, entries array<struct<log_time:bigint,msg_offset:bigint>>"

#: A total order: reverse order reverses all three.
LOG_TIME_ORDER = ("log_time", "chunk_offset", "msg_offset")
FILE_ORDER = ("chunk_offset", "msg_offset")
#: Bytes of a message record before its payload: opcode, length, channel, sequence, two times.
MESSAGE_OVERHEAD = 31
#: Channel and schema ids are 16-bit: dimensions never have more rows a file, and may be broadcast.
MAX_IDS = 65_535


class LogError(ValueError):
    """Bad arguments or a log that breaks the rules."""
