"""Texts: sizes, previews, JSON of messages, flattening, redaction."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .time import rfc3339


def human_bytes(n: Column, units: tuple[str, ...] = ("B", "kB", "MB", "GB", "TB", "PB")) -> Column:
    """Base 1000, two decimals, rounded before the unit is chosen; what the last unit is too small for stays in it."""
    out = None
    for i, unit in enumerate(units):
        value = F.round(n.cast("double") / F.lit(1000.0**i) * 100) / 100
        shown = F.concat(F.format_string("%.2f", value), F.lit(f" {unit}"))
        last = i == len(units) - 1
        out = (F.when(value < 1000, shown) if out is None else out.otherwise(shown) if last else out.when(value < 1000, shown))
    return out


def preview(data: Column, n: int = 10) -> Column:
    """The first bytes as decimals: ``[1 2 3]...``."""
    first = F.substring(data, 1, n)
    hexed = F.hex(first)
    each = F.transform(F.sequence(F.lit(1), F.octet_length(first)), lambda i: F.conv(F.substring(hexed, i * 2 - 1, F.lit(2)), 16, 10))
    shown = F.when(F.octet_length(data) == 0, F.lit("[]")).otherwise(F.concat(F.lit("["), F.array_join(each, " "), F.lit("]")))
    return F.concat(shown, F.when(F.octet_length(data) > n, F.lit("...")).otherwise(F.lit("")))


def text_line(messages: DataFrame, time: Column | None = None) -> DataFrame:
    """``time topic [schema] [b0 b1 ...]...``."""
    time = rfc3339(F.col("log_time")) if time is None else time
    return messages.select(F.concat_ws(" ", time, F.col("topic"), F.concat(F.lit("["), F.coalesce("schema_name", F.lit("")), F.lit("]")), preview(F.col("data"))).alias("value"))


def ndjson_line(messages: DataFrame, time=rfc3339) -> DataFrame:
    """One JSON object a line; the payload is JSON and goes in as it is, times are strings."""
    q = lambda c: F.to_json(F.array(c))
    inner = lambda c: F.regexp_replace(q(c), r"^\[|\]$", "")
    return messages.select(
        F.concat(
            F.lit('{"topic":'), inner(F.col("topic")), F.lit(',"sequence":'), F.col("sequence").cast("string"), F.lit(',"log_time":"'), time(F.col("log_time")),
            F.lit('","publish_time":"'), time(F.col("publish_time")), F.lit('","data":'), F.col("data").cast("string"), F.lit("}"),
        ).alias("value")
    )


def flatten(value, prefix: str = "") -> Iterator[tuple[str, str]]:
    """Keys in order, ``a.b`` and ``a.0``; null is empty; a top-level scalar or array is ``data``."""
    if isinstance(value, dict):
        for k in sorted(value):
            yield from flatten(value[k], f"{prefix}.{k}" if prefix else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from flatten(v, f"{prefix or 'data'}.{i}")
    else:
        yield prefix or "data", "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def flattened(messages: DataFrame, data: str = "data") -> DataFrame:
    """``messages`` with ``fields``, a map of the flattened JSON payload; null where it is no JSON.

    Nesting of any depth is beyond the built-in functions, so Arrow batches go to Python.
    """
    schema = messages.withColumn("fields", F.lit(None).cast("map<string,string>")).schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw in b.column(data).cast(pa.binary()).to_pylist():
                try:
                    out.append(None if raw is None else list(flatten(json.loads(raw))))
                except ValueError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.map_(pa.string(), pa.string()))], [*b.schema.names, "fields"])

    return messages.mapInArrow(each, schema)


def flat_object(data: Column) -> Column:
    """A flat JSON object as a map, on the JVM."""
    return F.from_json(data.cast("string"), "map<string,string>")


def json_number(value: float) -> str:
    """Not a number and the infinities as strings."""
    if math.isnan(value):
        return '"NaN"'
    return ('"Infinity"' if value > 0 else '"-Infinity"') if math.isinf(value) else json.dumps(value)


def redact_url(url: Column) -> Column:
    """Without credentials, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@", "$1")


def key_value(text: Column) -> Column:
    """``key=value`` with the first ``=``."""
    return F.struct(F.substring_index(text, "=", 1).alias("key"), F.regexp_extract(text, r"^[^=]*=(.*)$", 1).alias("value"))


def table(rows: list[list[str]]) -> str:
    """Columns padded to their widest cell, with a tab between."""
    if not rows:
        return ""
    widths = [max(len(r[i]) for r in rows if i < len(r)) for i in range(max(map(len, rows)))]
    return "\n".join("\t".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in rows)
