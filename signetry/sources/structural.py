"""Delimited rating lines, with every line that fails set apart and its reason kept.

A batch of lines is one byte buffer. Quote bytes form a mask, its running count gives the parity of quotes
before any byte, and a comma at even parity is a delimiter. Record ends are the line offsets, so an unclosed
quote never swallows the next line. Counts and types of the fields then make each line a record or a reject.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = 4
REASONS = ("quoting", "column_count", "bad_source", "bad_weight", "bad_timestamp")
NOT_A_RECORD = "not_a_record"
NULL_WORDS = ("", "null", "na", "nan")
FIRST_SECOND, END_SECOND = 946_684_800, 1_893_456_000  # 2000 up to, not with, 2030
QUOTE, COMMA, SPACE, CR, HASH = 34, 44, 32, 13, 35

PARSED = T.StructType(
    [
        T.StructField("reason", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("weight", T.IntegerType()),
        T.StructField("timestamp", T.DoubleType()),
    ]
)


def _bytes(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all lines and the offsets of the lines in them; a null line is an empty one."""
    lines = pc.fill_null(lines.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
    data = lines.buffers()[2]
    data = np.frombuffer(data, np.uint8)[: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] :], offsets - offsets[0]


def _texts(data: np.ndarray, keep: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The kept bytes of each range [start, end), ranges being in order and apart."""
    n = len(data)
    inside = np.cumsum(np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1))[:n] > 0
    before = np.concatenate(([0], np.cumsum(keep)))
    offsets = np.concatenate(([0], np.cumsum(before[end] - before[start]))).astype(np.int64)
    raw = pa.py_buffer(np.ascontiguousarray(data[inside & keep]))
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), raw])


def parse_block(lines: pa.Array) -> dict[str, np.ndarray | pa.Array]:
    """Reasons and fields of the lines of one batch; ``good`` holds the row numbers the fields belong to."""
    data, offsets = _bytes(lines)
    size = len(data)
    start, end = offsets[:-1], offsets[1:].copy()
    rows = len(start)
    last = data[np.maximum(end - 1, 0)] if size else np.zeros(rows, np.uint8)
    end -= (end > start) & (last == CR)
    blank_byte = (data == SPACE) | ((data >= 9) & (data <= 13))
    solid = np.concatenate(([0], np.cumsum(~blank_byte)))
    first = data[np.minimum(start, max(size - 1, 0))] if size else np.zeros(rows, np.uint8)
    record = (solid[end] > solid[start]) & ~((first == HASH) & (end > start))

    # structural index: quotes with the parity of those before them, commas outside quotes
    is_quote = data == QUOTE
    count = np.concatenate(([0], np.cumsum(is_quote)))  # quotes before each byte
    quotes = np.flatnonzero(is_quote)
    line = np.searchsorted(offsets, quotes, "right") - 1
    opening = ((count[quotes] - count[start[line]]) & 1) == 0
    before = np.where(quotes > start[line], data[np.maximum(quotes - 1, 0)], COMMA) if size else quotes
    after = np.where(quotes + 1 < end[line], data[np.minimum(quotes + 1, max(size - 1, 0))], COMMA) if size else quotes
    edge = np.where(opening, before, after)
    stray = (edge != COMMA) & (edge != QUOTE)
    bad_quote = (np.bincount(line[stray], minlength=rows) > 0) | (((count[end] - count[start]) & 1) == 1)
    commas = np.flatnonzero(data == COMMA)
    comma_line = np.searchsorted(offsets, commas, "right") - 1
    outside = ((count[commas] - count[start[comma_line]]) & 1) == 0
    commas, comma_line = commas[outside], comma_line[outside]
    columns = np.bincount(comma_line, minlength=rows) + 1

    reason = np.full(rows, -1, np.int8)
    reason[columns != FIELDS] = 1
    reason[bad_quote] = 0
    reason[~record] = len(REASONS)
    good = np.flatnonzero(reason == -1)
    at = commas[reason[comma_line] == -1].reshape(-1, FIELDS - 1)

    keep = np.ones(size, bool)
    keep[quotes[opening & (quotes > start[line]) & (before == QUOTE)]] = False  # second of a doubled quote
    places = np.arange(size)
    spaces = data == SPACE
    following = np.minimum.accumulate(np.where(spaces, size, places)[::-1])[::-1] if size else places
    previous = np.maximum.accumulate(np.where(spaces, -1, places)) if size else places
    fields = []
    for k in range(FIELDS):
        a = start[good] if k == 0 else at[:, k - 1] + 1
        b = end[good] if k == FIELDS - 1 else at[:, k]
        if len(good):
            quoted = (b > a) & (data[np.minimum(a, size - 1)] == QUOTE)
            a, b = a + quoted, b - quoted
            a = np.minimum(np.append(following, size)[a], b)
            b = np.maximum(np.where(b > a, previous[np.maximum(b - 1, 0)] + 1, a), a)
        fields.append((a, b))
    source, target, weight, stamp = (_texts(data, keep, a, b) for a, b in fields)

    control = (data < 32) | (data == 127)
    if size > 1:
        control[:-1] |= (data[:-1] == 0xC2) & (data[1:] >= 0x80) & (data[1:] < 0xA0)
    if size > 2:
        control[:-2] |= (data[:-2] == 0xEF) & (data[1:-1] == 0xBF) & (data[2:] == 0xBD)
    controls = np.concatenate(([0], np.cumsum(control)))
    a, b = fields[0]
    empty = pc.is_in(pc.ascii_lower(source), value_set=pa.array(NULL_WORDS, pa.large_string())).to_numpy(zero_copy_only=False)
    bad_source = (controls[b] > controls[a]) | empty
    fits = pc.match_substring_regex(weight, r"^[+-]?0*(10|[0-9])$").to_numpy(zero_copy_only=False)
    digits = pc.match_substring_regex(stamp, r"^0*[0-9]{1,10}(\.[0-9]+)?$").to_numpy(zero_copy_only=False)
    seconds = np.zeros(len(good))
    seconds[digits] = pc.filter(stamp, pa.array(digits)).cast(pa.float64()).to_numpy(zero_copy_only=False)
    whole = np.zeros(len(good), np.int64)
    whole[digits] = pc.replace_substring_regex(pc.filter(stamp, pa.array(digits)), r"\..*$", "").cast(pa.int64()).to_numpy(zero_copy_only=False)
    in_range = digits & (whole >= FIRST_SECOND) & (whole < END_SECOND)
    found = np.full(len(good), -1, np.int8)
    for code, bad in ((4, ~in_range), (3, ~fits), (2, bad_source)):
        found[bad] = code
    reason[good] = found
    fine = found == -1
    chosen = pa.array(fine)
    return {
        "reason": reason,
        "good": good[fine],
        "source": pc.filter(source, chosen),
        "target": pc.filter(target, chosen),
        "weight": pc.replace_substring_regex(pc.filter(weight, chosen), r"^\+", "").cast(pa.int32()),
        "timestamp": pa.array(seconds[fine]),
    }


def _parsed(lines: pa.Array) -> pa.Array:
    out = parse_block(lines)
    words = pa.array([*REASONS, NOT_A_RECORD])
    codes = out["reason"].astype(np.int32)
    reason = words.take(pa.array(codes, mask=codes < 0))
    where = np.full(len(codes), -1, np.int64)
    where[out["good"]] = np.arange(len(out["good"]))
    take = pa.array(where, mask=where < 0)
    return pa.StructArray.from_arrays(
        [reason, out["source"].take(take).cast(pa.string()), out["target"].take(take).cast(pa.string()), out["weight"].take(take), out["timestamp"].take(take)],
        names=[f.name for f in PARSED],
    )


_parse_udf = F.arrow_udf(_parsed, PARSED)


def parsed_line(line: Column) -> Column:
    """Struct ``reason, source, target, weight, timestamp`` of a rating line; reason is null for a valid one.

    A null, blank or comment line is no record and has the reason ``not_a_record``.
    """
    return _parse_udf(line)


def with_parsed(lines: DataFrame, column: str = "raw_line", into: str = "parsed") -> DataFrame:
    """``lines`` with one struct column more; every other column stays in the JVM and keeps its name.

    If a column named ``into`` exists it is replaced. Repeated rows are parsed each for itself. A very long
    line is one record like any other.
    """
    return lines.withColumn(into, parsed_line(F.col(column)))


def rejects(lines: DataFrame, column: str = "raw_line") -> DataFrame:
    """The lines that fail, with ``reason``: quoting, column_count, bad_source, bad_weight or bad_timestamp, the first in this order."""
    out = with_parsed(lines, column, "__parsed").withColumn("reason", F.col("__parsed.reason"))
    return out.where(F.col("reason").isNotNull() & (F.col("reason") != NOT_A_RECORD)).drop("__parsed")


def ratings(lines: DataFrame, column: str = "raw_line", keep: tuple[str, ...] = ()) -> DataFrame:
    """The valid lines as typed ratings, with the columns of ``keep``; one that clashes becomes ``line_<name>``."""
    kept = [F.col(k).alias(f"line_{k}" if k in PARSED.names else k) for k in keep]
    out = with_parsed(lines, column, "__parsed").where(F.col("__parsed.reason").isNull())
    return out.select(*kept, *[F.col(f"__parsed.{n}").alias(n) for n in PARSED.names[1:]])
