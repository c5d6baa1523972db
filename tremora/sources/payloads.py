"""Encoded readings: decode with quarantine, and encode."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremora.schemas import SENSOR_FIELDS

PACKAGE = "tremora.wire"
# Name, number and wire type of the fields of one encoded reading.
READING_WIRE = [
    ("sensor_id", 1, "string"),
    ("collect_timestamp", 2, "int64"),
    ("longitude", 3, "double"),
    ("latitude", 4, "double"),
    ("depth", 5, "int32"),
    ("seismic_amplitude", 6, "float"),
    ("frequency", 7, "int32"),
    ("phase_type", 8, "string"),
    ("data_quality", 9, "int32"),
    ("network_status", 10, "int32"),
]
# The same for one encoded aggregate.
AGGREGATE_WIRE = [
    ("sensor_id", 1, "string"),
    ("window_start_ts", 2, "int64"),
    ("window_end_ts", 3, "int64"),
    ("avg_amplitude", 4, "float"),
    ("max_amplitude", 5, "float"),
    ("min_amplitude", 6, "float"),
    ("p_phase_count", 7, "int32"),
    ("s_phase_count", 8, "int32"),
    ("n_phase_count", 9, "int32"),
]
ARROW_TYPES = {
    "string": pa.string(),
    "int64": pa.int64(),
    "int32": pa.int32(),
    "double": pa.float64(),
    "float": pa.float32(),
}


@lru_cache(maxsize=None)
def message_class(kind: str):
    """The message class, built once per Python worker from the field lists above."""
    try:
        from google.protobuf import descriptor_pb2, descriptor_pool, message_factory
    except ImportError as missing:
        raise RuntimeError("decoding payloads needs the protobuf Python package") from missing

    fields = {"Reading": READING_WIRE, "Aggregate": AGGREGATE_WIRE}[kind]
    file = descriptor_pb2.FileDescriptorProto(
        name=f"{kind}.proto", package=PACKAGE, syntax="proto3"
    )
    message = file.message_type.add(name=kind)
    proto = descriptor_pb2.FieldDescriptorProto
    for name, number, wire in fields:
        message.field.add(
            name=name,
            number=number,
            type=getattr(proto, f"TYPE_{wire.upper()}"),
            label=proto.LABEL_OPTIONAL,
        )
    pool = descriptor_pool.DescriptorPool()
    pool.Add(file)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName(f"{PACKAGE}.{kind}"))


def decode_payloads(payloads: DataFrame) -> DataFrame:
    """Turn ``payload`` into reading columns plus ``decode_error`` (NULL when it decoded).

    A payload that does not decode keeps its row and its bytes (``bad_payload``), with NULL
    readings; it stops neither the job nor its neighbours. Absent fields decode to 0 or "".
    Other columns pass through.
    """
    others = [f for f in payloads.schema.fields if f.name != "payload"]
    schema = T.StructType(
        [
            *others,
            *SENSOR_FIELDS,
            T.StructField("decode_error", T.StringType()),
            T.StructField("bad_payload", T.BinaryType()),
        ]
    )
    passed = [f.name for f in others]
    names = [*passed, *(name for name, _, _ in READING_WIRE), "decode_error", "bad_payload"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encoded = batch.column("payload").cast(pa.large_binary())
            regular, columns = decode_regular(encoded)
            errors = pa.nulls(len(regular), pa.string())
            if not regular.all():
                other = np.flatnonzero(~regular)
                parsed = parse_each(encoded.take(pa.array(other)))
                columns = [*columns, pa.nulls(int(regular.sum()), pa.string())]
                order = np.empty(len(regular), np.int64)
                order[np.flatnonzero(regular)] = np.arange(regular.sum())
                order[other] = regular.sum() + np.arange(len(other))
                *columns, errors = [
                    pa.concat_arrays(pair).take(pa.array(order)) for pair in zip(columns, parsed)
                ]
            kept = pc.if_else(errors.is_valid(), encoded.cast(pa.binary()), pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in passed), *columns, errors, kept], names=names
            )

    return payloads.mapInArrow(decode, schema)


def parse_each(payloads: pa.LargeBinaryArray) -> list[pa.Array]:
    """Reading columns and errors of payloads parsed one by one, by the message class."""
    from google.protobuf.message import DecodeError

    reading = message_class("Reading")()
    rows, errors = [], []
    for payload in payloads.to_pylist():
        try:
            if payload is None:
                raise DecodeError("no payload")
            reading.Clear()
            reading.MergeFromString(payload)
            rows.append([getattr(reading, name) for name, _, _ in READING_WIRE])
            errors.append(None)
        except DecodeError as error:
            rows.append([None] * len(READING_WIRE))
            errors.append(str(error) or "not decodable")
    columns = [pa.array(c, ARROW_TYPES[w]) for c, (_, _, w) in zip(zip(*rows), READING_WIRE)]
    return [*columns, pa.array(errors, pa.string())]


def decode_regular(payloads: pa.LargeBinaryArray) -> tuple[np.ndarray, list[pa.Array]]:
    """Decode a whole batch at once, as far as payloads are regular.

    Regular is what encoders write: known fields in ascending order, each at most once,
    text in ASCII. Returns which payloads are, and the reading columns of those; all
    others are left to parse_each, which decides about every irregular byte.
    """
    _, offsets, values = payloads.buffers()
    bounds = np.frombuffer(offsets, np.int64)[payloads.offset :][: len(payloads) + 1]
    data = np.frombuffer(values, np.uint8) if values else np.zeros(0, np.uint8)
    data = np.append(data, np.uint8(0))  # a readable place behind the last byte
    at, end = bounds[:-1].copy(), bounds[1:]
    ok = payloads.is_valid().to_numpy(zero_copy_only=False).copy()

    def varint(start: np.ndarray, stop: np.ndarray):
        value, good = np.zeros(len(start), np.uint64), np.ones(len(start), bool)
        place, unfinished = start.copy(), np.ones(len(start), bool)
        for shift in range(0, 70, 7):
            if not unfinished.any():
                break
            good &= ~unfinished | (place < stop)
            unfinished &= good
            byte = data[np.where(unfinished, place, 0)].astype(np.uint64)
            if shift == 63:
                good &= ~unfinished | (byte <= 1)
            bits = (byte & np.uint64(0x7F)) << np.uint64(shift)
            value |= np.where(unfinished, bits, np.uint64(0))
            place += unfinished
            unfinished &= byte >= 0x80
        return value, place, good & ~unfinished

    found = []
    for _, number, wire in READING_WIRE:
        tag = number << 3 | {"double": 1, "string": 2, "float": 5}.get(wire, 0)
        rows = np.flatnonzero(ok & (at < end))
        rows = rows[data[at[rows]] == tag]
        start, stop = at[rows] + 1, end[rows]
        if wire in ("double", "float"):
            width = 8 if wire == "double" else 4
            good = start + width <= stop
            after, content = start + width, start
        else:
            content, after, good = varint(start, stop)
        if wire == "string":
            size, begin = content.astype(np.int64), after
            good &= (size >= 0) & (size <= stop - begin)
            content = np.column_stack([begin, np.where(good, size, 0)])
            after = begin + content[:, 1]
        ok[rows[~good]] = False
        at[rows[good]] = after[good]
        found.append((wire, rows, content))
    ok &= at == end

    columns = []
    for wire, rows, content in found:
        chosen = ok[rows]
        rows, content = rows[chosen], content[chosen]
        if wire == "string":
            spans = np.zeros((len(ok), 2), np.int64)
            spans[rows] = content
            text = _gather(data, spans)
            ok &= ~text[1]
            columns.append((wire, spans))
            continue
        if wire in ("double", "float"):
            width = 8 if wire == "double" else 4
            raw = data[content[:, None] + np.arange(width)]
            numbers = np.ascontiguousarray(raw).view(f"<f{width}").ravel()
        elif wire == "int32":
            numbers = content.astype(np.uint32).view(np.int32)
        else:
            numbers = content.view(np.int64)
        full = np.zeros(len(ok), numbers.dtype)
        full[rows] = numbers
        columns.append((wire, full))

    def finish(wire: str, values: np.ndarray) -> pa.Array:
        if wire != "string":
            return pa.array(values[ok], ARROW_TYPES[wire])
        spans = values[ok]
        text = _gather(data, spans)[0]
        ends = np.append(0, np.cumsum(spans[:, 1])).astype(np.int32)
        return pa.StringArray.from_buffers(len(spans), pa.py_buffer(ends), pa.py_buffer(text))

    return ok, [finish(wire, values) for wire, values in columns]


def _gather(data: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the (begin, length) spans one after the other, and which are not ASCII."""
    length = spans[:, 1]
    before = np.cumsum(length) - length
    span_of = np.repeat(np.arange(len(spans)), length)
    text = data[np.arange(len(span_of)) - before[span_of] + spans[span_of, 0]]
    foreign = np.zeros(len(spans), bool)
    foreign[span_of[text >= 0x80]] = True
    return text, foreign


def split_decoded(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad). To use both, write ``decoded`` first so the payloads decode once."""
    good = decoded.where(F.col("decode_error").isNull()).drop("decode_error", "bad_payload")
    bad = decoded.where(F.col("decode_error").isNotNull())
    return good, bad.drop(*[f.name for f in SENSOR_FIELDS])


def encode_payloads(rows: DataFrame, kind: str = "Reading") -> DataFrame:
    """Encode readings (or aggregates) into ``payload``; other columns pass through."""
    wire = {"Reading": READING_WIRE, "Aggregate": AGGREGATE_WIRE}[kind]
    names = [name for name, _, _ in wire]
    others = [f for f in rows.schema.fields if f.name not in names]
    passed = [f.name for f in others]
    schema = T.StructType([*others, T.StructField("payload", T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls = message_class(kind)
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in names]
            encoded = [
                cls(**{n: v for n, v in zip(names, values) if v is not None}).SerializeToString()
                for values in zip(*columns)
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in passed), pa.array(encoded, pa.binary())],
                names=[*passed, "payload"],
            )

    return rows.mapInArrow(encode, schema)
