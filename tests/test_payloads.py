"""Decoding: defaults, junk and a round trip of arbitrary values."""

from __future__ import annotations

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tremora.schemas import PAYLOAD, READING
from tremora.sources.payloads import (
    READING_WIRE,
    decode_payloads,
    decode_regular,
    encode_payloads,
    message_class,
    parse_each,
    split_decoded,
)


def test_junk_does_not_stop_its_neighbours(spark):
    good = message_class("Reading")(sensor_id="sensor_1", seismic_amplitude=1.5)
    rows = [(1, good.SerializeToString()), (2, b"\xff\xff"), (3, None), (4, b"")]
    decoded = decode_payloads(spark.createDataFrame(rows, PAYLOAD))
    ok, bad = split_decoded(decoded)
    readings = {r.event_id: r for r in ok.collect()}
    assert sorted(readings) == [1, 4]
    assert readings[1].seismic_amplitude == 1.5 and readings[1].data_quality == 0
    assert readings[4].sensor_id == "" and readings[4].longitude == 0.0
    kept = {r.event_id: (r.decode_error is not None, r.bad_payload) for r in bad.collect()}
    assert kept == {2: (True, b"\xff\xff"), 3: (True, None)}
    assert ok.schema == READING


def test_aggregates_encode(spark):
    rows = [("sensor_1", 0, 1000, 15.25, 20.5, 10.0, 2, 1, 0)]
    df = spark.createDataFrame(
        rows,
        "sensor_id string, window_start_ts bigint, window_end_ts bigint, avg_amplitude double,"
        "max_amplitude float, min_amplitude float, p_phase_count bigint, s_phase_count bigint,"
        "n_phase_count bigint",
    )
    payload = bytes(encode_payloads(df, "Aggregate").first().payload)
    message = message_class("Aggregate").FromString(payload)
    assert (message.sensor_id, message.avg_amplitude, message.p_phase_count) == (
        "sensor_1",
        15.25,
        2,
    )


VALUES = {
    "string": st.text(max_size=20),
    "int64": st.integers(-(2**63), 2**63 - 1),
    "int32": st.integers(-(2**31), 2**31 - 1),
    "double": st.floats(allow_nan=False),
    "float": st.floats(width=32, allow_nan=False),
}


FIELDS = st.tuples(*[VALUES[w] for _, _, w in READING_WIRE])


def encoded(values):
    names = [name for name, _, _ in READING_WIRE]
    return message_class("Reading")(**dict(zip(names, values))).SerializeToString()


@settings(max_examples=3, deadline=None)
@given(st.lists(FIELDS, min_size=1, max_size=30))
def test_round_trip(spark, values):
    rows = [(i, *v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, READING)
    back, _ = split_decoded(decode_payloads(encode_payloads(df)))
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())


def decoded_both_ways(payloads):
    """(batch decoding completed by the parser, parser alone) as lists of rows."""
    array = pa.array(payloads, pa.large_binary())
    regular, columns = decode_regular(array)
    *parsed, errors = [c.to_pylist() for c in parse_each(array)]
    alone = list(zip(*parsed))
    fast = iter(zip(*[c.to_pylist() for c in columns]))
    errors = [e is not None for e in errors]
    return regular, [next(fast) if r else row for r, row in zip(regular, alone)], alone, errors


@settings(max_examples=300, deadline=None)
@given(
    st.lists(
        st.one_of(
            FIELDS.map(encoded),
            st.binary(max_size=30),
            # Cut off, joined (repeated fields), and with one byte changed.
            st.builds(lambda v, n: encoded(v)[:n], FIELDS, st.integers(0, 80)),
            st.builds(lambda a, b: encoded(a) + encoded(b), FIELDS, FIELDS),
            st.builds(
                lambda v, i, x: (p := bytearray(encoded(v)), p and p.__setitem__(i % len(p), x))[0],
                FIELDS,
                st.integers(0, 200),
                st.integers(0, 255),
            ).map(bytes),
        ),
        min_size=1,
        max_size=20,
    )
)
def test_batch_decoding_agrees_with_the_parser(payloads):
    regular, mixed, alone, errors = decoded_both_ways(payloads)
    assert repr(mixed) == repr(alone)  # repr: NaN equals NaN
    assert not any(r and e for r, e in zip(regular, errors))


def test_usual_payloads_are_regular():
    usual = [("sensor_0001_region_1", 1_700_000_000_000, 108.0, 34.0, 10, 20.5, 10, "P", 1, 5)]
    negative = [("sensor_1", -1, -0.5, 0.0, -5, -20.5, 0, "", 0, 0)]
    regular, mixed, alone, _ = decoded_both_ways([encoded(v) for v in usual + negative] + [None])
    assert regular.tolist() == [True, True, False] and mixed == alone
    assert mixed[:2] == usual + negative


def test_slice_of_an_array_decodes():
    rows = [encoded((f"s{i}", i, 0.0, 0.0, 0, 0.0, 0, "", 0, 0)) for i in range(5)]
    _, columns = decode_regular(pa.array(rows, pa.large_binary()).slice(2, 2))
    assert columns[0].to_pylist() == ["s2", "s3"] and columns[1].to_pylist() == [2, 3]
