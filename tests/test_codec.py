"""Canonical bytes of rows."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from millrace import results
from millrace.errors import LimitExceeded, MillraceError
from millrace.functions import codec

VALUES = st.one_of(st.integers(-(1 << 63), (1 << 63) - 1), st.text(max_size=20), st.binary(max_size=20))


def test_fixed_row():
    row = {"age": -2, "msg": "hi", "raw": b"\x00\xff"}
    assert codec.encode(row).hex() == "0003000361676501fffffffffffffffe00036d73670200026869000372617703000200ff"
    assert codec.decode(codec.encode(row)) == row


@given(st.dictionaries(st.text(min_size=1, max_size=8), VALUES, max_size=5))
def test_round_trip(row):
    assert codec.decode(codec.encode(row)) == row


@given(st.binary(max_size=40))
def test_any_bytes(data):
    try:
        row = codec.decode(data)
    except MillraceError:
        return
    assert codec.encode(row) == data


def test_bounds():
    assert len(codec.encode({"a": b"x" * 504})) == 512
    for row in ({"a": b"x" * 505}, {"n" * 65: 1}, {"": 1}, {f"f{k}": 1 for k in range(65)}):
        with pytest.raises(LimitExceeded):
            codec.encode(row)
    for value in (1.5, None, True, 1 << 63):
        with pytest.raises(MillraceError):
            codec.encode({"a": value})
    with pytest.raises(codec.MalformedTuple):
        codec.decode(codec.encode({"a": 1}) + b"\0")


def test_columns_agree(spark):
    rows = spark.createDataFrame([(5, None), (None, "été"), (-1, "")], "value long, word string")
    got = [r.n for r in rows.select(results.tuple_bytes(rows).alias("n")).collect()]
    assert got == [len(codec.encode(r)) for r in ({"value": 5}, {"word": "été"}, {"value": -1, "word": ""})]
