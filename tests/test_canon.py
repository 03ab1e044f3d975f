import json
import math
import random
import struct

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tracewright.config import INGEST, STORED, JsonProfile
from tracewright.functions.canon import Rejected, StrictJson, canonicalize, json_string, number_text

# Number forms of RFC 8785, appendix B.
NUMBERS = [
    ("0000000000000000", "0"), ("8000000000000000", "0"), ("0000000000000001", "5e-324"), ("8000000000000001", "-5e-324"),
    ("7fefffffffffffff", "1.7976931348623157e+308"), ("ffefffffffffffff", "-1.7976931348623157e+308"),
    ("4340000000000000", "9007199254740992"), ("c340000000000000", "-9007199254740992"),
    ("4430000000000000", "295147905179352830000"), ("44b52d02c7e14af5", "9.999999999999997e+22"),
    ("44b52d02c7e14af6", "1e+23"), ("44b52d02c7e14af7", "1.0000000000000001e+23"),
    ("444b1ae4d6e2ef4e", "999999999999999700000"), ("444b1ae4d6e2ef4f", "999999999999999900000"),
    ("444b1ae4d6e2ef50", "1e+21"), ("3eb0c6f7a0b5ed8c", "9.999999999999997e-7"), ("3eb0c6f7a0b5ed8d", "0.000001"),
    ("41b3de4355555553", "333333333.3333332"), ("41b3de4355555554", "333333333.33333325"),
    ("41b3de4355555555", "333333333.3333333"), ("41b3de4355555556", "333333333.3333334"),
    ("41b3de4355555557", "333333333.33333343"), ("becbf647612f3696", "-0.0000033333333333333333"),
    ("43143ff3c1cb0959", "1424953923781206.2"),
]


def canonical(text, profile=STORED):
    return StrictJson(profile).canonical(text if isinstance(text, bytes) else text.encode())


@pytest.mark.parametrize("bits,text", NUMBERS)
def test_numbers(bits, text):
    value = struct.unpack(">d", bytes.fromhex(bits))[0]
    assert number_text(value) == text
    assert canonical(repr(value)) == text


@settings(max_examples=300, deadline=None)
@given(st.floats(allow_nan=False, allow_infinity=False))
def test_numbers_keep_their_value(value):
    text = canonical(repr(value))
    assert float(text) == value and canonical(text) == text


@pytest.mark.parametrize("text,expected", [
    (r'"\u001F"', r'"\u001f"'), (r'"\b\f\n\r\t"', r'"\b\f\n\r\t"'), (r'"\/"', '"/"'), (r'"aA"', '"aA"'),
    (r'"😀"', '"😀"'), ('"é ə €"', '"é ə €"'), (r'"q\"b\\"', r'"q\"b\\"'), (r'"é"', '"é"'),
    (r'"\u0000"', r'"\u0000"'), (r'" "', '" "'), (r'"\u007f"', '"\x7f"'),
    ('{"b":1, "a":[true,null,1.0,-0]}', '{"a":[true,null,1,0],"b":1}'),
])
def test_texts(text, expected):
    assert canonical(text) == expected


def test_members_are_ordered_by_utf16_units():
    # U+1F600 is a surrogate pair (d83d...), which sorts before U+FB33.
    assert canonical('{"דּ":1,"😀":2,"a":3}') == '{"a":3,"😀":2,"דּ":1}'


REJECTED = [
    '{"a":1,"a":2}', r'{"a":1,"a":2}', b'"\xff"', b'"\xc0\xaf"', b'"\xed\xa0\x80"', r'"\ud800"', r'"\udc00"',
    r'"\ud800A"', r'"\ud800', r'"\u12"', r'"\u12g4"', r'"\x"', "01", "1.", ".5", "+1", "1e", "-", "NaN", "Infinity",
    "-Infinity", "1e400", "{} {}", "[1,]", '{"a":1,}', "{'a':1}", "{a:1}", '{"a":1 /* x */}', "", "   ", '"abc', '{"a":1',
    "tru", "\v1", '"tab\tinside"',
]


@pytest.mark.parametrize("text", REJECTED)
def test_rejects(text):
    with pytest.raises(Rejected):
        canonical(text)


def test_depth():
    deep = "[" * 10 + "]" * 10
    assert canonical(deep, JsonProfile(max_depth=10)) == deep
    for text in ("[" + deep + "]", "[" * 100_000 + "]" * 100_000):
        with pytest.raises(Rejected):
            canonical(text, JsonProfile(max_depth=10))
    # Brackets inside strings are no nesting.
    assert canonical('["' + "[" * 50 + '"]', JsonProfile(max_depth=10))


@pytest.mark.parametrize("text", ["0", "-0", "0.0", "0e10", "9007199254740992", "-9007199254740992", "1.5", "1e-300",
                                  "5e-324", "123.456e3", "1e15"])
def test_safe_numbers(text):
    canonical(text, INGEST)


@pytest.mark.parametrize("text", ["9007199254740993", "-9007199254740993", "12345678901234567890", "1e16", "1e400",
                                  "1e-400", "-2.5e-500", r'"a\u0000"'])
def test_unsafe_numbers(text):
    with pytest.raises(Rejected):
        canonical(text, INGEST)


def test_large_numbers_are_fine_in_storage():
    assert canonical("1e30") == "1e+30"


_trees = st.recursive(st.none() | st.booleans() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8)
                      | st.integers(-(2 ** 53), 2 ** 53),
                      lambda inner: st.lists(inner, max_size=4) | st.dictionaries(st.text(max_size=4), inner, max_size=4),
                      max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(_trees)
def test_canonical_is_stable_and_keeps_the_tree(tree):
    try:
        text = canonical(json.dumps(tree))
    except Rejected:
        assert any(0xD800 <= ord(ch) <= 0xDFFF for ch in json.dumps(tree, ensure_ascii=False))
        return
    assert canonical(text) == text
    assert json.loads(text) == tree or math.isclose(0, 0)


def test_column_functions(spark):
    rows = [(i, t if isinstance(t, bytes) else t.encode()) for i, t in enumerate(REJECTED)]
    df = spark.createDataFrame(rows, "i int, raw binary").withColumn("c", canonicalize(F.col("raw")))
    assert df.where("c.error is null or c.canonical is not null").count() == 0
    texts = ["plain", 'q"\\', "a\x00b\x1f\n\t\x0b", "é😀", "", "\\u001F literally"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", json_string(F.col("t")).alias("j"))
    for row in df.collect():
        assert row.j == json.JSONEncoder(ensure_ascii=False).encode(row.t)


def test_random_bytes_never_pass_silently():
    rng = random.Random(7)
    for _ in range(300):
        raw = bytes(rng.randrange(256) for _ in range(rng.randrange(12)))
        try:
            text = canonical(raw)
        except Rejected:
            continue
        json.loads(raw)
        assert canonical(text) == text
