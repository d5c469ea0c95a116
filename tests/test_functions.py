import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataframe.functions import digests, keys, sizes, tensors
from strataframe.functions.schemas import ColumnSchema, default_storage


@given(st.one_of(st.integers(0, 10**9), st.from_regex(r"[A-Za-z0-9_.\-]{1,64}", fullmatch=True)))
@settings(max_examples=200, deadline=None)
def test_keys_round_trip(key):
    assert keys.decode_key(keys.encode_key(key)) == key


@pytest.mark.parametrize("key", [-1, "", "a b", "ü", "x" * 65, 1.5, None, "a/b", "a\n"])
def test_illegal_keys(key):
    assert not keys.is_legal_key(key)
    with pytest.raises(ValueError):
        keys.encode_key(key)


def test_keys_are_typed_and_ordered(spark):
    assert keys.encode_key(1) != keys.encode_key("1")
    stored = [keys.encode_key(k) for k in (10, 2, "-", "1", "B", "_", "a")]
    rows = spark.createDataFrame([(s,) for s in reversed(stored)], "k string").orderBy("k").collect()
    assert [r.k for r in rows] == stored


def test_digests_agree_between_driver_and_columns(spark):
    values = ["text", "", b"raw", b"", np.arange(6, dtype="int16").reshape(2, 3), np.array(1.5, dtype="float32")]
    rows = [tensors.to_row(v) for v in values]
    df = spark.createDataFrame(rows, "digest string, kind string, dtype string, shape array<int>, data binary, text string, nbytes long")
    assert df.where(digests.object_digest(F.col("kind")) != F.col("digest")).count() == 0
    assert len({r[0] for r in rows}) == len(rows)


def test_shape_and_type_are_in_a_tensors_digest():
    a = np.zeros((2, 3), "int32")
    assert len({tensors.to_row(x)[0] for x in (a, a.reshape(3, 2), a.reshape(6), a.view("float32"))}) == 4


@pytest.mark.parametrize("dtype", ["bool", "int8", "uint8", "uint16", "int64", "uint64", "float16", "float64", "longdouble"])
def test_tensor_rows_round_trip(dtype):
    a = np.arange(6).reshape(2, 3).astype(dtype)
    b = tensors.from_row(*tensors.to_row(a)[1:6])
    assert b.dtype == a.dtype and np.array_equal(a, b)


@pytest.mark.parametrize(("shape", "variable", "code"), [((10,), False, "10"), ((399,), False, "10"), ((400,), False, "00"), ((10_000_000,), False, "00"), ((10_000_001,), False, "01"), ((10_000_001,), True, "00"), ((2, 2), False, "01"), ((2, 2), True, "00"), ((10,), True, "10")])
def test_default_storage(shape, variable, code):
    assert default_storage("ndarray", shape, variable) == code


def test_schema_refusals():
    for bad in ({"kind": "int"}, {"kind": "str", "layout": "deep"}, {"kind": "ndarray", "dtype": "complex64", "shape": (2,)}, {"kind": "ndarray", "dtype": "int8", "shape": (0,)}, {"kind": "ndarray", "dtype": "int8", "shape": (1,) * 32}, {"kind": "str", "storage": "00"}, {"kind": "bytes", "variable": False}, {"kind": "str", "storage_options": {"compression": "rar"}}):
        with pytest.raises(ValueError):
            ColumnSchema(**bad)


def test_values_fit_or_have_a_reason():
    fixed = ColumnSchema("ndarray", variable=False, dtype="float32", shape=(2, 3))
    loose = ColumnSchema("ndarray", variable=True, dtype="float32", shape=(2, 3))
    ok = np.zeros((2, 3), "float32")
    assert fixed.why_not(ok) is None and loose.why_not(ok[:1].copy()) is None
    for bad in (ok.astype("float64"), ok[:1].copy(), np.asfortranarray(np.zeros((2, 3), "float32")), [1], "x"):
        assert fixed.why_not(bad)
    assert loose.why_not(np.zeros((3, 3), "float32")) and loose.why_not(np.zeros(3, "float32"))
    assert ColumnSchema("str").why_not("é" * 1_000_001) and not ColumnSchema("str").why_not("é" * 1_000_000)
    assert ColumnSchema("bytes").why_not("x") and not ColumnSchema("bytes").why_not(b"")


def test_schema_digest_ignores_order_and_sees_storage():
    a = ColumnSchema("str")
    assert ColumnSchema.from_spec(dict(reversed(a.spec().items()))).digest == a.digest
    assert ColumnSchema("str", storage_options={"compression": "gzip"}).digest != a.digest


def test_violations_as_a_column(spark):
    s = ColumnSchema("ndarray", variable=False, dtype="int32", shape=(2,))
    rows = [tensors.to_row(v) for v in (np.zeros(2, "int32"), np.zeros(3, "int32"), np.zeros(2, "int64"), "x")]
    df = spark.createDataFrame(rows, "digest string, kind string, dtype string, shape array<int>, data binary, text string, nbytes long")
    assert [r.v is None for r in df.select(s.violation().alias("v")).collect()] == [True, False, False, False]


def test_sizes():
    assert sizes.format_bytes(1_234_567) == "1.23 MB" and sizes.format_bytes(12) == "12.00 B" and sizes.format_bytes(1) == "1.00 B"
    assert sizes.parse_bytes("5 kB") == 5000 and sizes.parse_bytes("1.5MiB") == 1_572_864 and sizes.parse_bytes("100") == 100
    with pytest.raises(ValueError):
        sizes.parse_bytes("five")
    assert sizes.bound(0, 5, 9) == 5 and list(sizes.unique_everseen("abca")) == ["a", "b", "c"]
    assert list(sizes.grouper(range(5), 2)) == [(0, 1), (2, 3), (4,)]


def test_blake2b_udf(spark):
    import hashlib

    got = spark.createDataFrame([(b"x",), (None,)], "d binary").select(digests.blake2b_udf("3")("d").alias("h")).collect()
    assert got[0].h == "3=" + hashlib.blake2b(b"x", digest_size=20).hexdigest() and got[1].h is None


def test_versions_are_ordered():
    from strataframe.functions.versions import Version, can_read

    order = ["0.9.dev1", "0.9", "1.0.dev1", "1.0a1.dev2", "1.0a1", "1.0a2", "1.0b1", "1.0rc1", "1.0", "1.0+a.1", "1.0+1", "1.0.post1.dev1", "1.0.post1", "1.0.1", "1.10", "1!0.1"]
    made = [Version.parse(v) for v in order]
    assert sorted(reversed(made)) == made and [str(v) for v in made] == order
    assert Version.parse("v1.0-ALPHA.1") == Version.parse("1a1") and Version.parse("1.0") == Version.parse("1.0.0") and str(Version.parse("1.0-3")) == "1.0.post3"
    assert Version.parse("1.0rc1").is_prerelease and not Version.parse("1.0.post1").is_prerelease
    with pytest.raises(ValueError):
        Version.parse("one")
    assert can_read("0.2.0") and not can_read("0.1.5", [("0.1", "0.2")])


def test_bounded_dict_and_primes():
    d = sizes.BoundedDict({"a": 1, "b": 2}, maxsize=2)
    d["a"] = 3
    assert d["a"] == 3 and d.setdefault("c", 4) == 4 and dict(d) == {"b": 2, "c": 4}
    assert [sizes.next_prime(n) for n in (-1, 2, 3, 4, 14, 100, 7919)] == [2, 2, 3, 5, 17, 101, 7919]


def test_ecosystem():
    from strataframe.plans.reports import ecosystem

    got = ecosystem()
    assert got["packages"]["pyspark"] and got["host"]["python"] and "torch" in got["optional"]
