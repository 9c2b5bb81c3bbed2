"""Scalar functions on stated cases."""

import pytest
from pyspark.sql import functions as F

from framewright.functions import headers, scalar
from framewright.plans.settings import Settings


def one(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_next_in_sequence(spark):
    names = ["dir", "dir0", "dir9", "dir09", "dir0009", "dir0012.data", "0013.data", "-000014.data", "000015", "-", "00005"]
    assert one(spark, names, scalar.next_in_sequence) == ["0", "dir1", "dir10", "dir10", "dir0010", "dir0013.data", "0014.data", "-000015.data", "000016", "0", "00006"]


def test_sequence_of_a_folder(spark):
    df = spark.createDataFrame([("dir",), ("dir0",), ("dir0012.data",), ("dir09",)], "name string")
    last = df.select(F.max_by("name", scalar.sequence_number(F.col("name"))).alias("n"))
    assert last.select(scalar.next_in_sequence(F.col("n"))).first()[0] == "dir0013.data"


def test_bits(spark):
    a = spark.range(1).select(scalar.bits_of(F.array(*map(F.lit, [202, 53, 73, 0, 196, 197, 198, 199, 200, 201, 53]))).alias("a"), scalar.bits_of(F.array(*map(F.lit, [23, 73, 196, 197, 198, 199, 200, 201, 202]))).alias("b"))
    both = a.select(F.array_intersect("a", "b").alias("c"), F.array_contains("a", 73).alias("has"), scalar.first_bit(F.col("b")).alias("first"), scalar.first_bit(F.array_except("a", "a")).alias("none")).first()
    assert both.c == [73, 196, 197, 198, 199, 200, 201, 202] and both.has and both.first == 23 and both.none == 0
    full = spark.range(1).select(scalar.bits_not(F.array().cast("array<int>"), 220).alias("x")).first().x
    assert full[0] == 1 and len(full) == 220


def test_subspec(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (4095, 14, 1), (0xFFFFFF, 3, 0)], "cru long, link long, ep long")
    got = [r[0] for r in df.select(scalar.subspec(F.col("cru"), F.col("link"), F.col("ep"))).collect()]
    assert got == [0x10001, 0x10100, 0xFFF0F00, 0xFFFF0004]


def test_parameters(spark):
    assert one(spark, [None, "true", "TRUE", "1", "yes", ""], lambda x: scalar.bool_param(x, True)) == [True, True, True, True, False, False]
    assert one(spark, [None, "5", "-5", "x", " 7 ", ""], lambda x: scalar.uint_param(x, 128)) == [128, 5, 128, 128, 7, 128]
    assert one(spark, ["  0012 ", "", "x1", "0", None], scalar.run_number) == [12, -1, -1, 0, -1]
    assert one(spark, ["b;a", "a,a", " ;", "src0;src1;src2", None], scalar.id_list) == [["a", "b"], None, None, ["src0", "src1", "src2"], None]
    assert one(spark, ["tpc", " ITS", "xyz", "nil", ""], scalar.origin_of_option) == ["TPC", "ITS", "ANY", "NIL", "ANY"]


def test_align(spark):
    assert one(spark, [0, 1, 16, 17], lambda x: scalar.align_up(x, 16), "long") == [0, 16, 16, 32]


def test_headers_there_and_back(spark):
    given = {"version": 6, "header_size": 64, "fee_id": 0xFEE0, "system_id": 3, "offset_to_next": 8192, "memory_size": 777, "link_id": 11, "cru_id": 0xABC, "endpoint_id": 1, "bc": 0xFFF, "orbit": 0xFFFFFFFE, "trigger_type": 0x6003, "page_counter": 65535, "stop_bit": 1}
    df = spark.range(1).select(headers.header({k: F.lit(v) for k, v in given.items()}).alias("b"))
    got = df.select(F.length("b").alias("n"), *[headers.field(F.col("b"), k).alias(k) for k in given]).first().asDict()
    assert got.pop("n") == headers.HEADER_SIZE and got == given
    raw = bytes(df.first().b)
    assert headers.walk(raw)[0]["stop_bit"] and headers.walk(raw)[0]["memory_size"] == 777
    assert headers.walk(raw[:40]) == [] and headers.walk(None) == []


@pytest.mark.parametrize(("given", "key", "value"), [({}, "stale_tf_timeout_ms", 750), ({"stale_tf_timeout_ms": "5"}, "stale_tf_timeout_ms", 25), ({"stale_tf_timeout_ms": "-5"}, "stale_tf_timeout_ms", 750), ({"build_incomplete_tfs": "no"}, "build_incomplete_tfs", False), ({"sender_selection": "linear"}, "sender_selection", "linear")])
def test_settings(given, key, value):
    assert getattr(Settings.of(given), key) == value


def test_settings_of_the_environment():
    got = Settings.of_environment({"FRAMEWRIGHT_STALE_TF_TIMEOUT_MS": "900", "HOME": "/", "FRAMEWRIGHT_NO_SUCH": "1"})
    assert got.stale_tf_timeout_ms == 900 and got.rdma_gap_b == 8192
