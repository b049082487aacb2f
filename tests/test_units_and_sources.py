import pytest
from pyspark.sql import functions as F

from termweave.operators import units
from termweave.profile import Profile
from termweave.sources import batch


def test_envelope_first_wins_and_neighbours(spark):
    df = spark.createDataFrame([("oral", "iv", "z"), (" ", "iv", None)], "route string, `Route COD` string, other string")
    e = [r["e"] for r in df.select(units.build_envelope(df.columns).alias("e")).collect()]
    assert e[0]["route"] == "oral" and e[0]["neighboring_fields"] == {"Route COD": "iv", "other": "z"}
    assert e[1]["route"] == "iv" and e[1]["neighboring_fields"] == {}


def test_row_tests_have_a_fixed_order(spark):
    df = spark.createDataFrame([("", ""), ("1", " "), ("1", "x"), (None, "x")], "id string, v string")
    got = [(r["status"], r["error_code"]) for r in units.classify_rows(df, "v", ["id"]).collect()]
    assert got == [("error", "MISSING_RECORD_ID"), ("skipped", "BLANK_VALUE"), ("success", None), ("error", "MISSING_RECORD_ID")]
    absent = units.classify_rows(df, "v", ["id"], ["c"], absent=["c"]).where("id = '1'").orderBy("v")
    assert [r["error_code"] for r in absent.collect()] == ["BLANK_VALUE", "MISSING_CONTEXT_COLUMN"]


def test_json_lines(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text('{"a": "1", "b": null}\n\n{bad\n[1]\n{"a": "2"}\n')
    df = batch.read_batch(spark, str(path), columns=["a", "b"])
    rows = units.classify_rows(df, "a", [])
    assert sorted((r["error_code"] or "", r["a"] or "") for r in rows.collect()) == [("", "1"), ("", "2"), ("JSONDecodeError", ""), ("UnsupportedInput", "")]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("=x", " a ", "q\"uo"), ("b", "", "l1\nl2")], "a string, b string, c string")
    batch.write_crosswalk(df, str(tmp_path / "out.csv"), "csv")
    got = {r["a"]: (r["b"], r["c"]) for r in batch.read_batch(spark, str(tmp_path / "out.csv"), "csv").collect()}
    assert got["'=x"] == (" a ", 'q"uo') and (got["b"][0] or "") == "" and got["b"][1] == "l1\nl2"


def test_columns_are_checked(spark):
    df = spark.createDataFrame([("1", "x")], "id string, v string")
    with pytest.raises(ValueError, match="distinct"):
        batch.check_columns(df, "v", ["v"], [])
    with pytest.raises(ValueError, match="missing"):
        batch.check_columns(df, "v", ["id"], ["route"])


def test_keys_share_and_ids_differ(spark):
    df = spark.createDataFrame([("1", " Aspirin ", "oral"), ("2", "aspirin", "oral"), ("3", "aspirin", None)], "id string, v string, route string")
    u = {r["record_id"]: r for r in units.build_units(df, "v", ["id"], ["route"], Profile()).collect()}
    assert u["1"]["mapping_key"] == u["2"]["mapping_key"] != u["3"]["mapping_key"]
    assert len({r["sau_id"] for r in u.values()}) == 3


def test_numbers_are_contiguous_in_any_partitioning(spark):
    df = spark.range(1000).withColumn("x", F.col("id") * 7 - 3)
    for n in (1, 5):
        got = sorted((r["x"], r["row_number"]) for r in units.number_rows(df.repartition(n), ["x"]).collect())
        assert [n for _, n in got] == list(range(1, 1001))


def test_manifest_ignores_order(spark):
    df = spark.range(50).withColumn("s", F.col("id").cast("string"))
    assert batch.digest(df).collect() == batch.digest(df.orderBy(F.desc("id")).repartition(3)).collect()


def test_row_numbers_with_text_ids_and_skew(spark, monkeypatch):
    monkeypatch.setattr(units, "RANGE_ROWS", 10)
    for kind, xs in (("string", [f"id'{i * 7919 % 101}\\" for i in range(101)]), ("long", [10**15, None, *range(99)]), ("double", [0.5] * 60 + [1.5])):
        df = spark.createDataFrame([(x, i) for i, x in enumerate(xs)], f"x {kind}, y int").withColumn("_span", F.lit("taken")).repartition(3)
        got = {r["y"]: r["row_number"] for r in units.number_rows(df, ["x", "y"]).collect()}
        assert got == {r["y"]: i + 1 for i, r in enumerate(df.orderBy("x", "y").collect())}
    assert units.number_rows(df.limit(0), ["x"]).count() == 0
