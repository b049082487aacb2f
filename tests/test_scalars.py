import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from termweave.functions import ids, text


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_normalize(spark):
    given = ["  Straße \tX \x1c", "A b\x85c", "ﬁne", "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, s string").orderBy("i")
    assert [r[0] for r in values(df, text.normalize_text(F.col("s")))] == ["strasse x", "a b c", "fine", "", None]


@pytest.mark.parametrize(("a", "b", "wanted"), [
    ("amoxicilin", "amoxicillin", 0.952381), ("TOPROL XL 50 MG", "24 HR metoprolol succinate 50 MG Extended Release Oral Tablet [Toprol]", 0.75), ("ZZZQQQ NOT A DRUG 999", "Myosotis arvensis extract", 0.26087),
    ("Tylenol", "acetaminophen", 0.3), ("tide", "diet", 0.25), ("diet", "tide", 0.5), ("plate", "red plate", 1.0), ("red plate", "plate", 0.714286), ("Straße", "STRASSE", 1.0), ("", "x", 0.0),
])
def test_similarity_golden(spark, a, b, wanted):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(F.round(text.lexical_similarity(F.col("a"), F.col("b")), 6)).head()[0] == pytest.approx(wanted, abs=1e-6)


def test_digests_equal_python(spark):
    rows = [("é/\"", None), ("a\\b\n\x01", "😀 x"), ("plain", ""), (None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, b string, a string").orderBy("i")
    got = values(df, ids.canonical_json({"b": F.col("b"), "a": F.col("a")}), ids.stable_digest({"b": F.col("b"), "a": F.col("a")}, key=b"k" * 70))
    for (b, a), (plain, keyed) in zip(rows, got, strict=True):
        wanted = json.dumps({"a": a, "b": b}, sort_keys=True, separators=(",", ":"))
        assert plain == wanted
        assert keyed == hmac.new(b"k" * 70, wanted.encode(), hashlib.sha256).hexdigest()


def test_record_id_and_cells(spark):
    df = spark.createDataFrame([("a|b", "c\\d"), ("x", " "), (None, "y")], "a string, b string")
    assert [r[0] for r in values(df, ids.record_id(F.col("a"), F.col("b")))] == ["a\\|b|c\\\\d", None, None]
    cells = spark.createDataFrame([("=1",), ("  +x",), ("a=",), (None,), ("@",)], "s string")
    assert [r[0] for r in values(cells, text.csv_safe(F.col("s")))] == ["'=1", "'  +x", "a=", None, "'@"]


def test_strength_status_numbers(spark):
    df = spark.createDataFrame([("x 0.5 ML y", "never active", "1e2"), ("5%x", "ACTIVE", "n/a"), ("5 %", None, None)], "s string, t string, n string")
    assert values(df, text.extract_strength(F.col("s")), text.parse_status(F.col("t")), text.to_number(F.col("n"))) == [("0.5 ML", "never_active", 100.0), ("5%", "active", None), (None, "unknown", None)]


def test_json_strings_equal_pythons(spark):
    texts = ["", "a", 'a"b', "\\", '\\"', '{"a":"b\\n"}', "x\n", 'é"', "😀\\", "\x7f", "\x00a", 'tab\t"']
    rows = spark.createDataFrame([(x,) for x in texts], "v string").select("v", ids.json_string(F.col("v")).alias("j")).collect()
    assert [r.j for r in rows] == [json.dumps(r.v) for r in rows]


def test_canonical_json_is_pythons(spark):
    texts = ["plain", 'a"b\\c/d', "tab\tline\nbell\x07\x1f", "del\x7f", "\\u00e9 written out", "é€ \U0001f600", "", None, "\x00", " "]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "b string, a string")
    for r in df.select("a", "b", ids.canonical_json({"x.b": F.col("b"), "a": F.col("a")}).alias("j")).collect():
        assert r["j"] == json.dumps({"a": r["a"], "x.b": r["b"]}, sort_keys=True, separators=(",", ":"))
