"""Scalar functions against literal tables."""

import pytest
from pyspark.sql import functions as F

from tidewater.functions import fuzzy
from tidewater.functions import numbers as N
from tidewater.functions import text as X


def column(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("o")).orderBy("i").collect()
    return [r["o"] for r in rows]


CASES = [
    (X.clean_string, ["<b>Hi</b>  you​", " null ", None, "Café", "a\n\tb"], ["Hi you", None, None, "Café", "a b"]),
    (X.title_case, ["o'neil b2b mc-donald 3rd", "ÉCOLE", None, ""], ["O'Neil B2B Mc-Donald 3Rd", "École", None, ""]),
    (X.normalize_email, ["John at gmail.com", "a.at.b.org", "X@Y.com ", "nomail", None], ["john@gmail.com", "a@b.org", "x@y.com", None, None]),
    (lambda c: X.normalize_email(c, compat=True), ["john at gmail.com"], ["john@tgmail.com"]),
    (X.normalize_phone, ["+91 98765 43210", "1-555-123-4567", "9999999999", "123", None], ["9876543210", "5551234567", None, None, None]),
    (X.dedup_phone, ["12", None, "98765 43"], ["", "", "9876543"]),
    (X.fix_boolean, ["Yes", "off", "maybe", None], [True, False, None, None]),
    (X.script_of, ["abc", "नमस्ते", "x привет", None, "漢字", "한글"], ["Latin", "Devanagari", "Cyrillic", "Latin", "CJK", "Hangul"]),
    (X.dedup_key, [" A ", "N/A", None, "0"], ["a", "", "", ""]),
    (X.load_missing, ["NA", "  ", "na", "x"], [None, None, "na", "x"]),
    (N.to_number, ["12d", " 1.5e3 ", "-3", "abc", None, ".5"], [None, 1500.0, -3.0, None, None, 0.5]),
    (N.iso_date, ["2024-02-30", "2024/01/05", "31-12-2023", "2024-01-05T10:20:30Z", "x"], [None, "2024-01-05", "2023-12-31", "2024-01-05", None]),
    (lambda c: N.to_rupees(N.parse_money(c)), ["$10", "₹1,200.50", "3 EUR", "12", "about 5", None, "5 XYZ"], [835.0, 1200.5, 270.3, 12.0, None, None, 5.0]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_scalar(spark, case):
    f, values, wanted = CASES[case]
    assert column(spark, f, values) == wanted


def test_coerce_drops_sign_by_name(spark):
    assert column(spark, lambda c: N.coerce_numeric(c, "unit_price"), ["-5"]) == [5.0]
    assert column(spark, lambda c: N.coerce_numeric(c, "profit_amount"), ["-5"]) == [-5.0]


def test_ratio_golden():
    assert fuzzy.ratio("raj sharma", "raj sharam") == 90.0
    assert round(fuzzy.ratio("veer", "vir"), 2) == 57.14
    assert fuzzy.token_sort_ratio("b a", "a b") == 100.0
    assert fuzzy.token_set_ratio("a b", "a b c") == 100.0
    assert fuzzy.partial_ratio("abc", "xxabcxx") == 100.0
    assert fuzzy.ratio("", "") == 100.0 and fuzzy.ratio(None, "a") == 0.0


def test_ratio_expression_equals_function(spark):
    pairs = [("raj sharma", "raj sharam"), ("", ""), ("a", ""), ("abcd", "dcba"), ("veer", "vir"), ("aab", "abab")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fuzzy.ratio_expr(F.col("a"), F.col("b")).alias("r"), fuzzy.ratio_udf("a", "b").alias("u")).collect()
    assert all(abs(r["r"] - fuzzy.ratio(r["a"], r["b"])) < 1e-9 and abs(r["u"] - r["r"]) < 1e-9 for r in rows)
