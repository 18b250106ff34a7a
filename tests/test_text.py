"""Value-level rules against hand-derived examples."""

import pytest
from pyspark.sql import functions as F

from gristmill import config
from gristmill.functions import text


def apply(spark, values, expression):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, v string")
    return [r.out for r in df.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def check(spark, cases, expression):
    assert apply(spark, list(cases), expression) == list(cases.values())


def test_clean_text(spark):
    check(spark, {
        "  Maïze  H-614 (D) ": "MAIZE H-614 (D)",
        "Beans & Peas": "BEANS  PEAS",
        "A/B, C": "AB C",
        "x_1": "X_1",
        None: "",
        "Straße Œuvre Łódź ñandú": "STRASSE OEUVRE LODZ NANDU",
        " a\tb\n": "A B",
        "&&": "",
    }, text.clean_text)


def test_key_text_is_idempotent(spark):
    values = ["Beans & Peas", "  a  &  b ", "Ünï & çode", None, "x - y"]
    once = apply(spark, values, text.key_text)
    assert apply(spark, once, text.key_text) == once
    assert once[0] == "BEANS PEAS"


def test_clean_numeric(spark):
    check(spark, {
        "1,200 kg": 1200.0, "12-24": None, "-3.5": -3.5, "abc": None, "1.2.3": None,
        "1.": 1.0, ".5": 0.5, "": None, None: None, "Brand#13": 13.0,
    }, text.clean_numeric)


def test_standardise(spark):
    check(spark, {
        "usa": "UNITED STATES", "U.S.A.": "UNITED STATES", " u.k. ": "UNITED KINGDOM",
        "Kenya": "KENYA", None: "",
    }, lambda c: text.standardise(c, config.COUNTRY_ALIASES))


def test_normalise_whitespace(spark):
    check(spark, {
        "  a \t b ": "a b", "nan": "", "NaN": "", "None": "", "": "", None: "",
        "Mixed, Case!": "Mixed, Case!", " nan ": "nan",
    }, text.normalise_whitespace)


def test_guard(spark):
    guarded = ["4-6", "2020-2023", "1998", "1,998", "25", "007", "04500", "0.45", "1/2", "12:30"]
    cases = {v: "'" + v for v in guarded}
    cases |= {v: v for v in ["90-120", "45", "4.5", "13/2", "0012", "0450", "2150", "a-b", "1-2-3"]}
    cases |= {"'12": "'12", "'450": "450", None: None, "": "", "  ": "", " 4 - 6 ": "'4 - 6"}
    cases |= {"123456789012345678901234567890-5": "123456789012345678901234567890-5"}
    check(spark, cases, text.guard_for_spreadsheet)


def test_skip_reason(spark):
    rows = [(None, None), (None, "x"), (" ", "x"), ("x", None), ("x", " "), ("x", "y")]
    df = spark.createDataFrame(rows, "crop string, variety string")
    assert [r[0] for r in df.select(text.skip_reason("crop", "variety")).collect()] == [
        "Both crop and variety are missing or empty", "Crop is missing (null/NaN)",
        "Crop is empty", "Variety is missing (null/NaN)", "Variety is empty", None,
    ]


def test_safe_names(spark):
    check(spark, {
        "a/b:c[1]*?\\": "abc1",
        "x" * 31: "x" * 31,
        "x" * 32: "x" * 28 + "...",
    }, text.safe_sheet_name)
    check(spark, {'a b<>:"/\\|?*c': "a_bc"}, text.safe_file_name)


def test_composite_key(spark):
    df = spark.createDataFrame([("Maize", "H 614"), (None, "H 614")], "c string, v string")
    keys = [r[0] for r in df.select(text.composite_key("c", "v")).collect()]
    assert keys == ["MAIZE||H 614", "||H 614"]


@pytest.mark.parametrize("number", [
    5.0, 4.5, 12345678.0, 12345678.25, 0.1, 999999999999.0, 0.0, 0.001, 0.0005, 0.0001, 0.00012345, 1e-05, 2.5e-07,
    -0.0005, -12345678.5, 1e7, 123456789.125, 1e15, 9007199254740993.0, 1e16, 1.5e16, 1.25e+300, 1e-100, 3e22])
def test_float_text(spark, number):
    out = spark.range(1).select(text.python_float_text(F.lit(number))).first()[0]
    assert out == str(number)


@pytest.mark.parametrize("ending", ["\n", "\r\n", "\r", "\x0b", "\x85", "\u2028", "\u2029", " \n "])
def test_breaks_at_the_end_do_not_count(spark, ending):
    df = spark.createDataFrame([("Maize" + ending, "H614" + ending, "1998" + ending)], "c string, v string, y string")
    found = df.select(text.clean_text("c"), text.composite_key("c", "v"), text.guard_for_spreadsheet("y")).first()
    assert tuple(found) == ("MAIZE", "MAIZE||H614", "'1998")
