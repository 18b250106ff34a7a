"""Header resolution: names only, no data."""

import pytest

from gristmill import config
from gristmill.functions.similarity import partial_ratio, ratio, token_sort_ratio
from gristmill.operators import headers


def test_ratios():
    assert round(ratio("ABC", "ABD"), 2) == 66.67
    assert partial_ratio("ABC", "XABCX") == 100
    assert token_sort_ratio("B A", "A B") == 100
    assert ratio("", "") == 100 and partial_ratio("", "A") == 0


def _lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_partial_ratio_against_all_windows():
    import random

    rng = random.Random(3)
    def plain(a, b):
        return 200 * _lcs(a, b) / (len(a) + len(b))
    def windows(s, t):
        return [t[max(i, 0):i + len(s)] for i in range(1 - len(s), len(t))]
    for _ in range(200):
        a, b = ("".join(rng.choices("abc ", k=rng.randint(1, 8))) for _ in range(2))
        short, long = sorted((a, b), key=len)
        want = max(plain(short, w) for w in windows(short, long))
        if len(a) == len(b):
            want = max(want, max(plain(long, w) for w in windows(long, short)))
        assert partial_ratio(a, b) == pytest.approx(want)
        assert ratio(a, b) == pytest.approx(plain(a, b))


def test_map_headers():
    mapping = headers.map_headers(["CROP", "MAINTAINER (ORG)", "VARIETY RELEASE NAME:", "zzz"])
    assert mapping == {
        "CROP": "crop", "MAINTAINER (ORG)": "maintainer",
        "VARIETY RELEASE NAME:": "variety_release_name",
    }
    assert headers.map_headers(config.CATALOGUE_HEADERS) == dict(config.CATALOGUE_HEADERS)


def test_detect_and_merge():
    assert headers.detect_columns(["Crop", "country of origin", "qqq"]) == {
        "Crop": "crop", "country of origin": "country"}
    assert headers.merged_map(["CROP", "maintainer"])["maintainer"] == "maintainer"


def test_alias_map():
    exact = headers.map_by_alias(["CROP", "Country"], {k: config.HEADER_ALIASES[k] for k in ("crop", "country")})
    assert exact == {"CROP": "crop", "Country": "country"}
    only_crop = {"crop": config.HEADER_ALIASES["crop"]}
    assert headers.map_by_alias(["Species", "Seed"], only_crop) == {"Species": "crop"}
    assert headers.map_by_alias([]) == {}


def test_essentials():
    assert headers.missing_essentials({"a": "crop"}) == [
        "variety_release_name", "country", "year_of_release"]


def test_text_column():
    assert headers.find_text_column(["id", "Description"]) == "Description"
    assert headers.find_text_column(["id", "remarks"], wanted="remark") == "remarks"
    with pytest.raises(ValueError):
        headers.find_text_column(["id", "colour"])
    with pytest.raises(ValueError):
        headers.find_text_column(["id", "colour"], wanted="xyz")


def test_combine_keys():
    assert headers.combine_key_columns(["Crop type", "cultivar"], {}) == ("Crop type", "cultivar")
    assert headers.combine_key_columns(["a", "b"], {"a": "crop"}) == ("a", None)


def test_key_column_and_names(spark):
    df = spark.createDataFrame(
        [(1, " ", "12.5", "Maize"), (2, None, "7", None)], "n int, a string, b string, c string")
    assert headers.find_key_column(df, {"c": "variety_release_name"}) == "c"
    assert headers.find_key_column(df, {}) == "b"
    assert headers.find_key_column(df.withColumnRenamed("a", "Cultivar"), {}) == "Cultivar"
    names = [r[0] for r in df.select(headers.extract_name(df, "a", {})).collect()]
    assert names == ["Maize", None]


def test_conflicting_columns(spark):
    df = spark.createDataFrame([(None, "x"), ("y", "z")], "a string, b string")
    mapping = {"a": "t", "b": "t"}
    def values(rule):
        return [r.t for r in headers.apply_mapping(df, mapping, rule).collect()]
    assert values("coalesce") == ["x", "y"]
    assert values("first") == [None, "y"]
    assert values("last") == ["x", "z"]
