"""Scalar functions, each with the inputs that the survey lists as defects of the original."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quern.functions import driver
from quern.functions import scalars as S


def values(spark, texts, *columns):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect()]


def test_parse_bytes(spark):
    cases = {
        "1200 GiB": 1200 * 2.0**30, "200GiB": 200 * 2.0**30, "GiB": 2.0**30, "1.5MB": 1.5e6, "": 1.0, "7": 7.0, "7 b": 7.0, "3 kb": 3000.0, "2PiB": 2.0**51, "1e3 kB": 1e6, " 5 k B ": 5000.0,
        "4 furlong": None, "x1": None, "1..2 MB": None, None: None,
    }
    assert values(spark, list(cases), S.parse_bytes("t")) == list(cases.values())
    with pytest.raises(Exception, match="not a size"):
        values(spark, ["4 furlong"], S.parse_bytes("t", strict=True))


def test_disk_capacity(spark):
    assert values(spark, ["auto", "1200 GiB", "1 GB", "2GiB"], S.disk_capacity("t")) == [-1, 1200, 1, 2]


def test_bucket_names(spark):
    names = ["arn:aws:s3:::a", "arn:aws:s3:::a/", "arn:aws:s3:::a*", "arn:aws:s3:::a/*", "a", None]
    assert values(spark, names, S.arn_to_name("t")) == ["a"] * 5 + [None]
    assert values(spark, ["a"], S.name_to_arn("t")) == ["arn:aws:s3:::a"]
    assert values(spark, ["get_all_it"], S.endpoint("t")) == ["get-all-it"]


def test_times(spark):
    assert values(spark, ["2024-01-02T03:04:05", "", "no", None], S.parse_time("t")) == [datetime(2024, 1, 2, 3, 4, 5), None, None, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        values(spark, ["0126202220937124"], S.parse_time("t", strict=True))
    assert values(spark, ["2024-01-02T03:04:05"], S.local_time(S.parse_time("t"), "America/Los_Angeles")) == [datetime(2024, 1, 1, 19, 4, 5)]


def test_paths(spark):
    assert values(spark, ["a/b/c.py", "c.py", ""], S.basename("t")) == ["c.py", "c.py", ""]
    assert values(spark, ["x/a"], S.basenames(F.array("t", F.lit("b")))) == [["a", "b"]]
    assert values(spark, ["file:///a/file://b"], S.strip_file_scheme("t")) == ["/a/b"]
    assert [tuple(r) for r in values(spark, ["s3://b/k/l", "s3://b", None], S.split_object_url("t"))] == [("b", "k/l"), ("b", None), (None, None)]


def test_values_and_precedence(spark):
    text = "x" * 500
    contents = values(spark, [text], S.encode_value("t"))[0]
    assert "\n" not in contents and values(spark, [contents], S.decode_value("t").cast("string")) == [text]
    assert values(spark, [None, "b"], S.default("t", "d")) == ["d", "b"]
    assert values(spark, [None, "b"], S.first_given(F.lit(None).cast("string"), "t", F.lit("f"))) == ["f", "b"]
    assert [r[0] for r in spark.range(6).select(S.backoff("id")).collect()] == [5, 10, 20, 40, 80, 80]
    assert [r[0] for r in spark.range(4).select(S.kernel("id")).collect()] == [1, 4, 9, 16]


def test_driver_functions(monkeypatch):
    wait = driver.waits()
    assert [next(wait) for _ in range(7)] == [5, 10, 20, 40, 80, 80, 80]
    assert driver.digest("a") == "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"
    a, b = driver.message_id(), driver.message_id()
    assert int(b) == int(a) + 1 and driver.dedup_id() != driver.dedup_id()
    assert driver.from_contents(driver.to_contents({"a": [1, None]})) == {"a": [1, None]}
    assert re.match(r"3\.\d+", driver.python_version())
    assert {"pyspark", "pytest"} <= set(driver.loaded_packages()) and "os" not in driver.loaded_packages()
    monkeypatch.setenv("PYTHON_DEBUG", "Quern")
    assert driver.debugging()
