import json

import pytest
from pyspark.sql import functions as F

from waybill.operators import submit as S


@pytest.fixture(scope="module")
def catalogue(spark):
    tools = spark.createDataFrame(
        [("own", ["a", "b"], "t", None, 0, None), ("named", None, "t", True, None, {"k": "tool"}),
         ("lost", [], "nowhere", None, None, None), ("bare", None, None, None, None, None)],
        "name string, route array<string>, template string, progress boolean, timeout int, "
        "metadata map<string,string>")
    params = spark.createDataFrame(
        [("own", "q", "string", True, None, None), ("own", "n", "integer", False, "3", None),
         ("own", "mode", "string", False, None, ["x", "y"])],
        "tool string, name string, type string, required boolean, default string, "
        "options array<string>")
    templates = spark.createDataFrame([("t", ["c", "d"])], "name string, actors array<string>")
    return tools, params, templates


def submit(spark, catalogue, rows, **options):
    df = spark.createDataFrame(rows, "id string, tool string, arguments string").withColumn(
        "created_at", F.lit("2024-01-01").cast("timestamp"))
    return {r.id: r for r in S.submit(df, *catalogue, **options).collect()}


def test_resolution_and_rejection(spark, catalogue):
    got = submit(spark, catalogue, [
        ("1", "own", '{"q": null}'), ("2", "own", "{}"), ("3", "named", "{}"), ("4", "lost", "{}"),
        ("5", "bare", "{}"), ("6", "who", "{}")], timeout=40)
    assert got["1"].rejected is None and got["1"].route.actors == ["a", "b"]
    assert got["1"].route.metadata == {"job_id": "1"} and got["1"].deadline is None
    assert got["2"].rejected == "missing required parameter: q"
    assert got["3"].route.actors == ["c", "d"] and got["3"].timeout_sec == 40
    assert got["3"].progress and got["3"].tool_metadata == {"k": "tool"}
    assert got["4"].rejected == 'route error: route template "nowhere" not found'
    assert got["5"].rejected == "route error: route has no actors or template"
    assert got["6"].rejected == "unknown tool: who"


def test_strict(spark, catalogue):
    got = submit(spark, catalogue, [
        ("1", "own", '{"q": "x"}'), ("2", "own", '{"q": 1}'), ("3", "own", '{"q": "x", "n": 1.5}'),
        ("4", "own", '{"q": "x", "mode": "z"}'), ("5", "own", '{"q": "x", "n": 9, "mode": "y"}')],
        strict=True)
    assert got["1"].rejected is None and json.loads(got["1"].payload) == {"q": "x", "n": 3}
    assert got["2"].rejected == "invalid argument: q:type"
    assert got["3"].rejected == "invalid argument: n:type"
    assert got["4"].rejected == "invalid argument: mode:option"
    assert json.loads(got["5"].payload) == {"q": "x", "n": 9, "mode": "y"}


def test_nested_types(spark):
    declared = {"type": "object", "properties": {
        "a": {"type": "number"}, "l": {"type": "array", "items": {"type": "string"}}}}
    cases = [('{"a": 1}', True), ('{"a": 1.5, "l": ["x"]}', True), ('{"a": "1"}', False),
             ('{"l": ["x", 2]}', False), ('{"l": {}}', False), ("[]", False)]
    df = spark.createDataFrame(cases, "t string, ok boolean")
    got = df.select("ok", S.fits(F.parse_json("t"), declared).alias("got")).collect()
    assert all(r.ok == r.got for r in got)
    with pytest.raises(ValueError):
        S.fits(F.lit(None), {"type": "date"})
