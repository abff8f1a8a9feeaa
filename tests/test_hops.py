import json
import time
from functools import partial

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waybill import Registry, hop_log, run, step, terminals
from waybill.functions.route import make_route
from waybill.operators.actors import CALLS, python_call
from waybill.operators.hops import RAISED
from waybill.operators.terminal import to_error
from waybill.sources.wire import parse_envelopes, to_wire


def envelopes(spark, rows):
    """Rows of (id, actors, payload)."""
    data = [(i, a, json.dumps(p, ensure_ascii=False)) for i, a, p in rows]
    df = spark.createDataFrame(data, "id string, actors array<string>, payload string")
    return df.select("id", make_route(F.col("actors")).alias("route"), "payload")


def registry():
    reg = Registry()

    @reg.actor("double")
    def double(p):
        return {**p, "value": p["value"] * 2}

    @reg.actor("plus")
    def plus(p):
        return {**p, "value": p["value"] + 5}

    @reg.actor("echo")
    def echo(p):
        return p

    @reg.actor("fan")
    def fan(p):
        return [{**p, "index": i} for i in range(p["count"])]

    @reg.actor("none")
    def none(p):
        return None

    @reg.actor("boom")
    def boom(p):
        raise ValueError("boom")

    @reg.actor("nested")
    def nested(p):
        return {"nested": p}

    @reg.actor("jump", mode="envelope")
    def jump(e):
        e["route"]["current"] = len(e["route"]["actors"])
        return e

    @reg.actor("far", mode="envelope")
    def far(e):
        e["route"]["current"] = len(e["route"]["actors"]) + 5
        return e

    return reg


def by_id(df):
    return {r["id"]: r for r in df.collect()}


def test_two_steps_give_25(spark):
    row = run(envelopes(spark, [("a", ["double", "plus"], {"value": 10})]), registry(), 2).first()
    assert json.loads(row.payload) == {"value": 25}
    assert (row.terminal, row.route.current, row.error) == ("happy-end", 2, None)


def test_outcomes(spark):
    rows = [
        ("ok", ["echo"], {"test": 1}),
        ("err", ["echo", "boom", "echo"], {"k": [1, None]}),
        ("fan", ["fan", "echo"], {"count": 3}),
        ("fan0", ["fan", "echo"], {"count": 0}),
        ("none", ["none", "boom"], {"x": 1}),
        ("lost", ["nobody"], {}),
        ("chain", ["nested", "nested"], {"p": 1}),
        ("jump", ["jump", "boom"], {}),
    ]
    done = run(envelopes(spark, rows), registry(), 3)
    got = by_id(terminals(to_error(done)))
    assert got["ok"].terminal == "happy-end"
    err = json.loads(got["err"].payload)
    assert err["error"] == "processing_error"
    assert err["original_payload"] == {"k": [1, None]}
    assert err["details"]["type"] == "ValueError" and "boom" in err["details"]["traceback"]
    assert (got["err"].route.current, got["err"].last_actor) == (1, "boom")
    assert {i for i in got if i.startswith("fan-")} == {"fan-1", "fan-2"}
    assert got["fan"].parent_id is None and got["fan-2"].parent_id == "fan"
    assert got["fan0"].terminal == "happy-end" and got["fan0"].route.current == 0
    assert json.loads(got["none"].payload) == {"x": 1} and got["none"].route.current == 0
    assert got["lost"].details.type == "LookupError"
    assert json.loads(got["chain"].payload) == {"nested": {"nested": {"p": 1}}}
    assert (got["jump"].terminal, got["jump"].route.current) == ("happy-end", 2)
    # terminal rows = inputs + sum over fan-out hops of (outputs - 1)
    log = hop_log(done).filter("pos = 0 AND n_outputs > 0")
    extra = log.agg(F.sum(F.col("n_outputs") - 1)).first()[0]
    assert len(got) == len(rows) + extra


def test_cursor_out_of_range_is_rejected_when_validated(spark):
    row = run(envelopes(spark, [("a", ["far"], {})]), registry(), 1).first()
    assert row.details.message == "Invalid output envelope[0/1]: current_out_of_bounds"


def test_cursor_past_the_end_succeeds_without_a_handler(spark):
    env = envelopes(spark, [("a", ["echo"], {})]).withColumn(
        "route", F.col("route").withField("current", F.lit(1))
    )
    row = run(env, registry(), 1).first()
    assert (row.terminal, row.route.current, len(row.trace)) == ("happy-end", 1, 0)


def test_nulls_nesting_and_unicode_survive(spark):
    deep = {"leaf": "日本 שלום привет", "null": None}
    for _ in range(20):
        deep = {"d": deep}
    row = run(envelopes(spark, [("a", ["echo", "echo"], deep)]), registry(), 2).first()
    assert json.loads(row.payload) == deep


def test_broken_bodies_end_in_the_error_terminal(spark):
    raw = spark.createDataFrame(
        [("{invalid json",), ('{"payload":1,"route":{"actors":["echo"]}}',),
         ('{"id":"x","route":{"actors":["echo"]}}',),
         ('{"id":"y","payload":5,"route":{"actors":["echo"]}}',)], "body string")
    rows = run(parse_envelopes(raw), registry(), 1).collect()
    got = {(r.id, r.reason): r for r in rows}
    assert got[("", "invalid_json")].route.actors == ["error-end"]
    assert got[("", "invalid_json")].payload is None
    assert got[("", "missing_id")].terminal == "error-end"
    assert got[("x", "missing_payload")].error == "msg_parsing_error"
    assert got[("y", None)].terminal == "happy-end"


def test_wire_leaves_out_absent_parts(spark):
    body = to_wire(
        envelopes(spark, [("a", ["echo"], {"k": None})])
        .withColumn("parent_id", F.lit(None).cast("string"))
        .withColumn("headers", F.lit(None).cast("map<string,string>"))
    ).first()[0]
    assert json.loads(body) == {
        "id": "a", "route": {"actors": ["echo"], "current": 0}, "payload": {"k": None}
    }


def test_fifteen_hops_in_rounds(spark):
    names = [f"h{i}" for i in range(15)]
    reg = Registry()
    for n in names:
        reg.actor(n)(lambda p, n=n: {"seen": p["seen"] + [n]})
    row = run(envelopes(spark, [("a", names, {"seen": []})]), reg, 15, unroll=5).first()
    assert json.loads(row.payload)["seen"] == names
    assert [t.hop for t in row.trace] == list(range(1, 16))


def test_max_hops_leaves_no_row_behind(spark):
    env = envelopes(spark, [("a", ["echo"] * 5, {}), ("b", ["echo"], {})])
    got = by_id(run(env, registry(), 2))
    assert got["a"].error == "max_hops exceeded" and got["b"].terminal == "happy-end"


def test_class_actor_state_lives_per_worker(spark):
    reg = Registry()

    @reg.actor_class("count")
    class Counter:
        def __init__(self, start=0):
            self.n = start

        def process(self, p):
            self.n += 1
            return {"n": self.n}

    env = envelopes(spark, [(f"e{i}", ["count"], {}) for i in range(6)]).coalesce(1)
    seen = sorted(json.loads(r.payload)["n"] for r in run(env, reg, 1).collect())
    assert seen == list(range(seen[0], seen[0] + 6))


def test_class_actor_needs_defaults():
    with pytest.raises(TypeError, match="needs defaults for: size"):
        @Registry().actor_class("bad")
        class Bad:
            def __init__(self, size):
                pass

            def process(self, p):
                return p


def test_handlers_by_path():
    reg = Registry()
    reg.load("dump", "json.dumps")
    reg.load("pretty", "json.JSONEncoder.encode")
    assert reg.actors["dump"].call is json.dumps and reg.actors["pretty"].build is not None
    with pytest.raises(ValueError):
        reg.load("x", "nodots")
    with pytest.raises(ValueError, match="duplicate"):
        reg.load("dump", "json.dumps")


def test_time_limit_only_costs_the_slow_row(spark):
    reg = Registry()

    @reg.actor("nap", timeout=0.2)
    def nap(p):
        time.sleep(p["s"])
        return p

    env = envelopes(spark, [("slow", ["nap"], {"s": 5}), ("fast", ["nap"], {"s": 0})]).coalesce(1)
    got = by_id(run(env, reg, 1))
    assert got["slow"].error == "Runtime timeout exceeded after 0.2s"
    assert got["slow"].trace[0].error_type == "execution_error"
    assert got["fast"].terminal == "happy-end"


def test_fanout_names_the_hop_on_request(spark):
    env = envelopes(spark, [("a", ["fan", "fan"], {"count": 2})])
    kept = [r.id for r in run(env, registry(), 2).collect()]
    named = [r.id for r in run(env, registry(), 2, on_collision="hop").collect()]
    assert sorted(kept) == ["a", "a-1", "a-1", "a-1-1"]
    assert len(set(named)) == len(named) == 4


def test_step_refuses_rows_of_other_actors(spark):
    env = envelopes(spark, [("a", ["echo", "plus"], {}), ("b", ["plus"], {"value": 1})])
    got = by_id(step(env, registry(), "echo"))
    assert got["a"].dest == "plus"
    assert got["b"].dest == "error-end"
    assert got["b"].failure.error == "Route mismatch: expected 'echo', got 'plus'"


def test_typed_and_python_actors_mix(spark):
    reg = Registry()
    reg.column_actor("col", lambda p: p.withField("n", p["n"] + 1),
                     fails=lambda p: F.when(p["n"] > 100, "too big"))

    @reg.actor("py")
    def py(p):
        return {**p, "tag": f"#{p['n']}"}

    env = spark.createDataFrame([("a", 1), ("b", 200)], "id string, n bigint").select(
        "id", make_route(F.array(F.lit("col"), F.lit("py"), F.lit("col"))).alias("route"),
        F.struct("n", F.lit(None).cast("string").alias("tag")).alias("payload"),
    )
    got = by_id(run(env, reg, 3))
    assert tuple(got["a"].payload) == (3, "#2")
    assert got["b"].details.message == "too big" and got["b"].payload.n == 200


def test_hops_need_no_shuffle(spark):
    reg = registry()
    done = run(envelopes(spark, [("a", ["fan", "double", "plus"], {"count": 1})]), reg, 3)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("ArrowEvalPython") == 3


def test_no_actor_at_all(spark):
    row = run(envelopes(spark, [("a", ["echo"], {})]), Registry(), 1).first()
    assert (row.terminal, row.details.type) == ("error-end", "LookupError")


def test_run_without_a_hop_limit(spark):
    """Hops go on until no row is active; a route that rewrites itself ends by max_visits."""
    reg = Registry()
    for k in range(14):
        reg.column_actor(f"c{k}", lambda p: p.withField("n", p["n"] + 1))
    reg.column_actor("loop", lambda p: p.withField("n", p["n"] + 1),
                     reroute=lambda value, route: route.withField(
                         "actors", F.array_append(route["actors"], F.lit("loop"))))
    long = spark.createDataFrame([(f"e{i}", [f"c{k}" for k in range(i)]) for i in (1, 3, 9, 14)],
                                 "id string, actors array<string>")
    env = long.unionByName(spark.createDataFrame([("x", ["loop"])], long.schema)).select(
        "id", make_route(F.col("actors")).alias("route"), F.struct(F.lit(0).alias("n")).alias("payload"))
    done = {r.id: r for r in run(env, reg, unroll=4, max_visits=7).collect()}
    assert {i: done[f"e{i}"].payload.n for i in (1, 3, 9, 14)} == {1: 1, 3: 3, 9: 9, 14: 14}
    assert all(done[f"e{i}"].terminal == "happy-end" for i in (1, 3, 9, 14))
    assert (done["x"].terminal, done["x"].payload.n) == ("error-end", 7)
    assert len(done["e14"].trace) == 14


def raising():
    """Column actors that raise on some rows, each in another way."""
    reg = Registry()
    add = partial(reg.column_actor, guard=True)
    # the same division several times: no part of it may run outside the trial
    add("divide", lambda p: p.withField("n", (p["n"] / p["d"] + p["n"] / p["d"]).cast(
        "bigint")).withField("d", (p["n"] / p["d"]).cast("int")))
    add("number", lambda p: p.withField("n", p["s"].cast("bigint") + 1))
    add("third", lambda p: F.transform(F.split(p["s"], ","), lambda s: p.withField(
        "s", F.element_at(F.split(s, "-"), 3))), many=True)
    add("shout", lambda p: F.when(p["s"] == "no", F.raise_error("no")).otherwise(p))
    add("checked", lambda p: p.withField("n", p["n"] % p["d"]),
                     fails=lambda p: F.when(p["d"] == 0, "zero"))
    add("check", lambda p: p, fails=lambda p: F.when(p["n"] / p["d"] > 9, "big"))
    add("turn", lambda p: p, reroute=lambda p, r: r.withField(
        "actors", F.array_append(r["actors"], F.element_at(F.split(p["s"], "-"), 2))))
    return reg


RAISING = [  # id, actor, n, d, s, message of the error
    ("d0", "divide", 4, 0, "", RAISED), ("d1", "divide", 4, 2, "", None),
    ("d2", "divide", None, 0, "", None),
    ("n0", "number", 0, 0, "x", RAISED), ("n1", "number", 0, 0, "41", None),
    ("n2", "number", 0, 0, None, None),
    ("t0", "third", 0, 0, "a-b-c,a-b", RAISED), ("t1", "third", 0, 0, "a-b-c,a-b-d", None),
    ("s0", "shout", 0, 0, "no", RAISED), ("s1", "shout", 0, 0, "yes", None),
    ("c0", "checked", 1, 0, "", "zero"), ("c1", "checked", 7, 4, "", None),
    ("f0", "check", 1, 0, "", RAISED), ("f1", "check", 10, 1, "", "big"),
    ("f2", "check", 1, 1, "", None),
    ("r0", "turn", 0, 0, "a", RAISED), ("r1", "turn", 0, 0, "a-shout", None),
]


def raising_rows(spark):
    return spark.createDataFrame(
        [r[:5] for r in RAISING], "id string, actor string, n bigint, d int, s string"
    ).repartition(3).select(
        "id", make_route(F.array("actor")).alias("route"), F.struct("n", "d", "s").alias("payload"))


@pytest.mark.parametrize("codegen", ["true", "false"])
def test_expressions_that_raise_are_error_rows(spark, codegen):
    spark.conf.set("spark.sql.codegen.wholeStage", codegen)
    try:
        done = run(raising_rows(spark), raising(), 2)
        rows = {(r.id, r.payload.s): r for r in done.collect()}
        # whichever columns are read, the same rows end as errors
        ends = {(r.id, r.terminal) for r in done.select("id", "terminal").collect()}
        bad = {r.id for r in done.filter("terminal = 'error-end'").select("id").collect()}
        traced = {r.id for r in hop_log(done).filter("outcome = 'runtime_error'").select("id").collect()}
        n_rows = done.count()
    finally:
        spark.conf.unset("spark.sql.codegen.wholeStage")
    want = {r[0] for r in RAISING if r[5] is not None}
    assert bad == traced == {i for i, t in ends if t == "error-end"} == want
    assert n_rows == len(rows) == len(RAISING) + 1  # t1 has two outputs
    told = {i: r.details.message for (i, _), r in rows.items() if r.terminal == "error-end"}
    assert told == {r[0]: r[5] for r in RAISING if r[5] is not None}
    by = {i: r for (i, _), r in rows.items()}
    for i, actor, n, d, s, message in RAISING:  # an error row keeps its input and its actor
        if message is not None:
            assert (tuple(by[i].payload), by[i].last_actor) == ((n, d, s), actor)
    assert tuple(by["d1"].payload)[:2] == (4, 2) and by["n1"].payload.n == 42
    assert (by["d2"].payload.n, by["n2"].payload.n, by["c1"].payload.n) == (None, None, 3)
    assert by["r1"].route.actors == ["turn", "shout"] and by["r1"].route.current == 2
    assert {s for i, s in rows if i.startswith("t1")} == {"c", "d"}


def test_unguarded_expressions_are_not_tried(spark):
    reg = Registry()
    reg.column_actor("plus", lambda p: p.withField("n", p["n"] + 1))
    env = raising_rows(spark).withColumn("route", make_route(F.array(F.lit("plus"))))
    done = run(env, reg, 1)
    assert "tryeval" not in done._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id: r.payload.n for r in done.collect()} == {
        r[0]: None if r[2] is None else r[2] + 1 for r in RAISING}


def test_calls_hold_few_rows_at_a_time(spark):
    """A large Arrow batch is called and handed on in small parts."""
    reg, seen, n = Registry(), [], 3 * CALLS + 5

    @reg.actor("echo")
    def echo(p):
        seen.append(p["i"])
        return p

    bodies = [None if i == 7 else json.dumps({"i": i}) for i in range(n)]
    parts = python_call(reg).func(iter([(pa.array(["echo"] * n), pa.array(bodies))]))
    first = next(parts)
    assert len(seen) == CALLS - 1 and len(first) == CALLS
    rows = [r for part in (first, *parts) for r in part.to_pylist()]
    assert [r and r["outs"] for r in rows] == [b and [b] for b in bodies]
