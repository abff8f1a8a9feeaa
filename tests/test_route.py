import pytest
from pyspark.sql import functions as F

from waybill.functions import route as R


def routes(spark, rows):
    df = spark.createDataFrame(rows, "actors array<string>, current int")
    return df.select(R.make_route(F.col("actors"), F.col("current")).alias("r"))


@pytest.mark.parametrize(
    "actors,current,now,following,more,dest,filed",
    [
        (["a", "b", "c"], 0, "a", "b", True, "a", "c"),
        (["a", "b", "c"], 1, "b", "c", True, "b", "b"),
        (["a", "b", "c"], 2, "c", "", False, "c", "c"),
        (["a", "b", "c"], 3, "", "", False, "happy-end", "c"),
        (["a"], 7, "", "", False, "happy-end", "a"),
        ([], 0, "", "", False, "happy-end", "unknown"),
    ],
)
def test_cursor(spark, actors, current, now, following, more, dest, filed):
    r = F.col("r")
    row = routes(spark, [(actors, current)]).select(
        R.current_actor(r), R.next_actor(r), R.has_next(r), R.destination(r), R.last_actor(r),
        R.advance(r)["current"],
    ).first()
    assert tuple(row) == (now, following, more, dest, filed, current + 1)


REWRITES = [
    # a passed step, the current one, or both, are replaced or moved
    (["load", "clean", "rank", "save"], 2, ["load", "scrub", "rank", "save"], 2, False),
    (["load", "clean"], 1, ["load", "rank"], 1, False),
    (["load", "clean", "rank"], 1, ["clean", "load", "rank"], 1, False),
    (["load"], 0, ["pre", "load"], 1, False),
    # steps that lie ahead are added, replaced, or dropped
    (["load"], 0, ["load", "rank", "save"], 0, True),
    (["load", "clean", "rank", "save", "tell"], 2, ["load", "clean", "rank", "tell"], 2, True),
    (["load", "clean", "rank"], 0, ["load"], 0, True),
]


def test_rewrite_guards(spark):
    df = spark.createDataFrame(
        REWRITES, "a array<string>, i int, b array<string>, j int, ok boolean"
    ).select(
        R.make_route(F.col("a"), F.col("i")).alias("x"),
        R.make_route(F.col("b"), F.col("j")).alias("y"),
        "ok",
    )
    got = df.select("ok", (R.prefix_kept(F.col("x"), F.col("y"))
                           & R.position_kept(F.col("x"), F.col("y"))).alias("kept"))
    assert all(r.ok == r.kept for r in got.collect())


def test_rewrites(spark):
    r = F.col("r")
    row = routes(spark, [(["a", "b", "c"], 1)]).select(
        R.insert_next(r, "x", "y")["actors"], R.replace_tail(r, "z")["actors"],
        R.replace_tail(r)["actors"], R.append_route(r, "q")["actors"],
        R.route_if(F.lit(False), r, "x")["actors"],
        R.route_if(F.lit(None).cast("boolean"), r, "x")["actors"],
    ).first()
    assert list(row) == [
        ["a", "b", "x", "y", "c"], ["a", "b", "z"], ["a", "b"], ["a", "b", "c", "q"],
        ["a", "b", "c"], ["a", "b", "c"],
    ]


def test_actor_name_from_index(spark):
    df = spark.createDataFrame(
        [(["a", "b"], 1), (["a", "b"], None), ([], 0), (["a"], 5), (["a"], -1)],
        "actors array<string>, i int",
    )
    got = [r[0] for r in df.select(R.actor_name(F.col("actors"), F.col("i"))).collect()]
    assert got == ["b", None, None, None, None]


def test_fanout_ids(spark):
    df = spark.createDataFrame([(0, 1), (0, 3), (2, 3)], "pos int, n int")
    id_, none = F.lit("e"), F.lit(None).cast("string")
    got = df.select(
        R.fanout_id(id_, F.col("pos"), F.col("n")),
        R.fanout_parent(id_, none, F.col("pos"), F.col("n")),
        R.fanout_id(id_, F.col("pos"), F.col("n"), hop=4),
    ).collect()
    assert [tuple(r) for r in got] == [
        ("e", None, "e"), ("e", None, "e"), ("e-2", "e", "e-h4-2"),
    ]
