"""Route cursor, destinations, rewrites and lineage ids as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waybill.schema import HAPPY_END, ROUTE

QUEUE_PREFIX = "queue-"


def make_route(actors: Column, current=0, metadata: Column | None = None) -> Column:
    """A route value with the field types of the envelope frame."""
    current = current if isinstance(current, Column) else F.lit(current)
    metadata = F.lit(None) if metadata is None else metadata
    return F.struct(
        actors.alias("actors"), current.alias("current"), metadata.alias("metadata")
    ).cast(ROUTE)


def current_actor(route: Column) -> Column:
    """Actor under the cursor, '' when the cursor is out of range."""
    return F.coalesce(F.get(route["actors"], route["current"]), F.lit(""))


def next_actor(route: Column) -> Column:
    return F.coalesce(F.get(route["actors"], route["current"] + 1), F.lit(""))


def has_next(route: Column) -> Column:
    return route["current"] + 1 < F.size(route["actors"])


def advance(route: Column) -> Column:
    return route.withField("current", route["current"] + 1)


def destination(route: Column, happy_end: str = HAPPY_END) -> Column:
    """Actor under the cursor, or the success terminal once there is none."""
    actor = current_actor(route)
    return F.when(actor != "", actor).otherwise(F.lit(happy_end))


def queue_name(actor: Column, prefix: str = QUEUE_PREFIX) -> Column:
    return F.concat(F.lit(prefix), actor)


def _through_cursor(actors: Column, cursor: Column) -> Column:
    return F.slice(actors, F.lit(1), F.greatest(cursor + 1, F.lit(0)))


def _after_cursor(actors: Column, cursor: Column) -> Column:
    rest = F.greatest(F.size(actors) - cursor - 1, F.lit(0))
    return F.slice(actors, F.greatest(cursor, F.lit(-1)) + 2, rest)


def prefix_kept(before: Column, after: Column) -> Column:
    """Did a rewrite keep every actor up to and including the cursor?"""
    cursor = before["current"]
    return _through_cursor(after["actors"], cursor) == _through_cursor(before["actors"], cursor)


def position_kept(before: Column, after: Column) -> Column:
    """Is the actor at the input position still the same one?"""
    cursor = before["current"]
    beyond = cursor >= F.size(after["actors"])
    return beyond | F.get(after["actors"], cursor).eqNullSafe(F.get(before["actors"], cursor))


def insert_next(route: Column, *actors: str) -> Column:
    cursor = route["current"]
    added = F.array(*[F.lit(a) for a in actors])
    return route.withField(
        "actors",
        F.concat(
            _through_cursor(route["actors"], cursor), added, _after_cursor(route["actors"], cursor)
        ),
    )


def replace_tail(route: Column, *actors: str) -> Column:
    tail = F.array(*[F.lit(a) for a in actors]).cast("array<string>")
    return route.withField("actors", F.concat(_through_cursor(route["actors"], route["current"]), tail))


def append_route(route: Column, *actors: str) -> Column:
    return route.withField(
        "actors", F.concat(route["actors"], F.array(*[F.lit(a) for a in actors]))
    )


def route_if(condition: Column, route: Column, *actors: str) -> Column:
    """Insert the actors next when the condition holds."""
    return F.when(F.coalesce(condition, F.lit(False)), insert_next(route, *actors)).otherwise(route)


def actor_name(actors: Column, idx: Column) -> Column:
    """Actor at an index, null when the index is null or out of range."""
    return F.get(actors, idx)


def last_actor(route: Column, failed: Column | None = None) -> Column:
    """Actor a terminal row is filed under.

    Success rows: the cursor's actor when 0 < cursor < size, else the last of
    the route. Failed rows: the actor under the cursor.
    """
    actors, cursor = route["actors"], route["current"]
    inside = (cursor > 0) & (cursor < F.size(actors))
    filed = F.when(inside, F.get(actors, cursor)).otherwise(F.try_element_at(actors, F.lit(-1)))
    if failed is not None:
        filed = F.when(failed & (current_actor(route) != ""), current_actor(route)).otherwise(filed)
    return F.coalesce(filed, F.lit("unknown"))


def fanout_id(id_: Column, pos: Column, n: Column, hop: int | None = None) -> Column:
    """Output 0 keeps the id; later outputs get a suffix.

    With ``hop`` the suffix names the hop, so that two fan-outs of one id along
    one route cannot mint the same id.
    """
    infix = "-" if hop is None else f"-h{hop}-"
    return F.when((n > 1) & (pos > 0), F.concat(id_, F.lit(infix), pos.cast("string"))).otherwise(id_)


def fanout_parent(id_: Column, parent: Column, pos: Column, n: Column) -> Column:
    """Children point at the fanned-out id; other rows keep the parent they had."""
    return F.when((n > 1) & (pos > 0), id_).otherwise(parent)


def visits(route: Column) -> Column:
    """How often the current actor occurs in the processed part of the route."""
    actor = current_actor(route)
    seen = _through_cursor(route["actors"], route["current"])
    return F.size(F.filter(seen, lambda a: a == actor))


def visit_guard(route: Column, limit: int = 10) -> Column:
    """True when a step has been visited more often than the limit."""
    return visits(route) > limit


def merge_maps(*maps: Column) -> Column:
    """Later maps win; null maps count as empty."""
    empty = F.create_map().cast("map<string,string>")
    return F.map_concat(*[F.coalesce(m, empty) for m in maps])


def job_id(route: Column, id_: Column) -> Column:
    """Tracked id of an envelope: ``metadata.job_id``, else its own id."""
    return F.coalesce(F.try_element_at(route["metadata"], F.lit("job_id")), id_)
