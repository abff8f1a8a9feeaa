"""Frame validation: the first broken rule becomes a reason code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waybill.functions.payload import json_type, part
from waybill.functions.route import position_kept, prefix_kept
from waybill.schema import ROUTE


def text_map(doc: Column, path: str) -> Column:
    """Object at a path as a map; strings stay plain, other values become JSON text."""
    raw = F.try_variant_get(doc, path, "map<string,variant>")
    return F.transform_values(
        raw, lambda _, v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))
    )


def route_of(doc: Column) -> Column:
    """Typed route of a parsed envelope; a missing cursor counts as 0."""
    return F.struct(
        F.try_variant_get(doc, "$.route.actors", "array<string>").alias("actors"),
        F.coalesce(F.try_variant_get(doc, "$.route.current", "int"), F.lit(0)).alias("current"),
        text_map(doc, "$.route.metadata").alias("metadata"),
    ).cast(ROUTE)


def frame_reason(doc: Column, before: Column | None = None) -> Column:
    """Reason code of the first rule a parsed envelope breaks, null when it is fine.

    ``before`` is the input route; giving it adds the two rewrite guards that
    apply to outputs.
    """
    route = part(doc, "$.route")
    actors = part(doc, "$.route.actors")
    current = part(doc, "$.route.current")
    headers = part(doc, "$.headers")
    id_ = part(doc, "$.id")
    typed = route_of(doc)
    reason = (
        F.when(part(doc, "$.payload").isNull(), "missing_payload")
        .when(route.isNull(), "missing_route")
        .when(json_type(route) != "object", "route_not_object")
        .when(actors.isNull(), "missing_actors")
        .when(json_type(actors) != "array", "actors_not_list")
        .when(current.isNotNull() & (json_type(current) != "integer"), "current_not_integer")
        .when(F.size(typed["actors"]) == 0, "empty_actors")
        .when(
            (typed["current"] < 0) | (typed["current"] > F.size(typed["actors"])),
            "current_out_of_bounds",
        )
        .when(headers.isNotNull() & (json_type(headers) != "object"), "headers_not_object")
    )
    if before is not None:
        reason = reason.when(~prefix_kept(before, typed), "processed_prefix_changed").when(
            ~position_kept(before, typed), "position_changed"
        )
    return reason.when(id_.isNotNull() & (json_type(id_) != "string"), "id_not_string")


def typed_reason(id_: Column, route: Column) -> Column:
    """The rules that a typed envelope can still break."""
    actors, current = route["actors"], route["current"]
    return (
        F.when(F.coalesce(id_, F.lit("")) == "", "missing_id")
        .when(route.isNull(), "missing_route")
        .when(actors.isNull(), "missing_actors")
        .when(F.size(actors) == 0, "empty_actors")
        .when((current < 0) | (current > F.size(actors)), "current_out_of_bounds")
    )
