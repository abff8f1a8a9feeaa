"""Requests and a catalogue of tools become envelopes.

The catalogue is three tables: ``tools(name, route, template, progress, timeout,
metadata)``, ``params(tool, name, type, required, default, options)`` and
``templates(name, actors)``. They are joined without hints: Spark broadcasts
them while they are below its size threshold and shuffles beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions.payload import json_type, part
from waybill.functions.route import make_route, merge_maps
from waybill.functions.text import deadline

# Fixed values
DEFAULT_TIMEOUT_SEC = 300
PARAMETER_TYPES = ("string", "number", "integer", "boolean", "object", "array")


def resolve_routes(tools: DataFrame, templates: DataFrame) -> DataFrame:
    """Tools with ``actors``: explicit ones, else the template's; else a ``route_error``."""
    lookup = templates.select(F.col("name").alias("template"), F.col("actors").alias("__found"))
    explicit = F.when(F.size("route") > 0, F.col("route"))
    found = F.when(F.size("__found") > 0, F.col("__found"))
    named = F.coalesce(F.col("template"), F.lit("")) != ""
    return (
        tools.join(lookup, "template", "left")
        .withColumn("actors", F.coalesce(explicit, found))
        .withColumn(
            "route_error",
            F.when(F.col("actors").isNotNull(), F.lit(None).cast("string"))
            .when(named & F.col("__found").isNull(),
                  F.format_string("route template \"%s\" not found", "template"))
            .otherwise("route has no actors or template"),
        )
        .drop("__found")
    )


def resolve_options(
    tools: DataFrame,
    progress: bool | None = None,
    timeout: int | None = None,
    metadata: dict[str, str] | None = None,
) -> DataFrame:
    """Tool options over defaults over built-in values; metadata maps are merged."""
    extra = F.create_map(*[F.lit(x) for kv in (metadata or {}).items() for x in kv])
    return (
        tools.withColumn(
            "progress", F.coalesce("progress", F.lit(progress).cast("boolean"), F.lit(False))
        )
        .withColumn(
            "timeout_sec",
            F.coalesce("timeout", F.lit(timeout).cast("int"), F.lit(DEFAULT_TIMEOUT_SEC)),
        )
        .withColumn("metadata", merge_maps(extra.cast("map<string,string>"), F.col("metadata")))
    )


def param_sets(params: DataFrame) -> DataFrame:
    """One row per tool with its declarations; bounded by the catalogue."""
    spec = F.struct("name", "type", "required", "default", "options")
    return params.groupBy("tool").agg(F.sort_array(F.collect_list(spec)).alias("specs"))


def missing_params(arguments: Column, specs: Column) -> Column:
    """Names of required parameters absent from the JSON arguments.

    A key that is present with a JSON null counts as present.
    """
    keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
    required = F.transform(F.filter(specs, lambda s: s["required"]), lambda s: s["name"])
    return F.array_except(F.coalesce(required, F.array().cast("array<string>")), keys)


def type_matches(value: Column, wanted: Column) -> Column:
    """Does a variant have the declared type? Integers are numbers too."""
    kind = json_type(value)
    return (kind == wanted) | ((wanted == "number") & (kind == "integer"))


def argument_errors(arguments: Column, specs: Column) -> Column:
    """Strict check: ``name:type`` and ``name:option`` of every argument that does not fit."""
    values = F.from_json(arguments, "map<string,variant>")

    def error(spec: Column) -> Column:
        value = F.try_element_at(values, spec["name"])
        text = F.try_variant_get(value, "$", "string")
        return (
            F.when(value.isNull(), F.lit(None).cast("string"))
            .when(~type_matches(value, spec["type"]), F.concat(spec["name"], F.lit(":type")))
            .when(
                (F.size(spec["options"]) > 0) & ~F.array_contains(spec["options"], text),
                F.concat(spec["name"], F.lit(":option")),
            )
        )

    return F.coalesce(
        F.array_compact(F.transform(specs, error)), F.array().cast("array<string>")
    )


def fits(value: Column, declared: dict) -> Column:
    """Strict check of a variant against a declaration, nested parts included.

    ``declared`` is ``{"type": ..., "properties": {name: declared},
    "items": declared}``; absent properties are fine.
    """
    if declared["type"] not in PARAMETER_TYPES:
        raise ValueError(f"invalid type {declared['type']!r}")
    ok = type_matches(value, F.lit(declared["type"]))
    for name, inner in declared.get("properties", {}).items():
        piece = part(value, f"$.{name}")
        ok = ok & (piece.isNull() | fits(piece, inner))
    if "items" in declared:
        items = F.try_variant_get(value, "$", "array<variant>")
        ok = ok & F.forall(items, lambda v: fits(v, declared["items"]))
    return F.coalesce(ok, F.lit(False))


def fill_defaults(arguments: Column, specs: Column) -> Column:
    """Arguments plus the declared defaults (JSON texts) of absent keys."""
    given = F.coalesce(F.from_json(arguments, "map<string,variant>"),
                       F.create_map().cast("map<string,variant>"))
    with_default = F.filter(
        specs, lambda s: s["default"].isNotNull() & ~F.map_contains_key(given, s["name"])
    )
    added = F.map_from_entries(
        F.transform(with_default, lambda s: F.struct(s["name"], F.try_parse_json(s["default"])))
    )
    return F.when(F.size(with_default) > 0, F.to_json(F.map_concat(given, added))).otherwise(
        arguments
    )


def submit(
    requests: DataFrame,
    tools: DataFrame,
    params: DataFrame,
    templates: DataFrame,
    *,
    strict: bool = False,
    progress: bool | None = None,
    timeout: int | None = None,
) -> DataFrame:
    """Requests ``(id, tool, arguments, created_at)`` as envelopes with a ``rejected`` reason.

    ``rejected`` is null for accepted requests. ``strict`` also checks types and
    options and fills defaults.
    """
    catalogue = resolve_options(resolve_routes(tools, templates), progress, timeout)
    catalogue = catalogue.join(
        param_sets(params).withColumnRenamed("tool", "name"), "name", "left"
    ).select(
        F.col("name").alias("tool"), F.lit(True).alias("__known"), "actors", "route_error",
        "progress", "timeout_sec", F.col("metadata").alias("tool_metadata"), "specs",
    )
    arguments = F.col("arguments")
    joined = requests.join(catalogue, "tool", "left").withColumn(
        "__missing", missing_params(arguments, F.col("specs"))
    )
    rejected = (
        F.when(F.col("__known").isNull(), F.concat(F.lit("unknown tool: "), F.coalesce("tool", F.lit(""))))
        .when(F.col("route_error").isNotNull(),
              F.concat(F.lit("route error: "), F.col("route_error")))
        .when(F.size("__missing") > 0,
              F.concat(F.lit("missing required parameter: "), F.get("__missing", F.lit(0))))
    )
    payload = arguments
    if strict:
        joined = joined.withColumn("__errors", argument_errors(arguments, F.col("specs")))
        rejected = rejected.when(
            F.size("__errors") > 0,
            F.concat(F.lit("invalid argument: "), F.get("__errors", F.lit(0))),
        )
        payload = F.coalesce(fill_defaults(arguments, F.col("specs")), arguments)
    job = F.create_map(F.lit("job_id"), F.col("id"))
    return joined.select(
        "id",
        F.lit(None).cast("string").alias("parent_id"),
        make_route(F.col("actors"), 0, job).alias("route"),
        F.lit(None).cast("map<string,string>").alias("headers"),
        payload.alias("payload"),
        "tool",
        "progress",
        "timeout_sec",
        "tool_metadata",
        "created_at",
        deadline(F.col("created_at"), F.col("timeout_sec")).alias("deadline"),
        rejected.alias("rejected"),
    )
