"""Payload columns: JSON text, variants and typed structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ANY_MAP = "map<string,variant>"


def enrich(payload: Column, **fields: Column) -> Column:
    """Typed payload with added or replaced fields."""
    for name, value in fields.items():
        payload = payload.withField(name, value)
    return payload


def enrich_json(payload: Column, **fields: Column) -> Column:
    """JSON payload with added or replaced keys (needs LAST_WIN map keys)."""
    added = F.from_json(F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]),
                                  {"ignoreNullFields": "false"}), ANY_MAP)
    return F.to_json(F.map_concat(F.from_json(payload, ANY_MAP), added))


def part(doc: Column, path: str) -> Column:
    """A piece of a variant: null when absent, a variant null when JSON null."""
    return F.try_variant_get(doc, path, "variant")


# JSON type names by the leading word of a variant's schema.
JSON_TYPES = {
    "OBJECT": "object",
    "ARRAY": "array",
    "STRING": "string",
    "BOOLEAN": "boolean",
    "BIGINT": "integer",
    "DECIMAL": "number",
    "DOUBLE": "number",
    "FLOAT": "number",
    "VOID": "null",
}


def json_type(value: Column) -> Column:
    """JSON type name of a variant value; null when there is no value."""
    names = F.create_map(*[F.lit(x) for pair in JSON_TYPES.items() for x in pair])
    word = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    return F.try_element_at(names, word)


def byte_size(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")
