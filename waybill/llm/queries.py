"""All queries of this folder."""

from waybill.llm import queries_files, queries_models, queries_native, queries_pairs  # noqa: F401
from waybill.llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
