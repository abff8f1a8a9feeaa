"""Queries over the given tables, each with its SQL twin."""

from waybill.plans.registry import ORACLE, QUERIES
from waybill.plans import reporting, routing, storing, streams, submitting, tracking  # noqa: F401

__all__ = ["ORACLE", "QUERIES"]
