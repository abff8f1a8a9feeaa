"""Routed envelope pipelines on Spark: every row carries its own route."""

from waybill.operators.actors import Registry
from waybill.operators.hops import hop_log, run, step, terminals

__all__ = ["Registry", "hop_log", "run", "step", "terminals"]
