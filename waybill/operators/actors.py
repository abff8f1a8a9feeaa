"""Actors: named steps a route can point at.

A *column actor* is a Catalyst expression. A *payload actor* is a Python
function from payload to payload(s), an *envelope actor* also sees and rewrites
the route, and a *class actor* is built once per Python worker. Python actors
run in one Arrow function per hop that only receives the actor name and a JSON
body; routing, fan-out, validation and lineage stay in the plan.
"""

from __future__ import annotations

import inspect
import json
import signal
import traceback
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime, timezone
from importlib import import_module
from time import perf_counter
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waybill.schema import DETAILS

PAYLOAD, ENVELOPE, COLUMN = "payload", "envelope", "column"

CALL_RESULT = T.StructType(
    [
        T.StructField("outs", T.ArrayType(T.StringType())),
        T.StructField("error", T.StringType()),
        T.StructField("details", DETAILS),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("duration_s", T.DoubleType()),
    ]
)


@dataclass(frozen=True)
class Actor:
    name: str
    mode: str
    call: Callable | None = None
    build: Callable | None = None
    timeout: float | None = None
    many: bool = False
    fails: Callable | None = None
    reroute: Callable | None = None
    guard: bool = False


@dataclass
class Registry:
    """Actor name -> handler. Plain driver-side configuration."""

    actors: dict[str, Actor] = field(default_factory=dict)
    token: str = field(default_factory=lambda: uuid.uuid4().hex)

    def _add(self, actor: Actor) -> None:
        if not actor.name:
            raise ValueError("actor name cannot be empty")
        if actor.name in self.actors:
            raise ValueError(f"duplicate actor name: {actor.name!r}")
        if actor.timeout is not None and actor.timeout < 0:
            raise ValueError("timeout cannot be negative")
        self.actors[actor.name] = actor

    def actor(self, name: str, mode: str = PAYLOAD, timeout: float | None = None):
        """Register a function: payload -> payload(s), or envelope -> envelope(s)."""
        if mode not in (PAYLOAD, ENVELOPE):
            raise ValueError(f"mode must be {PAYLOAD!r} or {ENVELOPE!r}, not {mode!r}")

        def register(fn: Callable) -> Callable:
            self._add(Actor(name, mode, call=fn, timeout=timeout))
            return fn

        return register

    def actor_class(self, name: str, method: str = "process", mode: str = PAYLOAD,
                    timeout: float | None = None):
        """Register a class; one instance per Python worker, default arguments only."""

        def register(cls: type) -> type:
            check_defaults(cls)
            if not callable(getattr(cls, method, None)):
                raise TypeError(f"{cls.__name__} has no method {method!r}")
            build = lambda: getattr(cls(), method)
            self._add(Actor(name, mode, build=build, timeout=timeout))
            return cls

        return register

    def column_actor(self, name: str, expr: Callable[[Column], Column], *, many: bool = False,
                     fails: Callable[[Column], Column] | None = None,
                     reroute: Callable[[Column, Column], Column] | None = None,
                     guard: bool = False) -> None:
        """Register a Catalyst expression from payload column to payload column.

        A null result means no output. With ``many`` the expression yields an
        array of payloads. ``fails`` gives an error text or null. ``reroute``
        maps (new payload, route) to a rewritten route; the cursor is advanced
        afterwards.

        With ``guard`` a row on which one of these expressions raises (ANSI
        arithmetic, casts, indices, ``raise_error``) becomes an error row and the
        job goes on; each expression is evaluated once more, on trial. Without it
        such a row fails the job. Python functions cannot be tried.
        """
        self._add(Actor(name, COLUMN, call=expr, many=many, fails=fails, reroute=reroute,
                        guard=guard))

    def load(self, name: str, path: str, **options) -> None:
        """Register ``module.function`` or ``module.Class.method``."""
        parts = path.split(".")
        if len(parts) < 2:
            raise ValueError(f"handler path needs module and name: {path!r}")
        try:
            target = getattr(import_module(".".join(parts[:-1])), parts[-1])
            self.actor(name, **options)(target)
        except ModuleNotFoundError:
            cls = getattr(import_module(".".join(parts[:-2])), parts[-2])
            self.actor_class(name, method=parts[-1], **options)(cls)

    def names(self, *modes: str) -> list[str]:
        return [a.name for a in self.actors.values() if a.mode in modes]

    def columns(self) -> list[Actor]:
        return [a for a in self.actors.values() if a.mode == COLUMN]

    def has_python(self) -> bool:
        return bool(self.names(PAYLOAD, ENVELOPE))


def check_defaults(cls: type) -> None:
    """Constructor arguments must all have defaults."""
    varied = (inspect.Parameter.VAR_POSITIONAL, inspect.Parameter.VAR_KEYWORD)
    needed = [
        p.name
        for p in inspect.signature(cls).parameters.values()
        if p.default is inspect.Parameter.empty and p.kind not in varied
    ]
    if needed:
        raise TypeError(f"{cls.__name__}() needs defaults for: {', '.join(needed)}")


class RowTimeout(BaseException):
    """A handler ran longer than its per-row limit.

    Not an ``Exception``: handlers that catch those must not swallow it.
    """


@contextmanager
def time_limit(seconds: float | None):
    """Raise RowTimeout in this worker after so many seconds.

    Uses an interval timer, which cannot interrupt native code that holds the
    interpreter.
    """
    if not seconds:
        yield
        return

    def expire(_signum, _frame):
        raise RowTimeout

    previous = signal.signal(signal.SIGALRM, expire)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, previous)


def outputs_of(value: Any) -> list:
    """No value or an empty sequence: none; a list or tuple: its items; else one."""
    if value is None:
        return []
    return list(value) if isinstance(value, (list, tuple)) else [value]


CALLS = 128  # rows whose inputs and outputs a Python worker holds as objects at a time

# handlers of class actors, alive as long as the Python worker
_BUILT: dict[tuple[str, str], Callable] = {}


def _handler(token: str, actor: Actor) -> Callable:
    if actor.build is None:
        return actor.call
    key = (token, actor.name)
    if key not in _BUILT:
        _BUILT[key] = actor.build()
    return _BUILT[key]


def call_actor(token: str, actor: Actor, body: str) -> dict:
    """Run one handler on one JSON body; every failure becomes data."""
    outs, error, details = None, None, None
    started, clock = datetime.now(timezone.utc), perf_counter()
    try:
        handler = _handler(token, actor)
        with time_limit(actor.timeout):
            value = handler(json.loads(body))
        if actor.timeout and perf_counter() - clock > actor.timeout:
            raise RowTimeout  # the alarm was lost in native code or caught
        outs = [json.dumps(o, ensure_ascii=False, allow_nan=False) for o in outputs_of(value)]
    except RowTimeout:
        error = f"Runtime timeout exceeded after {actor.timeout:g}s"
    except Exception as exc:
        error = "processing_error"
        details = {
            "message": str(exc),
            "type": type(exc).__name__,
            "traceback": "".join(traceback.format_exception(exc)),
        }
    return {
        "outs": outs,
        "error": error,
        "details": details,
        "started_at": started,
        "duration_s": perf_counter() - clock,
    }


def python_call(registry: Registry) -> Callable[[Column, Column], Column]:
    """Arrow function (actor, JSON body) -> outputs or error, one per hop."""
    handlers = {n: registry.actors[n] for n in registry.names(PAYLOAD, ENVELOPE)}
    token = registry.token

    def call(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        details = pa.struct([("message", pa.string()), ("type", pa.string()),
                             ("traceback", pa.string())])
        kind = pa.struct([("outs", pa.list_(pa.string())), ("error", pa.string()),
                          ("details", details), ("started_at", pa.timestamp("us", tz="UTC")),
                          ("duration_s", pa.float64())])
        for names, bodies in batches:
            # an Arrow batch may hold thousands of long texts, and results as long again
            for at in range(0, len(bodies), CALLS):
                part = names.slice(at, CALLS).to_pylist(), bodies.slice(at, CALLS).to_pylist()
                rows = [
                    call_actor(token, handlers[n], b) if b is not None and n in handlers else None
                    for n, b in zip(*part)
                ]
                yield pa.array(rows, type=kind)

    # evaluated once per row even when several columns read the result
    return F.arrow_udf(call, CALL_RESULT).asNondeterministic()
