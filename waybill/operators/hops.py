"""Run envelopes along their own routes until every row is terminal.

One hop is one projection: dispatch on the current actor, normalise the
outputs, explode them, mint ids, move the cursor and resolve the destination.
Hops are chained in a single plan without any shuffle, and each row carries the
trace of its hops, so that terminal rows and the hop log come out of the same
single evaluation.

The frame's own rules are SQL texts, one parsed expression each, which keeps
planning a long route cheap. Handlers are given as columns.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions.checks import frame_reason, route_of, text_map, typed_reason
from waybill.functions.payload import part
from waybill.functions.route import advance
from waybill.operators.actors import ENVELOPE, PAYLOAD, Actor, Registry, python_call
from waybill.schema import DETAILS, ERROR_END, HAPPY_END, ROUTE, STRING_MAP, TRACE_ENTRY
from waybill.session import cut_lineage
from waybill.sources.wire import wire_struct

FRAME = ("id", "parent_id", "route", "headers", "payload")
RUN_STATE = ("dest", "failure", "since", "trace")

_ENDS = f"('{HAPPY_END}', '{ERROR_END}')"
_ACTIVE = f"dest NOT IN {_ENDS}"
# when a row of this plan is taken on: no earlier than the run itself
_TAKEN = "greatest(since, current_timestamp())"
_TRACE = f"array<{TRACE_ENTRY.simpleString()}>"
_DETAILS = DETAILS.simpleString()


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _details(message: str, kind: str) -> str:
    return (
        f"named_struct('message', {message}, 'type', {_quote(kind)}, "
        "'traceback', cast(null as string))"
    )


def _failure(error: str, reason: str, details: str | None = None) -> str:
    details = f"cast(null as {_DETAILS})" if details is None else details
    return f"named_struct('error', {error}, 'reason', {reason}, 'details', {details})"


def _processing_error(message: str, kind: str) -> str:
    return _failure("'processing_error'", "'runtime_error'", _details(message, kind))


def _entry(**values: str) -> str:
    cells = (
        f"'{f.name}', cast({values.get(f.name, 'null')} as {f.dataType.simpleString()})"
        for f in TRACE_ENTRY.fields
    )
    return f"named_struct({', '.join(cells)})"


def _route(actors: str, current: str, metadata: str) -> str:
    return (
        f"cast(named_struct('actors', {actors}, 'current', {current}, 'metadata', {metadata}) "
        f"as {ROUTE.simpleString()})"
    )


def _moved(route: str) -> str:
    return _route(f"{route}.actors", f"{route}.current + 1", f"{route}.metadata")


def _destination(route: str) -> str:
    return f"coalesce(nullif(get({route}.actors, {route}.current), ''), '{HAPPY_END}')"


def start(df: DataFrame) -> DataFrame:
    """Add run state to envelopes; frames that break a rule fail before the first hop.

    Rows of ``parse_envelopes`` keep the failure found while parsing. ``since`` is when a row
    was put on the queue it is on: a column ``enqueued_at`` of the input, else the time of the
    run; every hop moves it on to the end of its call.
    """
    if "parent_id" not in df.columns:
        df = df.withColumn("parent_id", F.lit(None).cast("string"))
    if "headers" not in df.columns:
        df = df.withColumn("headers", F.lit(None).cast(STRING_MAP))
    reason = typed_reason(F.col("id"), F.col("route"))
    if "outcome" in df.columns and "reason" in df.columns:
        reason = F.coalesce(F.col("reason"), reason)
    extra = [c for c in df.columns if c not in (*FRAME, "outcome", "reason", "enqueued_at")]
    since = "current_timestamp()"
    if "enqueued_at" in df.columns:
        since = f"coalesce(cast(enqueued_at as timestamp), {since})"
    outcome = (
        "CASE WHEN __code = 'invalid_json' THEN 'parse_error' "
        "WHEN __code = 'missing_id' THEN 'validation_error' "
        "WHEN __code IS NOT NULL THEN 'runtime_error' END"
    )
    failure = _failure(
        "CASE WHEN __outcome = 'runtime_error' THEN 'msg_parsing_error' ELSE __outcome END",
        "__code",
        f"CASE WHEN __outcome = 'runtime_error' THEN {_details('__code', 'ValueError')} END",
    )
    entry = _entry(
        hop="0",
        id="id",
        parent_id="parent_id",
        actor="get(route.actors, route.current)",
        outcome="__outcome",
        reason="__code",
        message_type="'error_end'",
        dest=f"'{ERROR_END}'",
        pos="0",
        n_outputs="0",
        enqueued_at=since,
    )
    lost = _route(f"array('{ERROR_END}')", "0", "null")
    own = _route("route.actors", "route.current", "route.metadata")
    coded = df.withColumn("__code", reason).withColumn("__outcome", F.expr(outcome))
    return coded.selectExpr(
        *extra,
        "id",
        "parent_id",
        f"CASE WHEN route.actors IS NULL THEN {lost} ELSE {own} END AS route",
        "headers",
        "payload",
        f"CASE WHEN __code IS NOT NULL THEN '{ERROR_END}' ELSE {_destination('route')} END AS dest",
        f"CASE WHEN __code IS NOT NULL THEN {failure} END AS failure",
        f"{since} AS since",
        f"CASE WHEN __code IS NOT NULL THEN array({entry}) ELSE cast(array() AS {_TRACE}) END "
        "AS trace",
    )


def _dispatch(
    df: DataFrame, registry: Registry, only: str | None, max_visits: int | None
) -> DataFrame:
    """Current actor of every active row, and the rows that must not be handled."""
    refusals = []
    if only is not None:
        told = (
            "format_string('Route mismatch: expected \\'%s\\', got \\'%s\\'', "
            f"{_quote(only)}, __at)"
        )
        refusals.append((f"__at <> {_quote(only)}", _failure(told, "'route_mismatch'")))
    if max_visits is not None:
        seen = "filter(slice(route.actors, 1, greatest(route.current + 1, 0)), a -> a = __at)"
        told = f"concat(__at, ' visited more than {max_visits} times')"
        refusals.append((f"size({seen}) > {max_visits}", _processing_error(told, "ValueError")))
    names = ", ".join(_quote(n) for n in registry.actors)
    unknown = f"__at NOT IN ({names})" if names else "__at IS NOT NULL"
    told = "concat('no handler for actor ', __at)"
    refusals.append((unknown, _processing_error(told, "LookupError")))
    cases = " ".join(f"WHEN {test} THEN {value}" for test, value in refusals)
    return df.selectExpr(
        "*",
        f"CASE WHEN {_ACTIVE} THEN coalesce(get(route.actors, route.current), '') END AS __at",
        f"CASE {cases} END AS __refused",
        "CASE WHEN __refused IS NULL THEN __at END AS __actor",
    )


def _pick(actors: list[Actor], value) -> Column:
    """One value per actor, chosen by the current actor."""
    chain = None
    for a in actors:
        test = F.col("__actor") == a.name
        chain = F.when(test, value(a)) if chain is None else chain.when(test, value(a))
    return chain


RAISED = "the expression raised an error"


def _tried(expr, *given: Column) -> Column:
    """Not null unless ``expr`` raises on this row.

    ``try_to_binary`` gives null for whatever its argument raises. Inside a lambda no part of
    the expression is shared with others, so nothing of it runs before the trial.
    """
    args = F.struct(*[g.alias(f"a{i}") for i, g in enumerate(given)])
    trial = F.transform(
        F.array(args), lambda row: expr(*[row[f"a{i}"] for i in range(len(given))])
    )
    return F.try_to_binary(F.size(trial).cast("string"), F.lit("utf-8"))


def _from_text(text: Column, kind: str) -> Column:
    return text if kind == "string" else F.from_json(text, kind)


class Handlers:
    """Handler expressions of a registry, built once and shared by all hops."""

    def __init__(self, registry: Registry, kind: str) -> None:
        payload, route = F.col("payload"), F.col("route")
        natives = registry.columns()
        singles, lists = [a for a in natives if not a.many], [a for a in natives if a.many]
        failing, rerouting = [a for a in natives if a.fails], [a for a in natives if a.reroute]
        self.registry, self.kind = registry, kind
        guarded = any(a.guard for a in natives)

        def result(a: Actor, given: Column) -> Column:
            return a.call(given).cast(f"array<{kind}>" if a.many else kind)

        def message(a: Actor) -> Column:
            if not a.guard:
                return a.fails(payload)
            return F.when(_tried(a.fails, payload).isNotNull(), a.fails(payload)).otherwise(RAISED)

        def trial(a: Actor, expr, *given: Column) -> Column:
            return _tried(expr, *given) if a.guard else F.to_binary(F.lit("1"), F.lit("utf-8"))

        def kept(value: Column | None, tried: str, checked: bool) -> Column | None:
            if value is None or not checked:
                return value
            return F.when(F.col(tried).isNotNull(), value)

        # what a row's own expression gave on trial; read by the columns after it
        self.tried = self.turn_tried = None
        if guarded:
            self.tried = _pick(
                natives, lambda a: trial(a, lambda p: result(a, p), payload)
            ).alias("__tried")
        one, many = (_pick(group, lambda a: a.call(payload)) for group in (singles, lists))
        one = None if one is None else one.cast(kind)
        many = None if many is None else many.cast(f"array<{kind}>")
        self.one, self.many = kept(one, "__tried", guarded), kept(many, "__tried", guarded)
        self.message = _pick(failing, message)
        value, checked = F.col("__value"), any(a.guard for a in rerouting)
        if checked:
            self.turn_tried = _pick(
                rerouting, lambda a: trial(a, a.reroute, value, route)
            ).alias("__turn_tried")
        self.turned = kept(
            _pick(rerouting, lambda a: a.reroute(value, route)), "__turn_tried", checked)
        self.native_names = ", ".join(_quote(a.name) for a in natives)
        self.rerouting_names = ", ".join(_quote(a.name) for a in rerouting)
        if self.one is not None:
            self.one = self.one.alias("__one")
        if self.many is not None:
            self.many = self.many.alias("__many")
        self.whole = bool(registry.names(ENVELOPE))
        self.python = python_call(registry) if registry.has_python() else None
        if self.python is not None:
            self._python(F.col("__call.outs"))
        if not registry.actors:
            self.one = F.lit(None).cast(kind).alias("__one")

    def body(self, state: DataFrame) -> Column:
        """What a Python actor is given: its payload, or its whole envelope."""
        plain, whole = self.registry.names(PAYLOAD), self.registry.names(ENVELOPE)
        payload, actor = F.col("payload"), F.col("__actor")
        text = payload if self.kind == "string" else F.to_json(payload)
        if not whole:
            return F.when(actor.isin(*plain), text)
        body = F.when(actor.isin(*whole), F.to_json(wire_struct(state)))
        return body.when(actor.isin(*plain), text) if plain else body

    def _python(self, outs: Column) -> None:
        """Output columns of Python actors; ``__bad`` names a broken envelope output."""
        kind = self.kind
        if not self.whole:
            if kind != "string":
                outs = F.transform(outs, lambda t: _from_text(t, kind))
            self.outs = [F.lit(None).cast("string").alias("__bad"), outs.alias("__outs")]
            return

        # envelope actors own route and headers, so every output carries them
        route, headers, docs = F.col("route"), F.col("headers"), F.col("__docs")
        is_whole = F.col("__actor").isin(*self.registry.names(ENVELOPE))

        def frame(value: Column, to: Column, kept: Column) -> Column:
            return F.struct(
                value.alias("p"), to.cast(ROUTE).alias("r"), kept.cast(STRING_MAP).alias("h")
            )

        def envelope_out(doc: Column) -> Column:
            value = _from_text(F.to_json(part(doc, "$.payload")), kind)
            return frame(value, route_of(doc), F.coalesce(text_map(doc, "$.headers"), headers))

        plain_out = F.transform(outs, lambda t: frame(_from_text(t, kind), advance(route), headers))
        bad = (
            "CASE WHEN exists(__reasons, r -> r IS NOT NULL) THEN format_string("
            "'Invalid output envelope[%d/%d]: %s', "
            "cast(array_position(transform(__reasons, r -> r IS NOT NULL), true) as int) - 1, "
            "size(__reasons), filter(__reasons, r -> r IS NOT NULL)[0]) END AS __bad"
        )
        self.outs = [
            F.when(is_whole, F.transform(outs, F.try_parse_json)).alias("__docs"),
            F.transform(docs, lambda d: frame_reason(d, before=route)).alias("__reasons"),
            F.expr(bad),
            F.when(~is_whole, plain_out)
            .when(F.col("__bad").isNull(), F.transform(docs, envelope_out))
            .alias("__outs"),
        ]


def hop(
    df: DataFrame,
    registry: Registry,
    number: int | str,
    *,
    only: str | None = None,
    on_collision: str = "keep",
    max_visits: int | None = None,
    handlers: Handlers | None = None,
    sizes: bool = False,
) -> DataFrame:
    """One hop for every row that is not terminal yet.

    ``only`` names the actor that is consuming: active rows whose route points
    elsewhere become ``route_mismatch`` errors. ``number`` may be an SQL text, where rows
    have different numbers of hops behind them. ``sizes`` logs the JSON size of typed
    payloads too; that of JSON payloads is always logged.
    """
    kind = dict(df.dtypes)["payload"]
    extra = [c for c in df.columns if c not in (*FRAME, *RUN_STATE)]
    handlers = Handlers(registry, kind) if handlers is None else handlers
    python, whole = handlers.python is not None, handlers.whole

    state = _dispatch(df, registry, only, max_visits)
    failures, timing = ["__refused"], {"started_at": f"CASE WHEN __refused IS NULL THEN {_TAKEN} END"}
    ended = _TAKEN
    if python:
        state = state.withColumn("__call", handlers.python(F.col("__actor"), handlers.body(state)))
        called = _failure("__call.error", "'runtime_error'", "__call.details")
        failures += [
            f"CASE WHEN __call.error IS NOT NULL THEN {called} END",
            f"CASE WHEN __bad IS NOT NULL THEN {_processing_error('__bad', 'ValueError')} END",
        ]
        # a column actor has no call of its own: its rows are taken on with the plan
        timing = {
            "started_at": f"coalesce(__call.started_at, CASE WHEN __refused IS NULL THEN {_TAKEN} END)",
            "duration_s": "__call.duration_s",
        }
        ended = ("coalesce(timestamp_micros(unix_micros(__call.started_at) "
                 f"+ bigint(round(__call.duration_s * 1e6))), {_TAKEN})")

    computed = [c for c in (handlers.tried, handlers.one, handlers.many) if c is not None]
    if python:
        computed += handlers.outs
    if handlers.message is not None:
        computed.append(handlers.message.alias("__message"))
        failures.append(
            f"CASE WHEN __message IS NOT NULL THEN {_processing_error('__message', 'ValueError')} "
            "END"
        )
    raised = _processing_error(_quote(RAISED), "ExpressionError")
    if handlers.tried is not None:
        failures.append(
            f"CASE WHEN __tried IS NULL AND __actor IN ({handlers.native_names}) THEN {raised} END"
        )
    computed.append(F.expr(f"coalesce({', '.join(failures)}) AS __fail"))

    if python or handlers.many is not None:
        pos, out = "coalesce(__pos, 0)", "__out"
        computed.append(F.expr(_outputs(handlers)))
        state, after = _explode(state.select("*", *computed)), []
    else:
        pos, out = "0", "__one"
        after = [*computed, F.expr("int(__fail IS NULL AND __one IS NOT NULL) AS __n")]

    to, headers = _moved("route"), "headers"
    fail, sent = "__fail", "__n > 0"
    if whole:
        to, headers, out = "__out.r", "__out.h", "__out.p"
    if handlers.turned is not None:
        after.append(F.expr(f"{out} AS __value"))
        if handlers.turn_tried is not None:
            # an output whose own rewrite raises is an error row at this actor
            fail, sent = "__astray", "__n > 0 AND __astray IS NULL"
            lost = (f"__n > 0 AND __turn_tried IS NULL AND __actor IN ({handlers.rerouting_names})")
            after += [
                handlers.turn_tried,
                F.expr(f"coalesce(__fail, CASE WHEN {lost} THEN {raised} END) AS __astray"),
            ]
        after.append(handlers.turned.alias("__turned"))
        to = f"CASE WHEN __turned IS NOT NULL THEN {_moved('__turned')} ELSE {to} END"
    after += [
        F.expr(f"CASE WHEN {sent} THEN {to} ELSE route END AS __next"),
        F.expr(
            f"CASE WHEN __at IS NULL THEN dest WHEN {fail} IS NOT NULL THEN '{ERROR_END}' "
            f"WHEN __n = 0 THEN '{HAPPY_END}' ELSE {_destination('__next')} END AS __dest"
        ),
    ]
    # later columns of the list read earlier ones by name
    state = state.select("*", *after)
    measured = {True: "octet_length({})", False: "octet_length(to_json({}))"}[kind == "string"]
    measure = measured.format if kind == "string" or (sizes and kind.startswith("struct")) else (
        lambda _: "null")
    entry = _entry(
        hop=str(number),
        id="id",
        parent_id="parent_id",
        actor="__at",
        outcome=f"CASE WHEN {fail}.reason = 'route_mismatch' THEN 'route_mismatch' "
        f"WHEN {fail} IS NOT NULL THEN 'runtime_error' WHEN __n = 0 THEN 'empty_response' "
        "ELSE 'success' END",
        reason=f"{fail}.reason",
        error_type=f"CASE WHEN startswith({fail}.error, 'Runtime timeout') THEN 'execution_error' "
        f"ELSE {fail}.details.type END",
        message_type=f"CASE WHEN __dest = '{ERROR_END}' THEN 'error_end' "
        f"WHEN __dest = '{HAPPY_END}' THEN 'happy_end' ELSE 'routing' END",
        dest="__dest",
        pos=pos,
        n_outputs="__n",
        size_in=measure("payload"),
        size_out=f"CASE WHEN {sent} THEN {measure(out)} END",
        enqueued_at="since",
        **timing,
    )
    ids, past = ["id", "parent_id"], "trace"
    if pos != "0":
        infix = f"concat('-h', {number}, '-')" if on_collision == "hop" else "'-'"
        ids = [
            f"CASE WHEN __pos > 0 THEN concat(id, {infix}, __pos) ELSE id END AS id",
            "CASE WHEN __pos > 0 THEN id ELSE parent_id END AS parent_id",
        ]
        # a child starts its own trace; the parent's earlier hops stay with output 0
        past = f"CASE WHEN __pos > 0 THEN cast(array() AS {_TRACE}) ELSE trace END"
    return state.selectExpr(
        *extra,
        *ids,
        "__next AS route",
        "headers" if headers == "headers" else
        f"CASE WHEN {sent} THEN {headers} ELSE headers END AS headers",
        f"CASE WHEN {sent} THEN {out} ELSE payload END AS payload",
        "__dest AS dest",
        f"coalesce(failure, {fail}) AS failure",
        f"CASE WHEN __at IS NOT NULL THEN {ended} ELSE since END AS since",
        f"CASE WHEN __at IS NOT NULL THEN concat({past}, array({entry})) ELSE trace END AS trace",
    )


def _outputs(handlers: Handlers) -> str:
    """All outputs of a row as one list; null when it failed or has none."""
    whole = handlers.whole
    wrap = "named_struct('p', {}, 'r', " + _moved("route") + ", 'h', headers)" if whole else "{}"
    options = []
    if handlers.one is not None:
        options.append(f"CASE WHEN __one IS NOT NULL THEN array({wrap.format('__one')}) END")
    if handlers.many is not None:
        options.append(f"transform(__many, x -> {wrap.format('x')})" if whole else "__many")
    if handlers.python is not None:
        options.append("__outs")
    return f"CASE WHEN __fail IS NULL THEN coalesce({', '.join(options)}) END AS __list"


def _explode(state: DataFrame) -> DataFrame:
    """One row per output (``__pos``, ``__out``); rows without outputs stay."""
    used = ("__tried", "__one", "__many", "__outs", "__bad", "__docs", "__reasons", "__list")
    return state.selectExpr(
        *[c for c in state.columns if c not in used],
        "greatest(coalesce(size(__list), 0), 0) AS __n",
        "posexplode_outer(__list) AS (__pos, __out)",
    )


def _overrun(df: DataFrame, max_hops: int) -> DataFrame:
    """Rows still active after the hop limit become error rows."""
    told = _details(_quote(f"still active after {max_hops} hops"), "OverflowError")
    failure = _failure("'max_hops exceeded'", "'runtime_error'", told)
    return df.selectExpr(
        *[c for c in df.columns if c not in ("failure", "dest")],
        f"CASE WHEN {_ACTIVE} THEN {failure} ELSE failure END AS failure",
        f"CASE WHEN {_ACTIVE} THEN '{ERROR_END}' ELSE dest END AS dest",
    )


def step(
    df: DataFrame, registry: Registry, actor: str, number: int | str = 1, **options
) -> DataFrame:
    """One hop of one actor over the rows of its queue; rows go on, not to an end."""
    return hop(start(df), registry, number, only=actor, **options)


UNROLL = 6  # hops in one plan


def run(
    df: DataFrame,
    registry: Registry,
    max_hops: int | None = None,
    *,
    unroll: int | None = None,
    on_collision: str = "keep",
    max_visits: int | None = None,
    sizes: bool = False,
) -> DataFrame:
    """Run every envelope to a terminal; one row per terminal envelope.

    The result holds the envelope frame plus ``terminal``, ``error``,
    ``details``, ``reason``, ``last_actor`` and ``trace``. Write or checkpoint
    it once when both terminals and hop log are wanted.

    Without ``max_hops`` hops go on until no row is active. The plan covers
    ``unroll`` hops at a time (``UNROLL`` by default) and is cut by a reliable
    checkpoint in between; finished rows are then not carried along. A route
    that rewrites itself for ever needs ``max_visits``.

    With ``max_hops`` and no ``unroll`` the run is one lazy plan of that many
    hops; rows that are still active after them end as errors.
    """
    if max_hops is None and unroll is None:
        unroll = UNROLL
    state = start(df)
    handlers = Handlers(registry, dict(state.dtypes)["payload"])
    options = {"on_collision": on_collision, "max_visits": max_visits, "handlers": handlers,
               "sizes": sizes}
    done: list[DataFrame] = []
    for number in count(1) if max_hops is None else range(1, max_hops + 1):
        state = hop(state, registry, number, **options)
        if unroll and number % unroll == 0 and number != max_hops:
            state = cut_lineage(state)
            done.append(state.filter(f"NOT ({_ACTIVE})"))
            state = state.filter(_ACTIVE)
            if state.isEmpty():
                break
    if max_hops is not None:
        state = _overrun(state, max_hops)
    for finished in done:
        state = finished.unionByName(state)
    return finish(state)


def finish(state: DataFrame) -> DataFrame:
    """Terminal rows: no routing and no cursor change, whatever the route says."""
    extra = [c for c in state.columns if c not in (*FRAME, *RUN_STATE)]
    at = "get(route.actors, route.current)"
    return state.selectExpr(
        *extra,
        *FRAME,
        "dest AS terminal",
        "failure.error AS error",
        "failure.details AS details",
        "failure.reason AS reason",
        f"coalesce(CASE WHEN dest = '{ERROR_END}' OR route.current > 0 "
        f"THEN nullif({at}, '') END, try_element_at(route.actors, -1), 'unknown') AS last_actor",
        "trace",
    )


def terminals(done: DataFrame) -> DataFrame:
    """Terminal rows without their traces."""
    return done.drop("trace")


def hop_log(done: DataFrame) -> DataFrame:
    """One row per output sent (``pos`` counts the outputs of one hop).

    Rows with ``pos = 0`` count received envelopes; all rows count sent ones.
    """
    return done.select(F.explode("trace").alias("t")).select("t.*")
