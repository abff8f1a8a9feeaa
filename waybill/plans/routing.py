"""Envelopes, cursors, validation and routed runs over ``documents``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.functions import route as R
from waybill.functions.checks import frame_reason
from waybill.functions.payload import byte_size, enrich, enrich_json
from waybill.functions.text import (
    duration_message,
    error_text,
    from_rfc3339,
    object_key,
    processing_message,
    size_kb_message,
    to_rfc3339,
)
from waybill.operators.actors import Registry
from waybill.operators.hops import hop_log, run, step, terminals
from waybill.operators.lineage import fanout_width, id_collisions
from waybill.operators.metrics import counters, error_summary, from_run
from waybill.operators.status import fold_status
from waybill.operators.terminal import (
    as_updates,
    final_message,
    final_report,
    terminal_result,
    terminal_union,
    to_error,
)
from waybill.plans.bindings import WORDS, docs, json_docs, names, table, typed_docs, utc
from waybill.plans.registry import query
from waybill.session import stored
from waybill.sources.wire import parse_envelopes, to_wire, wire_struct

# ---------------------------------------------------------------- actors


def prep(p: Column) -> Column:
    """Trimmed lower-case text with its word count."""
    text = F.lower(F.trim(p["text"]))
    return enrich(p, text=text, words=F.regexp_count(text, F.lit(WORDS)))


def chunk(p: Column) -> Column:
    """One output per line."""
    return F.transform(F.split(p["text"], "\n"), lambda line: p.withField("text", line))


def tag(p: Column) -> Column:
    size = F.when(F.length(p["text"]) < 100, "short").otherwise("long")
    return enrich(p, tag=F.concat(p["lang"], F.lit(":"), size))


def native_registry(**prep_options) -> Registry:
    reg = Registry()
    reg.column_actor("prep", prep, **prep_options)
    reg.column_actor("chunk", chunk, many=True)
    reg.column_actor("tag", tag)
    return reg


def python_registry() -> Registry:
    """The same steps as Python handlers; ``tag`` is a class built once per worker."""
    reg = Registry()

    @reg.actor("prep")
    def py_prep(p):
        text = p["text"].strip(" ").lower()
        return {**p, "text": text, "words": len(text.split())}

    @reg.actor("chunk")
    def py_chunk(p):
        return [{**p, "text": line} for line in p["text"].split("\n")]

    @reg.actor_class("tag")
    class Tagger:
        def __init__(self, limit=100):
            self.limit = limit

        def process(self, p):
            size = "short" if len(p["text"]) < self.limit else "long"
            return {**p, "tag": f"{p['lang']}:{size}"}

    return reg


def flat_typed(done: DataFrame) -> DataFrame:
    return done.select(
        "id",
        "parent_id",
        "terminal",
        "last_actor",
        F.array_join("route.actors", ",").alias("actors"),
        F.col("route.current").alias("cursor"),
        F.col("payload.words").alias("words"),
        F.col("payload.tag").alias("tag"),
        F.md5("payload.text").alias("text_md5"),
    )


ROUTES_SQL = r"""
d AS (
  SELECT doc_id, 'doc-' || doc_id AS id, doc_id % 3 AS m, lang,
         lower(trim(text)) AS text, text AS raw_text, n_chars,
         len(regexp_extract_all(lower(trim(text)), '[^ \t\n\r]+'))::INTEGER AS words
  FROM documents
), lines AS (
  SELECT id, lang, words, parts[i] AS line, i - 1 AS pos
  FROM (SELECT *, string_split(text, chr(10)) AS parts FROM d WHERE m = 0)
       CROSS JOIN LATERAL (SELECT unnest(generate_series(1, len(parts))) AS i)
), finished AS (
  SELECT CASE WHEN pos > 0 THEN id || '-' || pos ELSE id END AS id,
         CASE WHEN pos > 0 THEN id END AS parent_id, 'happy-end' AS terminal, 'tag' AS last_actor,
         'prep,chunk,tag' AS actors, 3 AS cursor, words,
         lang || CASE WHEN length(line) < 100 THEN ':short' ELSE ':long' END AS tag,
         md5(line) AS text_md5
  FROM lines
  UNION ALL
  SELECT id, NULL, 'happy-end', 'tag', 'prep,tag', 2, words,
         lang || CASE WHEN length(text) < 100 THEN ':short' ELSE ':long' END, md5(text)
  FROM d WHERE m = 1
  UNION ALL
  SELECT id, NULL, 'happy-end', 'prep', 'prep', 1, words, NULL, md5(text) FROM d WHERE m = 2
)
"""


@query("routes_native", f"WITH {ROUTES_SQL} SELECT * FROM finished")
def routes_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column actors along each document's own route, in one plan without a shuffle."""
    return flat_typed(run(typed_docs(docs(spark, sf_dir)), native_registry(), max_hops=3))


@query("routes_python", f"WITH {ROUTES_SQL} SELECT * FROM finished")
def routes_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same routes with Python function and class actors on JSON payloads."""
    done = run(json_docs(docs(spark, sf_dir)), python_registry(), max_hops=3)
    field = lambda name: F.get_json_object("payload", f"$.{name}")
    return done.select(
        "id", "parent_id", "terminal", "last_actor",
        F.array_join("route.actors", ",").alias("actors"),
        F.col("route.current").alias("cursor"),
        field("words").cast("int").alias("words"),
        field("tag").alias("tag"),
        F.md5(field("text")).alias("text_md5"),
    )


@query("hop_log", f"""WITH {ROUTES_SQL}
SELECT id, 1 AS hop, 'prep' AS actor, 'success' AS outcome, 0 AS pos, 1 AS n_outputs,
       CASE m WHEN 0 THEN 'chunk' WHEN 1 THEN 'tag' ELSE 'happy-end' END AS dest FROM d
UNION ALL
SELECT id, 2, 'chunk', 'success', pos, count(*) OVER (PARTITION BY id), 'tag' FROM lines
UNION ALL
SELECT CASE WHEN pos > 0 THEN id || '-' || pos ELSE id END, 3, 'tag', 'success', 0, 1, 'happy-end'
FROM lines
UNION ALL
SELECT id, 2, 'tag', 'success', 0, 1, 'happy-end' FROM d WHERE m = 1""")
def hop_log_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per output of every hop."""
    done = run(typed_docs(docs(spark, sf_dir)), native_registry(), max_hops=3)
    return hop_log(done).select("id", "hop", "actor", "outcome", "pos", "n_outputs", "dest")


# ---------------------------------------------------------------- frames and cursors


@query("parse_envelopes", """
SELECT doc_id,
       CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 11 = 3 THEN '' ELSE 'doc-' || doc_id END AS id,
       CASE WHEN doc_id % 7 = 0 THEN 'parse_error' WHEN doc_id % 11 = 3 THEN 'validation_error' END
         AS outcome,
       CASE WHEN doc_id % 7 = 0 THEN 'invalid_json' WHEN doc_id % 11 = 3 THEN 'missing_id' END
         AS reason,
       CASE WHEN doc_id % 7 > 0 THEN
         CASE doc_id % 3 WHEN 0 THEN 'prep,chunk,tag' WHEN 1 THEN 'prep,tag' ELSE 'prep' END END
         AS actors,
       CASE WHEN doc_id % 7 > 0 THEN lang END AS lang,
       CASE WHEN doc_id % 7 > 0 THEN source END AS header_source,
       CASE WHEN doc_id % 7 > 0 THEN md5(text) END AS text_md5
FROM documents""")
def parse_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wire bodies back to envelopes; broken bodies and missing ids become rows."""
    source = docs(spark, sf_dir)
    env = json_docs(source).withColumn("__key", F.regexp_extract("id", r"(\d+)", 1).cast("bigint"))
    doc_id = F.col("__key")
    env = env.withColumn("id", F.when(doc_id % 11 == 3, F.lit(None)).otherwise(F.col("id")))
    body = F.to_json(wire_struct(env))
    raw = env.select(
        doc_id.alias("doc_id"),
        F.when(doc_id % 7 == 0, F.substring(body, F.lit(1), F.length(body) - 5))
        .otherwise(body)
        .alias("body"),
    )
    return parse_envelopes(raw).select(
        "doc_id", "id", "outcome", "reason",
        F.array_join("route.actors", ",").alias("actors"),
        F.get_json_object("payload", "$.lang").alias("lang"),
        F.try_element_at("headers", F.lit("source")).alias("header_source"),
        F.md5(F.get_json_object("payload", "$.text")).alias("text_md5"),
    )


@query("wire_roundtrip", """
SELECT 'doc-' || doc_id AS id, NULL::VARCHAR AS parent_id,
       CASE doc_id % 3 WHEN 0 THEN 'prep,chunk,tag' WHEN 1 THEN 'prep,tag' ELSE 'prep' END AS actors,
       0 AS cursor, lang AS header_lang, md5(text) AS text_md5, n_chars,
       false AS has_parent, true AS has_headers
FROM documents""")
def wire_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serialised and parsed again."""
    body = to_wire(json_docs(docs(spark, sf_dir)))
    flags = body.withColumn("keys", F.json_object_keys("body"))
    return parse_envelopes(flags).select(
        "id", "parent_id",
        F.array_join("route.actors", ",").alias("actors"),
        F.col("route.current").alias("cursor"),
        F.try_element_at("headers", F.lit("lang")).alias("header_lang"),
        F.md5(F.get_json_object("payload", "$.text")).alias("text_md5"),
        F.get_json_object("payload", "$.n_chars").cast("bigint").alias("n_chars"),
        F.array_contains("keys", "parent_id").alias("has_parent"),
        F.array_contains("keys", "headers").alias("has_headers"),
    )


@query("route_cursor", """
WITH r AS (
  SELECT doc_id, c AS cursor,
         CASE doc_id % 3 WHEN 0 THEN ['prep', 'chunk', 'tag'] WHEN 1 THEN ['prep', 'tag']
              ELSE ['prep'] END AS actors
  FROM documents, (SELECT unnest([0, 1, 2, 3]) AS c)
)
SELECT doc_id, cursor, coalesce(actors[cursor + 1], '') AS current_actor,
       coalesce(actors[cursor + 2], '') AS next_actor, cursor + 1 < len(actors) AS has_next,
       cursor + 1 AS advanced, coalesce(actors[cursor + 1], 'happy-end') AS destination,
       'queue-' || coalesce(actors[cursor + 1], 'happy-end') AS queue,
       CASE WHEN cursor > 0 AND cursor < len(actors) THEN actors[cursor + 1]
            ELSE actors[len(actors)] END AS last_actor
FROM r""")
def route_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursor functions at four positions of every route."""
    env = typed_docs(docs(spark, sf_dir)).select("id", "route")
    rows = env.withColumn("cursor", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    r = F.col("route").withField("current", F.col("cursor"))
    return rows.select(
        F.regexp_extract("id", r"(\d+)", 1).cast("bigint").alias("doc_id"),
        "cursor",
        R.current_actor(r).alias("current_actor"),
        R.next_actor(r).alias("next_actor"),
        R.has_next(r).alias("has_next"),
        R.advance(r)["current"].alias("advanced"),
        R.destination(r).alias("destination"),
        R.queue_name(R.destination(r)).alias("queue"),
        R.last_actor(r).alias("last_actor"),
    )


BROKEN_FRAMES = (
    ('{"id":"x","route":{"actors":["a"],"current":0}}', "missing_payload"),
    ('{"id":"x","payload":1}', "missing_route"),
    ('{"id":"x","payload":1,"route":[1]}', "route_not_object"),
    ('{"id":"x","payload":1,"route":{"current":0}}', "missing_actors"),
    ('{"id":"x","payload":1,"route":{"actors":"a"}}', "actors_not_list"),
    ('{"id":"x","payload":1,"route":{"actors":["a"],"current":true}}', "current_not_integer"),
    ('{"id":"x","payload":1,"route":{"actors":["a"],"current":"0"}}', "current_not_integer"),
    ('{"id":"x","payload":1,"route":{"actors":[],"current":0}}', "empty_actors"),
    ('{"id":"x","payload":1,"route":{"actors":["a"],"current":-1}}', "current_out_of_bounds"),
    ('{"id":"x","payload":1,"route":{"actors":["a"],"current":2}}', "current_out_of_bounds"),
    ('{"id":"x","payload":1,"route":{"actors":["a"]},"headers":[]}', "headers_not_object"),
    ('{"id":7,"payload":1,"route":{"actors":["a"]}}', "id_not_string"),
    ('{"id":"x","payload":null,"route":{"actors":["a"],"current":1}}', None),
    ('{"id":"x","payload":{},"route":{"actors":["a"]},"headers":{}}', None),
)


def _reason_sql() -> str:
    n = len(BROKEN_FRAMES)
    cases = " ".join(f"WHEN {i} THEN '{r}'" for i, (_, r) in enumerate(BROKEN_FRAMES) if r)
    return f"SELECT doc_id, CASE doc_id % {n} {cases} END AS reason FROM documents"


@query("validate_reasons", _reason_sql())
def validate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First broken frame rule of damaged bodies."""
    frames = F.array(*[F.lit(b) for b, _ in BROKEN_FRAMES])
    body = F.get(frames, (F.col("doc_id") % len(BROKEN_FRAMES)).cast("int"))
    rows = docs(spark, sf_dir).select("doc_id", F.try_parse_json(body).alias("doc"))
    return rows.select("doc_id", frame_reason(F.col("doc")).alias("reason"))


@query("rewrite_guard", """
WITH r AS (
  SELECT doc_id, (doc_id % 3)::INTEGER AS c, ['a', 'b', 'c'] AS before FROM documents
), w AS (
  SELECT doc_id, c, before, 'append' AS kind, before || ['d', 'e'] AS after FROM r
  UNION ALL SELECT doc_id, c, before, 'insert', before[1:c + 1] || ['x'] || before[c + 2:] FROM r
  UNION ALL SELECT doc_id, c, before, 'tail', before[1:c + 1] || ['y'] FROM r
  UNION ALL SELECT doc_id, c, before, 'erase', ['z'] || before[2:] FROM r
  UNION ALL SELECT doc_id, c, before, 'drop', before[2:] FROM r
)
SELECT doc_id, kind, array_to_string(after, ',') AS actors,
       after[1:c + 1] = before[1:c + 1] AS prefix_kept,
       c >= len(after) OR after[c + 1] IS NOT DISTINCT FROM before[c + 1] AS position_kept
FROM w""")
def rewrite_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route rewrites and the two guards on them."""
    cursor = (F.col("doc_id") % 3).cast("int")
    rows = docs(spark, sf_dir).select(
        "doc_id", R.make_route(names("a", "b", "c"), cursor).alias("before")
    )
    before = F.col("before")
    actors = before["actors"]
    rest = F.slice(actors, F.lit(2), F.lit(2))
    kinds = {
        "append": R.append_route(before, "d", "e"),
        "insert": R.insert_next(before, "x"),
        "tail": R.replace_tail(before, "y"),
        "erase": before.withField("actors", F.concat(names("z"), rest)),
        "drop": before.withField("actors", rest),
    }
    options = F.array(
        *[F.struct(F.lit(k).alias("kind"), v.alias("after")) for k, v in kinds.items()]
    )
    out = rows.select("doc_id", "before", F.explode(options).alias("o"))
    after = F.col("o.after")
    return out.select(
        "doc_id",
        F.col("o.kind").alias("kind"),
        F.array_join(after["actors"], ",").alias("actors"),
        R.prefix_kept(before, after).alias("prefix_kept"),
        R.position_kept(before, after).alias("position_kept"),
    )


@query("enrich_text", r"""
SELECT doc_id, md5(lower(trim(text))) AS text_md5,
       len(regexp_extract_all(lower(trim(text)), '[^ \t\n\r]+'))::INTEGER AS words,
       lang AS kept_lang, n_chars + 1 AS n_chars, 'set' AS added
FROM documents""")
def enrich_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed and JSON payloads with added and replaced fields."""
    source = docs(spark, sf_dir)
    payload = F.struct("text", "lang", "n_chars")
    typed = source.select("doc_id", "n_chars", prep(payload).alias("p"))
    merged = enrich_json(F.to_json(F.struct("p.lang", "p.n_chars")), n_chars=F.col("n_chars") + 1,
                         added=F.lit("set"))
    return typed.withColumn("j", merged).select(
        "doc_id",
        F.md5("p.text").alias("text_md5"),
        F.col("p.words").alias("words"),
        F.get_json_object("j", "$.lang").alias("kept_lang"),
        F.get_json_object("j", "$.n_chars").cast("bigint").alias("n_chars"),
        F.get_json_object("j", "$.added").alias("added"),
    )


@query("fanout_ids", """
WITH l AS (
  SELECT doc_id, 'doc-' || doc_id AS id, parts[i] AS line, i - 1 AS pos, len(parts) AS n
  FROM (SELECT *, string_split(text, chr(10)) AS parts FROM documents)
       CROSS JOIN LATERAL (SELECT unnest(generate_series(1, len(parts))) AS i)
)
SELECT CASE WHEN pos > 0 THEN id || '-' || pos ELSE id END AS id,
       CASE WHEN pos > 0 THEN id END AS parent_id, n::INTEGER AS n_outputs, md5(line) AS text_md5
FROM l""")
def fanout_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and parents minted by a fan-out."""
    lines = docs(spark, sf_dir).select(
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("id"), F.split("text", "\n").alias("parts")
    )
    out = lines.select("id", F.size("parts").alias("n"), F.posexplode("parts"))
    pos, n = F.col("pos"), F.col("n")
    return out.select(
        R.fanout_id(F.col("id"), pos, n).alias("id"),
        R.fanout_parent(F.col("id"), F.lit(None).cast("string"), pos, n).alias("parent_id"),
        n.alias("n_outputs"),
        F.md5("col").alias("text_md5"),
    )


@query("fanout_width", f"""WITH {ROUTES_SQL}
SELECT coalesce(parent_id, id) AS origin, count(*) AS width FROM finished GROUP BY ALL""")
def fanout_width_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terminal rows per original envelope."""
    return fanout_width(run(typed_docs(docs(spark, sf_dir)), native_registry(), max_hops=3))


@query("id_collisions", """
WITH p AS (
  SELECT 'doc-' || doc_id AS id, len(string_split(text, chr(10))) AS n FROM documents
)
SELECT id || '-' || i AS id, 2::BIGINT AS n
FROM p CROSS JOIN LATERAL (SELECT unnest(generate_series(1, n - 1)) AS i) WHERE n > 1""")
def id_collisions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fan-outs of one id along one route mint the same child ids."""
    env = docs(spark, sf_dir).select(
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("id"),
        R.make_route(names("lines", "again")).alias("route"),
        F.struct(F.size(F.split("text", "\n")).alias("n"), F.lit(0).alias("i")).alias("payload"),
    )
    spread = lambda p: F.transform(
        F.sequence(F.lit(0), p["n"] - 1), lambda i: p.withField("i", i)
    )
    reg = Registry()
    reg.column_actor("lines", spread, many=True)
    reg.column_actor("again", lambda p: F.when(p["i"] == 0, spread(p)).otherwise(F.array(p)),
                     many=True)
    return id_collisions(run(env, reg, max_hops=2))


# ---------------------------------------------------------------- outcomes


def failing_registry() -> Registry:
    reg = Registry()

    @reg.actor("prep")
    def py_prep(p):
        if p["lang"] == "de":
            raise ValueError("no de")
        return {**p, "text": p["text"].strip(" ").lower()}

    @reg.actor("tag")
    def py_tag(p):
        if p["lang"] == "fr":
            raise KeyError("fr")
        return {**p, "tag": p["lang"]}

    return reg


FAILING_SQL = """
f AS (
  SELECT 'doc-' || doc_id AS id, lang, text, n_chars,
    CASE WHEN lang = 'de' THEN 'prep' WHEN lang = 'fr' THEN 'tag' END AS failed_actor,
    CASE WHEN lang = 'de' THEN 0 WHEN lang = 'fr' THEN 1 END AS failed_actor_idx,
    CASE WHEN lang = 'de' THEN 'ValueError' WHEN lang = 'fr' THEN 'KeyError' END AS error_type,
    CASE WHEN lang = 'de' THEN 'no de' WHEN lang = 'fr' THEN '''fr''' END AS error_message,
    lang IN ('de', 'fr') AS failed
  FROM documents
)
"""


def failing_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(json_docs(docs(spark, sf_dir), names("prep", "tag")), failing_registry(), max_hops=2)


@query("routes_errors", f"""WITH {FAILING_SQL}
SELECT id, CASE WHEN failed THEN 'error-end' ELSE 'happy-end' END AS terminal,
       CASE WHEN failed THEN 'processing_error' END AS error, error_type, error_message,
       failed_actor_idx IS NULL OR failed_actor_idx = cursor AS cursor_kept, cursor,
       CASE WHEN failed THEN failed_actor ELSE 'tag' END AS last_actor,
       CASE WHEN failed THEN md5(CASE WHEN lang = 'de' THEN text ELSE lower(trim(text)) END) END
         AS original_md5
FROM (SELECT *, coalesce(failed_actor_idx, 2) AS cursor FROM f)""")
def routes_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handlers that raise: the row ends in the error terminal with its input kept."""
    done = to_error(failing_run(spark, sf_dir))
    failed = F.col("terminal") == "error-end"
    idx = F.when(F.col("details.type") == "ValueError", 0).when(failed, 1)
    return done.select(
        "id", "terminal", "error",
        F.col("details.type").alias("error_type"),
        F.col("details.message").alias("error_message"),
        F.coalesce(F.col("route.current") == idx, F.lit(True)).alias("cursor_kept"),
        F.col("route.current").alias("cursor"),
        "last_actor",
        F.md5(F.get_json_object("payload", "$.original_payload.text")).alias("original_md5"),
    )


@query("error_summary", f"""WITH {FAILING_SQL}
SELECT failed_actor, error_type, count(*) AS n FROM f WHERE failed GROUP BY ALL""")
def error_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures by actor and exception type."""
    return error_summary(final_report(terminals(failing_run(spark, sf_dir))))


@query("run_counters", f"""WITH {FAILING_SQL}, s AS (
  SELECT 'prep' AS actor, CASE WHEN lang = 'de' THEN 'runtime_error' ELSE 'success' END AS outcome,
         CASE WHEN lang = 'de' THEN 'error-end' ELSE 'tag' END AS dest,
         CASE WHEN lang = 'de' THEN 'error_end' ELSE 'routing' END AS kind FROM f
  UNION ALL
  SELECT 'tag', CASE WHEN lang = 'fr' THEN 'runtime_error' ELSE 'success' END,
         CASE WHEN lang = 'fr' THEN 'error-end' ELSE 'happy-end' END,
         CASE WHEN lang = 'fr' THEN 'error_end' ELSE 'happy_end' END FROM f WHERE lang <> 'de'
  UNION ALL
  SELECT CASE WHEN failed THEN 'error-end' ELSE 'happy-end' END, 'end_consumed', NULL, NULL FROM f
)
SELECT 'received' AS metric, actor AS label, 'table' AS detail, count(*) AS n FROM s GROUP BY ALL
UNION ALL SELECT 'processed', actor, outcome, count(*) FROM s WHERE outcome <> 'runtime_error'
GROUP BY ALL
UNION ALL SELECT 'failed', actor, outcome, count(*) FROM s WHERE outcome = 'runtime_error'
GROUP BY ALL
UNION ALL SELECT 'sent', dest, kind, count(*) FROM s WHERE kind IS NOT NULL GROUP BY ALL""")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five counters over the hop log of an actual run."""
    return counters(from_run(failing_run(spark, sf_dir)))


@query("final_reports", f"""WITH {FAILING_SQL}
SELECT id, CASE WHEN failed THEN 'failed' ELSE 'succeeded' END AS status,
       CASE WHEN NOT failed THEN 1.0::DOUBLE END AS progress,
       CASE WHEN failed THEN 'Envelope failed at actor ''' || failed_actor || ''': processing_error'
            ELSE 'Envelope completed successfully' END AS message,
       failed_actor, failed_actor_idx,
       CASE WHEN failed THEN 'prep,tag' END AS actors,
       CASE WHEN failed THEN 'processing_error: ' || error_message END AS error_text,
       CASE WHEN failed THEN 'prep,tag' END AS info_route,
       CASE WHEN NOT failed THEN md5(lower(trim(text))) END AS result_md5,
       printf('Received message (%.2f KB)', n_chars / 1024.0::DOUBLE) AS size_message,
       printf('Completed processing in %dms', n_chars) AS done_message,
       'Processing in ' || lang AS processing_message,
       '2024-03-01T12:30:00Z' AS timestamp, true AS parsed_back
FROM f""")
def final_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final status rows with their message texts."""
    at = F.lit("2024-03-01 12:30:00").cast("timestamp")
    done = terminal_result(terminals(failing_run(spark, sf_dir)))
    sizes = done.select(
        "id", F.get_json_object("payload", "$.n_chars").cast("bigint").alias("n_chars"),
        F.try_element_at("headers", F.lit("lang")).alias("lang"),
    )
    report = final_message(
        final_report(done.withColumn("payload", F.col("result")), at)
    )
    # frame columns of the same rows, carried next to the report
    wide = report.join(sizes, "id")
    return wide.select(
        "id", "status", "progress", "message", "failed_actor", "failed_actor_idx",
        F.array_join("actors", ",").alias("actors"),
        F.when(F.col("status") == "failed", error_text(F.col("error"), F.col("details")))
        .alias("error_text"),
        F.array_join("error_info.route", ",").alias("info_route"),
        F.md5(F.get_json_object("result", "$.text")).alias("result_md5"),
        size_kb_message(F.col("n_chars")).alias("size_message"),
        duration_message(F.col("n_chars")).alias("done_message"),
        processing_message(F.col("lang")).alias("processing_message"),
        "timestamp",
        (from_rfc3339(F.col("timestamp")) == at).alias("parsed_back"),
    )


@query("payload_sizes", "SELECT doc_id, strlen(text) AS size FROM documents")
def payload_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload sizes in bytes."""
    return docs(spark, sf_dir).select("doc_id", byte_size(F.col("text")).alias("size"))


@query("terminal_union", f"""WITH {FAILING_SQL}
SELECT id, CASE WHEN failed THEN 'error-end' ELSE 'happy-end' END AS terminal,
       CASE WHEN failed THEN 'processing_error' END AS error FROM f""")
def terminals_of_both_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success and error tables as one; both come from one stored run."""
    done = stored(terminals(failing_run(spark, sf_dir)), "run")
    happy = done.filter("terminal = 'happy-end'").select("id", "payload")
    failed = done.filter("terminal = 'error-end'").select("id", "payload", "error")
    return terminal_union(happy, failed).select("id", "terminal", "error")


@query("final_updates", f"""WITH {FAILING_SQL}
SELECT id, CASE WHEN failed THEN 'failed' ELSE 'succeeded' END AS status,
       CASE WHEN failed THEN 'Envelope failed at actor ''' || failed_actor || ''': processing_error'
            ELSE 'Envelope completed successfully' END AS message,
       CASE WHEN failed THEN 'processing_error' END AS error,
       100.0::DOUBLE AS progress_percent, failed_actor AS current_actor_name,
       CASE WHEN failed THEN error_type END AS stored_type FROM f""")
def final_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final reports appended to the update log and folded into state."""
    at = F.lit("2024-03-01 12:30:00").cast("timestamp")
    done = terminals(failing_run(spark, sf_dir))
    number = F.regexp_extract("id", r"(\d+)", 1)
    upd = as_updates(final_report(done), number, at)
    # the log is read twice by the fold, so it is stored like any update log
    upd = stored(upd, "final-updates")
    envs = docs(spark, sf_dir).select(
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("id"),
        names("prep", "tag").alias("actors"), at.alias("created_at"),
    )
    return fold_status(envs, upd).select(
        "id", "status", "message", "error", "progress_percent", "current_actor_name",
        F.get_json_object("result", "$.details.type").alias("stored_type"),
    )


@query("routes_abort", r"""
SELECT 'doc-' || doc_id AS id, 'happy-end' AS terminal,
       CASE WHEN n_chars < 100 THEN 0 ELSE 2 END AS cursor,
       CASE WHEN n_chars < 100 THEN 'empty_response' ELSE 'success' END AS first_outcome,
       CASE WHEN n_chars < 100 THEN 1 ELSE 2 END AS hops,
       md5(CASE WHEN n_chars < 100 THEN text ELSE lower(trim(text)) END) AS text_md5
FROM documents""")
def routes_abort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step without output ends the route with the original envelope."""
    reg = Registry()
    reg.column_actor("prep", lambda p: F.when(F.length(p["text"]) >= 100, prep(p)))
    reg.column_actor("tag", tag)
    done = run(typed_docs(docs(spark, sf_dir), names("prep", "tag")), reg, max_hops=2)
    return done.select(
        "id", "terminal", F.col("route.current").alias("cursor"),
        F.get("trace", F.lit(0))["outcome"].alias("first_outcome"),
        F.size("trace").alias("hops"),
        F.md5("payload.text").alias("text_md5"),
    )


DYNAMIC_SQL = """
SELECT 'doc-' || doc_id AS id, 'happy-end' AS terminal,
       CASE WHEN quality = 0 THEN 'judge,refine,tag' ELSE 'judge,tag' END AS actors,
       CASE WHEN quality = 0 THEN 3 ELSE 2 END AS cursor,
       CASE WHEN quality = 0 THEN 'refined' END AS refined
FROM documents LEFT JOIN labels USING (doc_id)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs(spark, sf_dir).select("doc_id", "lang").join(labels, "doc_id", "left")


@query("dynamic_route", DYNAMIC_SQL)
def dynamic_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score decides whether another step is inserted next."""
    env = labelled(spark, sf_dir).select(
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("id"),
        R.make_route(names("judge", "tag")).alias("route"),
        F.struct("lang", "quality", F.lit(None).cast("string").alias("refined")).alias("payload"),
    )
    reg = Registry()
    reg.column_actor("judge", lambda p: p,
                     reroute=lambda p, r: R.route_if(p["quality"] == 0, r, "refine"))
    reg.column_actor("refine", lambda p: enrich(p, refined=F.lit("refined")))
    reg.column_actor("tag", lambda p: p)
    done = run(env, reg, max_hops=3)
    return done.select(
        "id", "terminal", F.array_join("route.actors", ",").alias("actors"),
        F.col("route.current").alias("cursor"), F.col("payload.refined").alias("refined"),
    )


@query("dynamic_route_python", DYNAMIC_SQL)
def dynamic_route_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same decision in an envelope-mode Python actor that owns its route."""
    env = labelled(spark, sf_dir).select(
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("id"),
        R.make_route(names("judge", "tag")).alias("route"),
        F.to_json(F.struct("lang", "quality")).alias("payload"),
    )
    reg = Registry()

    @reg.actor("judge", mode="envelope")
    def judge(e):
        route = e["route"]
        at = route["current"] + 1
        if e["payload"].get("quality") == 0:
            route["actors"] = route["actors"][:at] + ["refine"] + route["actors"][at:]
        route["current"] = at
        return e

    @reg.actor("refine")
    def refine(p):
        return {**p, "refined": "refined"}

    @reg.actor("tag")
    def py_tag(p):
        return p

    done = run(env, reg, max_hops=3)
    return done.select(
        "id", "terminal", F.array_join("route.actors", ",").alias("actors"),
        F.col("route.current").alias("cursor"),
        F.get_json_object("payload", "$.refined").alias("refined"),
    )


@query("output_checks", """
SELECT 'doc-' || doc_id AS id,
       CASE WHEN doc_id % 4 = 0 THEN 'happy-end' ELSE 'error-end' END AS terminal,
       CASE doc_id % 4
         WHEN 1 THEN 'Invalid output envelope[1/2]: processed_prefix_changed'
         WHEN 2 THEN 'Invalid output envelope[0/1]: missing_payload'
         WHEN 3 THEN 'Invalid output envelope[0/1]: current_out_of_bounds' END AS message,
       CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS cursor
FROM documents""")
def output_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad outputs of an envelope actor fail the whole row and are named."""
    env = docs(spark, sf_dir).select(
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("id"),
        R.make_route(names("edit")).alias("route"),
        F.to_json(F.struct((F.col("doc_id") % 4).alias("kind"))).alias("payload"),
    )
    reg = Registry()

    @reg.actor("edit", mode="envelope")
    def edit(e):
        kind = e["payload"]["kind"]
        good = {**e, "route": {"actors": ["edit"], "current": 1}}
        if kind == 1:
            return [good, {**e, "route": {"actors": ["other"], "current": 1}}]
        if kind == 2:
            return {"route": good["route"]}
        if kind == 3:
            return {**e, "route": {"actors": ["edit"], "current": 5}}
        return good

    return run(env, reg, max_hops=1).select(
        "id", "terminal", F.col("details.message").alias("message"),
        F.col("route.current").alias("cursor"),
    )


@query("misrouted_outcomes", """
SELECT 'doc-' || doc_id AS id,
       CASE WHEN doc_id % 5 = 0 THEN 'route_mismatch' WHEN lang = 'de' THEN 'runtime_error'
            WHEN n_chars < 100 THEN 'empty_response' ELSE 'success' END AS outcome,
       CASE WHEN doc_id % 5 = 0 OR lang = 'de' THEN 'error-end' WHEN n_chars < 100 THEN 'happy-end'
            ELSE 'tag' END AS dest,
       CASE WHEN doc_id % 5 = 0 OR lang = 'de' THEN 'error_end' WHEN n_chars < 100 THEN 'happy_end'
            ELSE 'routing' END AS message_type,
       CASE WHEN doc_id % 5 = 0 THEN 'Route mismatch: expected ''prep'', got ''tag'''
            WHEN lang = 'de' THEN 'processing_error' END AS error
FROM documents""")
def misrouted_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every outcome of one hop, rows for another actor included."""
    doc_id = F.col("doc_id")
    actors = F.when(doc_id % 5 == 0, names("tag", "prep")).otherwise(names("prep", "tag"))
    reg = Registry()
    reg.column_actor(
        "prep", lambda p: F.when(F.length(p["text"]) >= 100, p),
        fails=lambda p: F.when(p["lang"] == "de", "no de"),
    )
    reg.column_actor("tag", tag)
    out = step(typed_docs(docs(spark, sf_dir), actors), reg, "prep")
    last = F.get("trace", F.lit(0))
    return out.select(
        "id", last["outcome"].alias("outcome"), "dest", last["message_type"].alias("message_type"),
        F.col("failure.error").alias("error"),
    )


@query("column_errors", """
WITH judged AS (
  SELECT *, n_chars % 7 = 0 AS halted, len(string_split(text, ' ')) < 40 AS short FROM documents)
SELECT 'doc-' || doc_id AS id,
       CASE WHEN halted OR short THEN 'error-end' ELSE 'happy-end' END AS terminal,
       CASE WHEN halted THEN 'share' ELSE 'word' END AS last_actor,
       CASE WHEN halted OR short THEN 'the expression raised an error' END AS message,
       CASE WHEN NOT halted THEN (10000 // (n_chars % 7))::BIGINT END AS share,
       CASE WHEN NOT halted AND NOT short THEN string_split(text, ' ')[40] END AS word
FROM judged""")
def column_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions that raise, by division or by index, cost their own row only."""
    env = docs(spark, sf_dir).select(
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("id"),
        R.make_route(names("share", "word")).alias("route"),
        F.struct(
            "text", F.col("n_chars").cast("bigint").alias("n_chars"),
            F.lit(None).cast("bigint").alias("share"), F.lit(None).cast("string").alias("word"),
        ).alias("payload"),
    )
    reg = Registry()
    reg.column_actor("share", lambda p: p.withField(
        "share", F.floor(F.lit(10000) / (p["n_chars"] % 7))), guard=True)
    reg.column_actor("word", lambda p: p.withField(
        "word", F.element_at(F.split(p["text"], " "), 40)), guard=True)
    return run(env, reg, max_hops=2).select(
        "id", "terminal", "last_actor", F.col("details.message").alias("message"),
        F.col("payload.share").alias("share"), F.col("payload.word").alias("word"),
    )


@query("header_propagation", """
SELECT 'doc-' || doc_id AS id, lang AS header_lang, source AS header_source, 2 AS n_headers,
       'doc-' || doc_id AS job, CASE WHEN doc_id % 2 = 0 THEN 'tool' ELSE 'default' END AS tier,
       2 AS cursor
FROM documents""")
def header_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers and route metadata survive every hop; option maps merge."""
    source = docs(spark, sf_dir)
    env = json_docs(source, names("first", "second"))
    env = env.withColumn(
        "route",
        F.col("route").withField("metadata", F.create_map(F.lit("job_id"), F.col("id"))),
    )
    reg = Registry()
    reg.column_actor("first", lambda p: p)
    reg.column_actor("second", lambda p: p)
    done = run(env, reg, max_hops=2)
    number = F.regexp_extract("id", r"(\d+)", 1).cast("bigint")
    own = F.when(number % 2 == 0, F.create_map(F.lit("tier"), F.lit("tool")))
    merged = R.merge_maps(F.create_map(F.lit("tier"), F.lit("default")), own)
    return done.select(
        "id",
        F.try_element_at("headers", F.lit("lang")).alias("header_lang"),
        F.try_element_at("headers", F.lit("source")).alias("header_source"),
        F.size("headers").alias("n_headers"),
        R.job_id(F.col("route"), F.col("id")).alias("job"),
        F.try_element_at(merged, F.lit("tier")).alias("tier"),
        F.col("route.current").alias("cursor"),
    )


@query("visit_guard", """
SELECT 'doc-' || doc_id AS id, CASE WHEN doc_id % 13 >= 10 THEN 'error-end' ELSE 'happy-end' END
         AS terminal,
       least(doc_id % 13 + 1, 10)::INTEGER AS cursor,
       CASE WHEN doc_id % 13 >= 10 THEN 'loop visited more than 10 times' END AS message
FROM documents""")
def visit_guard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps visited more than ten times along one route become errors."""
    actors = F.array_repeat(F.lit("loop"), (F.col("doc_id") % 13 + 1).cast("int"))
    env = docs(spark, sf_dir).select(
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("id"),
        R.make_route(actors).alias("route"),
        F.struct("lang").alias("payload"),
    )
    reg = Registry()
    reg.column_actor("loop", lambda p: p)
    return run(env, reg, max_hops=13, max_visits=10).select(
        "id", "terminal", F.col("route.current").alias("cursor"),
        F.col("details.message").alias("message"),
    )


@query("object_keys", """
SELECT 'done/' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || '/' || event_type || '/' || event_id
         || '.json' AS key
FROM events""")
def object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys under which terminal rows are filed."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        object_key("done/", F.col("ts").cast("timestamp"), F.col("event_type"),
                   F.col("event_id").cast("string")).alias("key")
    )


@query("rfc3339", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS text, date_trunc('second', ts) AS parsed
FROM events""")
def rfc3339(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps as RFC 3339 text and back."""
    ev = table(spark, sf_dir, "events").select(
        "event_id", to_rfc3339(F.col("ts").cast("timestamp")).alias("text")
    )
    return ev.select("event_id", "text", utc(from_rfc3339(F.col("text"))).alias("parsed"))


SLOW_CHARS = 25_000


@query("time_limit", f"""
SELECT 'doc-' || doc_id AS id,
       CASE WHEN n_chars > {SLOW_CHARS} THEN 'error-end' ELSE 'happy-end' END AS terminal,
       CASE WHEN n_chars > {SLOW_CHARS} THEN 'Runtime timeout exceeded after 0.5s' END AS error
FROM documents""")
def time_limit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A handler that hangs on very long texts only loses those rows."""
    reg = Registry()

    @reg.actor("slow", timeout=0.5)
    def slow(p):
        import time

        if p["n_chars"] > SLOW_CHARS:
            time.sleep(60)
        return p

    env = docs(spark, sf_dir).select(
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("id"),
        R.make_route(names("slow")).alias("route"),
        F.to_json(F.struct("n_chars")).alias("payload"),
    )
    return run(env, reg, max_hops=1).select("id", "terminal", "error")
